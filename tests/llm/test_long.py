"""Very long texts with very many hits take time in proportion; folding; bounded work in the driver; scopes of threads."""

import random
import threading
import time

import numpy as np
import pytest

from textloom.llm import scratch, secrets, syncmers, toxicity


def seconds(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


def test_secrets_of_a_long_text():
    field = secrets.fit(steps=30)
    r = random.Random(1)
    line = lambda: f"the token is {''.join(r.choices('abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789', k=24))} é and password = {r.randrange(10**15):x}\n"
    text = "".join(line() for _ in range(60_000))
    assert len(text) > 4_000_000

    def scan(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return secrets.find([t], data, np.array([0, len(data)]), field)[0]

    small, large = seconds(scan, text[: len(text) // 4]), seconds(scan, text)
    assert large < 60 and large < 8 * small + 2
    found = scan(text[:100_000])
    base = secrets.base_spans(text[:100_000])
    # As by plain search: base spans stay, and no other span lies inside one of them.
    assert [x for x in found if x[1] < 3] == base
    assert not [x for x in found if x[1] == 3 and any(s <= x[0] and x[2] <= e for s, _, e in base)]


def test_toxicity_of_a_long_text():
    lexicon = toxicity.Lexicon({" damn ": 2.0, " idiot ": 3.0, " idi": 1.0}, [" damn good ", " good idiot ", " damn good idiot "])
    m = toxicity.Matcher(lexicon)
    text = toxicity.fold("damn good idiot " * 130_000 + "idiot damn")
    assert len(text) > 2_000_000
    small, large = seconds(m.sums, text[: len(text) // 4]), seconds(m.sums, text)
    assert large < 30 and large < 8 * small + 2
    assert m.sums(text) == (5.0, 2)


@pytest.mark.parametrize("word", ["ídiot", "ⓘdiot", "𝐢diot", "ｉｄｉｏｔ", "idïot", "і𝒹іоt", "i​diot", "1d10t", "İdiot", "IDIOT", "ⅰdiot"])
def test_folded_forms(word):
    assert toxicity.fold(word) == " idiot "


def test_cuts_hold_few_keys_however_many_ranges(spark, monkeypatch):
    d = spark.createDataFrame([(i, f"text {i}", i * 7919 % 10007) for i in range(4000)], "id long, text string, tie long")
    monkeypatch.setattr(syncmers, "RANGE_BYTES", 10)
    monkeypatch.setattr(syncmers, "MOST_RANGES", 50)
    monkeypatch.setattr(syncmers, "MOST_KEYS", 100)
    seen, sort = [], sorted
    monkeypatch.setattr(syncmers, "sorted", lambda x, **k: (seen.append(len(x)), sort(x, **k))[1], raising=False)
    assert 10 <= len(syncmers._cuts(d, 4)) <= 101 and seen[0] <= 101


def test_scopes_of_threads(spark):
    """A table of one thread's scope outlives another thread's scope."""
    inside, over = threading.Event(), threading.Event()
    kept = []

    def first():
        with scratch.passing(spark):
            kept.append(scratch.write(spark.range(5).toDF("x")))
            inside.set()
            over.wait(60)
            kept.append(kept[0].count())

    t = threading.Thread(target=first)
    t.start()
    inside.wait(60)
    with scratch.passing(spark):
        scratch.write(spark.range(3).toDF("x"))
        outlives = scratch.kept(spark.range(7).toDF("x"))
    over.set()
    t.join()
    assert kept[1] == 5 and outlives.count() == 7
