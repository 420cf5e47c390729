"""Operators against brute force, the library, exact round trips and held-out accuracy."""

import datetime
import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import langid, licenses, mixing, neardup, pieces, quality, queries, secrets, syncmers, toxicity
from textloom.llm import textbytes as tb

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingle_set(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def joined(texts):
    """Classes of texts by brute force: equal texts, and Jaccard of 0.8 or more."""
    up = {i: i for i in texts}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: shingle_set(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and (texts[i] == texts[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in texts}


def variants(seed=5, n=120):
    """Chains and crowds of near copies, many just over or under the threshold."""
    r = random.Random(seed)
    texts = {}
    for base in range(4):
        words = [f"w{r.randint(0, 9999)}" for _ in range(100)]
        for k in range(n // 4):
            w = list(words)
            for _ in range(r.choice([0, 1, 1, 2, 2, 3])):
                w[r.randrange(100)] = f"e{r.randint(0, 10**6)}"
            texts[base * 1000 + k] = " ".join(w)
    texts |= {9001: "a b", 9002: "A, b!", 9003: "a b c", 9004: "", 9005: "...", 9006: ""}
    return texts


def test_classes(spark):
    texts = variants()
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(d).collect()}
    assert got == joined(texts)


def test_prefix_pairs_lose_nothing(spark):
    texts = {i: t for i, t in variants(6, 80).items() if t}
    d = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "id long, text string, c long")
    got = {(r.a, r.b) for r in neardup._prefix_pairs(d, 0.8).collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    want = {(i, j) for i in texts for j in texts if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert want <= {tuple(sorted(p)) for p in got}


def footers(n=60, seed=9):
    """Pairs (2i, 2i + 1) of texts that differ by a line repeated many times: links, though their weighted similarity is far lower."""
    r, texts = random.Random(seed), {}
    for i in range(n):
        body = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(64 if i % 2 else 104))
        texts[2 * i] = body
        texts[2 * i + 1] = body + f" f{i}a f{i}b f{i}c" * (200 if i % 2 else 1) + "".join(f" g{i}x{k}" for k in range(0 if i % 2 else 10)) * 50
    return texts


def test_links_of_texts_with_repeated_lines_are_verified(spark):
    texts = footers()
    d = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    pairs = spark.createDataFrame([(i, i + 1) for i in texts if i % 2 == 0] + [(0, 2), (1, 2)], "a long, b long")
    got = {tuple(r) for r in neardup._verified(pairs, neardup._sketched(d, "id", "text").drop("key", "bands"), d, 0.8).collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    assert got == {(i, i + 1) for i in texts if i % 2 == 0 and len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])} and len(got) == len(texts) // 2


def test_links_share_a_bucket(spark):
    texts = footers(200, 10)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    bands = {r.id: set(r.bands) for r in neardup._sketched(d, "doc_id", "text").select("id", "bands").collect()}
    assert all(bands[i] & bands[i + 1] for i in texts if i % 2 == 0)
    some = {i: t for i, t in texts.items() if i < 80}
    got = {r.doc_id: r.class_id for r in neardup.near_duplicate_classes(d.where("doc_id < 80")).collect()}
    assert got == joined(some)


def test_an_id_with_several_texts_is_one_document(spark):
    texts = variants(11, 60)
    rows = [*texts.items(), (3000, texts[1]), (3000, "quite another text than the one before it"), (7777, texts[9001]), (7777, texts[2001] + " x")]
    got = defaultdict(set)
    for r in neardup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        got[r.doc_id].add(r.class_id)
    chosen = {}
    for i, t in rows:
        chosen[i] = min(chosen.get(i, t), t, key=lambda x: hashlib.sha256(x.encode()).digest())
    assert {i: {c} for i, c in joined(chosen).items()} == got


def test_links_join_the_classes(spark):
    texts = variants(12, 60)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    links = neardup.near_duplicate_links(d).collect()
    assert all(len(sets[r.a] & sets[r.b]) >= 0.8 * len(sets[r.a] | sets[r.b]) for r in links)
    linked = {r.v: r.c for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert {i: linked.get(first[t], first[t]) for i, t in texts.items()} == joined(texts)


def test_sketches_estimate_probability_jaccard():
    r = np.random.default_rng(3)
    for _ in range(5):
        a, b = {int(x): float(r.integers(1, 5)) for x in r.integers(1, 80, 50)}, {int(x): float(r.integers(1, 5)) for x in r.integers(1, 80, 50)}
        want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
        pair = lambda m: (np.array(sorted(m), np.uint64), np.array([m[k] for k in sorted(m)]))
        assert math.isclose(neardup.probability_jaccard(pair(a), pair(b)), want, rel_tol=1e-9)
        text = np.array([0] * len(a) + [1] * len(b))
        s = neardup.sketch(text, tb.mix(np.concatenate([pair(a)[0], pair(b)[0]])), np.concatenate([pair(a)[1], pair(b)[1]]), 2, 4096)
        assert abs((s[0] == s[1]).mean() - want) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 5)]
    got = {r.v: r.c for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)], best


def quality_texts():
    r = random.Random(3)
    parts = ["ab", "foo", "bar baz ", "longerword12345 ", "über ", " ", "\n", "\t", "#|"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 120))) for _ in range(60)] + ["", None, "x " * 60, "one two three four five six seven eight nine ten " * 12, "a\nb\n\na\n a"]


def test_quality(spark):
    texts = quality_texts()
    rules = quality.QualityRules()
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        want, best = brute_quality(t)
        r, n = got[i], want[0]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        inside = {i + k for i, b in enumerate(best) if b >= rules.min_repeat for k in range(b)}
        top = max([b for b in best if b >= rules.min_repeat], default=0)
        failed = n < 50 or 100 * want[4] > 50 * n
        assert (r.base_failed, r.covered_words, r.longest_repeat) == (failed, len(inside), top)
        assert r.kept == (not failed and len(inside) <= rules.max_covered * n and not (top > rules.longest_from and top > rules.max_longest * n))


def test_encoding_is_the_librarys(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.public_model())
    r = random.Random(1)
    some = [*"  abe▁\n\t\x00é漢字😀​　Áﬁ", "the ", "<0x0A>", "<unk>", "    ", "<s>"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["", " ", "  "]
    d = pieces.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces.public_model(), with_ids=True, with_bounds=True)
    for x in d.collect():
        t, want = texts[x.doc_id], sp.encode(texts[x.doc_id])
        assert x.ids == want and x.n_tokens == len(want)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()
        assert x.bounds == sorted(x.bounds) and (not want or (x.bounds[0], x.bounds[-1]) == (0, len(t.encode())))


def trie(rules):
    """A compiled character map for rules, built plainly: units of (label, offset, leaf) placed where they fit."""
    texts, starts = b"", {}
    for v in rules.values():
        starts[v] = len(texts)
        texts += v + b"\0"
    tree = {}
    for k, v in rules.items():
        node = tree
        for c in k:
            node = node.setdefault(c, {})
        node[None] = starts[v]
    units, used = {0: 0}, {0}

    def place(node, at):
        # Children of the unit at ``at`` lie at at ^ offset ^ label; a leaf is the child of label 0.
        labels = [0 if c is None else c for c in node]
        offset = next(o for o in range(1, 1 << 20) if all(at ^ o ^ c not in used for c in labels))
        used.update(at ^ offset ^ c for c in labels)
        units[at] = units[at] | offset << 10 | (0x100 if None in node else 0)
        for c, child in node.items():
            to = at ^ offset ^ (0 if c is None else c)
            if c is None:
                units[to] = 0x80000000 | child
            else:
                units[to] = c
                place(child, to)

    place(tree, 0)
    size = (max(units) | 0xFF) + 1
    return struct.pack("<I", 4 * size) + b"".join(struct.pack("<I", units.get(i, 0x80000000 | 0x7FFFFFFF)) for i in range(size)) + texts


def test_character_map_takes_the_longest_prefix():
    rules = {"é".encode(): b"e", b"ab": b"X", b"abc": b"YY", "　".encode(): b" ", b"z": b""}
    m = pieces.CharsMap(trie(rules))
    for text in ("abcabéz", "aab", "ａ　b", "zzz", ""):
        data, i, out, want, j = text.encode(), 0, b"", b"", 0
        while i < len(data):
            n, new = m.longest(data, i) or (1, data[i : i + 1])
            out, i = out + new, i + n
        while j < len(data):
            k = max((k for k in rules if data.startswith(k, j)), key=len, default=None)
            want, j = want + (rules[k] if k else data[j : j + 1]), j + (len(k) if k else 1)
        assert out == want
    e = object.__new__(pieces.Encoder)
    e.map, e.prefix, e.squeeze, e.escape = m, True, True, True
    data, place = e.normalize("  ab  é z ")
    assert data.decode() == "▁X▁e" and list(place) == [2, 2, 2, 2, 4, 4, 4, 6, 8]


def test_base_secrets_and_viterbi():
    text = "token=token: \"abcdefghijkl123\" PASSWD : 'zzzzzzzzzzzz' AKIAABCDEFGHIJKLMN AKIA1 0123456789abcdef0 é api_key=ABCDEFGHIJKLmnop"
    kinds = {0: r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1: r"AKIA[A-Z0-9]+", 2: r"[0-9a-f]+"}
    want = sorted((m.start(), k, m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if (len(m[2]) >= 12 if k == 0 else len(m[0]) >= (18 if k == 1 else 16)))
    assert secrets.base_spans(text) == want and want
    r = np.random.default_rng(2)
    moves = r.normal(size=(3, 3))
    moves[0, 2] = -1e9
    field = secrets.Field(r.normal(size=(3, secrets.N_FEATURES)), moves)
    x = (r.random((60, secrets.N_FEATURES)) < 0.3).astype(np.float32)
    x[:, 0] = 1
    first = np.array([0, 4, 4, 5, 60])
    score = x @ field.weights.T
    got = secrets.decode(x, first, field)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a <= 5:
            paths = [[int(c) for c in np.base_repr(k, 3).zfill(b - a)] for k in range(3 ** (b - a))] if b > a else [[]]
            value = lambda p: sum(score[a + i, y] for i, y in enumerate(p)) + sum(moves[u, v] for u, v in zip([0, *p], [*p, 0], strict=True)) if p else 0  # noqa: B023, E731
            assert math.isclose(value(list(got[a:b])), max(map(value, paths)), abs_tol=1e-6)


def test_secret_field(spark):
    field = secrets.fit([])
    rows = [(1, "db pass: Zk39fjQ0aLm2XyTT91 done"), (2, "the password is wrong again, call 555-1234-5678"), (3, "é token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\" x"), (4, "ghp_16C7e42F292c6912E7710c838347Ae178B4a")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(d, field=field).collect()}
    assert got[1] == "crf:9:27" and got[2] == "" and got[3].startswith("assign:2:") and got[4].startswith("crf:0:")
    clean = {r.doc_id: r for r in secrets.redact_secrets(d, field=field).collect()}
    assert clean[1].text == "db pass: [SECRET] done" and clean[3].text == 'é [SECRET]" x' and clean[2].text == rows[1][1] and all(r.n_chars == len(r.text) for r in clean.values())


def planted_secrets(seed=5, n=150):
    """For each kind, (text, start, end) with a secret there; and clean texts that look a little like it."""
    r = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda c, k: "".join(r.choice(c) for _ in range(k))
    words = "the service needs this value to start so keep it safe and rotate every month with care please when new people join our team in spring".split()
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    kinds = {
        "github": lambda: (f"{prose(2)} use ", "ghp_" + some(letters, 36)),
        "jwt": lambda: ("Authorization: Bearer ", ".".join(["eyJ" + some(letters, 20), some(letters + "_-", 60), some(letters + "_-", 43)])),
        "key of 40": lambda: ("aws_secret_access_key = ", some(letters + "+/", 40)),
        "slack": lambda: ("slack: ", "xoxb-" + some("0123456789", 12) + "-" + some(letters, 24)),
        "bearer": lambda: ("bearer ", some(letters, 32)),
        "upper": lambda: ("api key: ", some("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 24)),
        "hex inside": lambda: ("key ", "sk_live_" + some("0123456789abcdef", 20) + some("XYZQWghijk", 6) + some(letters, 8)),
        "nine": lambda: ("password: ", some(letters, 8) + r.choice("0123456789")),
        "signs": lambda: ('password = "', some(letters, 5) + r.choice("!#$%&*") + some(letters, 4) + r.choice("!@?^") + some("0123456789", 2)),
    }
    plain = [
        lambda: "the password is wrong again", lambda: f"call 555-{some('0123456789', 4)}", lambda: f"on 2024-11-{r.randint(10, 28)} at 10:30", lambda: f"see https://example.org/a/b-c?id={some('0123456789', 5)}",
        lambda: f"version 3.11.{r.randint(0, 30)}", lambda: f"order {some('0123456789', 7)} shipped", lambda: "camelCaseNames and snake_case_names_2", lambda: f"mail anna.berg{r.randint(1, 99)}@example.com",
    ]
    out = {}
    for kind, make in kinds.items():
        out[kind] = []
        for _ in range(n):
            head, secret = make()
            at = len(before := f"{prose(r.randint(4, 12))}. {head}")
            out[kind].append((before + secret + ('"' if head.endswith('"') else "") + f" {prose(r.randint(3, 10))}.", at, at + len(secret)))
    return out, [f"{prose(30)} {r.choice(plain)()} {prose(10)}" for _ in range(4 * n)]


def test_planted_secrets_are_found_whole():
    field = secrets.fit()
    rows, clean = planted_secrets()
    find = lambda texts: secrets.find(texts, *tb.column_bytes(pa.array(texts)), field)
    for kind, cases in rows.items():
        whole = sum(secrets.MARK in secrets.redact(t, s) and set(range(a, b)) <= {k for i, _, j in s for k in range(i, j)} for (t, a, b), s in zip(cases, find([t for t, _, _ in cases]), strict=True))
        assert whole >= 0.9 * len(cases), kind
    assert sum(map(bool, find(clean))) <= 0.01 * len(clean)


def test_no_half_of_a_secret_stays():
    field = secrets.fit()
    for text, left in (("use ghp_0123456789abcdef0XYZQWsecretTAIL99 now", "use [SECRET] now"), ("key sk_live_0123456789abcdef0123456789abcdefXyZ9 end", "key [SECRET] end")):
        found = secrets.find([text], *tb.column_bytes(pa.array([text])), field)[0]
        assert secrets.redact(text, found) == left and set(secrets.base_spans(text)) <= set(found)


def test_the_sample_of_the_field_is_bounded(spark):
    rows = [(7, f"token = Zk39fjQ0aLm2XyTT{k} and some more words for text {k}") for k in range(500)] + [(None, "x"), (8, None)]
    sent = []
    old = secrets.fit
    try:
        secrets.fit = lambda w: sent.extend(w) or old(w)
        secrets.fit_on(spark.createDataFrame(rows, "doc_id long, text string"), sample_rows=2, sample_windows=2)
    finally:
        secrets.fit = old
    assert 0 < len(sent) <= 4


def brute_bits(train, order, least, text):
    follow = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        for i in range(len(t)):
            for k in range(min(i, order) + 1):
                follow[k][t[i - k : i]][t[i]] += 1
    known = {b""}
    for k in range(1, order + 1):
        known |= {c for c, n in follow[k].items() if sum(n.values()) >= (least if k > 1 else 1) and (k == 1 or {c[1:], c[:-1]} <= known)}
    bits = 0.0
    for i, sign in enumerate(text):
        k = min(order, i)
        while text[i - k : i] not in known:
            k -= 1
        out: set = set()
        while True:
            own = {s: n for s, n in follow[k][text[i - k : i]].items() if s not in out}
            total = sum(own.values()) + len(own)
            if sign in own:
                bits -= math.log2(own[sign] / total)
                break
            bits -= math.log2(len(own) / total) if own else 0
            out |= set(own)
            if not k:
                bits += math.log2(256 - len(out))
                break
            k -= 1
    return bits


def test_code_lengths():
    train = [b"the cat sat on the mat. the hat", "abracadabra éé abra".encode()]
    tree = langid.grow(train, 3, 2)
    for q in (b"the abracat zz \xc3\xa9", b"a", b"abra" * 200 + b"the hat"):
        assert math.isclose(langid.code_lengths(np.frombuffer(q, np.uint8), np.array([0, len(q)]), [tree])[0, 0], brute_bits(train, 3, 2, q), rel_tol=1e-5)


def test_only_letters_make_a_language(spark):
    train = [(i, f"the cat and the dog number {i}" if i % 2 else f"der hund und die katze nummer {i}", "en" if i % 2 else "de") for i in range(40)]
    d = spark.createDataFrame([*train, (100, "½ ²", None), (101, "Ⅷ ① 12 _", None), (102, "½ ª", None), (103, "the cat", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(d, langid.learn(d)).collect()}
    assert got[100].lang_pred == got[101].lang_pred == "und" and got[100].score == 0 and got[102].lang_pred in ("en", "de") and got[103].lang_pred == "en"


def test_the_sample_of_languages_is_bounded_and_never_empty(spark):
    own = next(i for i in range(20) if zlib.crc32(str(i).encode()) % 5)
    rows = [(7 + k % 3, f"text {k} of the same few ids", "en") for k in range(2000)] + [(i, "immer derselbe text", "de") for i in range(500)] + [(own, "x" * 5000, "fr"), (own, "y" * 5000, "fr"), (1, None, "es"), (2, "", "es")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = langid.sample_texts(d, "doc_id", "text", "lang", 48, 6000)
    assert {k: len(v) for k, v in got.items()} == {"de": 1, "en": 48, "fr": 1}


@needs_data
def test_languages_and_toxicity_of_held_out_rows(spark):
    got = queries.QUERIES["op6_language_id"](spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    t = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = queries.QUERIES["op2_toxicity"](spark, DATA).join(t, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) > 0.8 * len(pos) * len(neg)


def naive_sums(lexicon, folded):
    """Every term and phrase looked for at every place."""
    places = lambda x: [i for i in range(len(folded)) if folded.startswith(x, i)]
    excused = [(i, i + len(p)) for p in lexicon.exceptions for i in places(p)]
    best = {}
    for t, w in lexicon.terms.items():
        for i in places(t):
            best[i] = max(best.get(i, (0, 0)), (w, i + len(t)))
    found = [w for i, (w, end) in best.items() if not any(a <= i and end <= b for a, b in excused)]
    return sum(found), len(found)


def test_matches_against_a_naive_scan():
    r = random.Random(21)
    words = ["idiot", "idiots", "scum", "sc", "scumbag", "bag", "damn", "good", "id", "ba"]
    for _ in range(60):
        beginnings = {" " + w[: r.randint(2, len(w))]: r.choice([1.0, 2.0, 3.5]) for w in r.sample(words, 4)}
        terms = beginnings | {f" {w} ": r.choice([0.5, 4.0]) for w in r.sample(words, 3)}
        lexicon = toxicity.Lexicon(terms, [f" {a} {b} " for a, b in (r.sample(words, 2) for _ in range(3))])
        m = toxicity.Matcher(lexicon)
        for _ in range(20):
            folded = toxicity.fold(r.choice([" ", ", "]).join(r.choice(words) for _ in range(r.randint(0, 30))))
            got, want = m.sums(folded), naive_sums(lexicon, folded)
            assert math.isclose(got[0], want[0]) and got[1] == want[1]


def test_the_sample_of_the_lexicon_is_bounded(spark):
    own = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    docs = [(own[0], f"copy {k}") for k in range(300)] + [(i, "a much longer idiot text " * 20) for i in own[1:]] + [(None, "idiot")]
    labels = spark.createDataFrame([(i, i % 2) for i in own] + [(own[0], None), (None, 1)], "doc_id long, toxic int")
    seen, old = [], toxicity.fit
    try:
        toxicity.fit = lambda rows, how: seen.append(rows)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        toxicity.learn(d, labels, sample_rows=50)
        toxicity.learn(d, labels, sample_bytes=5000)
    finally:
        toxicity.fit = old
    assert len(seen[0]) == 50 and 0 < sum(len(t) for t, _ in seen[1]) <= 5000


def test_folding_and_exceptions():
    bad = [f"w{i} idiot v{i}" for i in range(30)]
    lexicon = toxicity.fit([(t, 1) for t in bad] + [(f"a calm text u{i}", 0) for i in range(60)] + [(f"class idiot u{i}", 0) for i in range(5)])
    m = toxicity.Matcher(lexicon)
    assert all(m.score(t) > m.score("calm") for t in ("you 1d10t", "YOU ІDІОТ", "such an idiot!", "ｉｄｉｏｔ")) and m.score("a calm day") < 0.5 and m.score("") < 0.5
    assert m.sums(toxicity.fold("the class idiot"))[0] < m.sums(toxicity.fold("an idiot"))[0]


@needs_data
def test_fingerprints(spark):
    rows = sorted(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in queries.QUERIES["op4_syncmers"](spark, DATA).collect()}
    for k, (i, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert math.isclose(r.near_next, syncmers.likeness(syncmers.read(r.fingerprint), syncmers.read(got[rows[(k + 1) % len(rows)][0]].fingerprint)))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.97


def test_syncmers_are_chosen_by_their_own_bytes():
    text = bytes(random.Random(4).randrange(97, 105) for _ in range(400))
    data, offsets = tb.column_bytes(pa.array([text.decode(), "", "short", text[100:350].decode()]))
    who, value, at = syncmers.anchors(data, offsets)
    h = lambda b: int(tb.mix(np.array([int.from_bytes(b, "little")], np.uint64))[0])
    k, s = syncmers.K, syncmers.S
    want = [i for i in range(len(text) - k + 1) if min(hs := [h(text[j : j + s]) for j in range(i, i + k - s + 1)]) in (hs[0], hs[-1])]
    assert sorted(at[who == 0]) == want
    inner = {int(v) for v, a in zip(value[who == 0], at[who == 0], strict=True) if 100 <= a <= 350 - k}
    assert inner <= {int(v) for v in value[who == 3]}


def brute_fingerprint(text, sample):
    """{hash: first place} of the kept anchors, one run at a time."""
    data, k, s, places = text.encode(), syncmers.K, syncmers.S, {}
    h = lambda b: int(tb.mix(np.array([int.from_bytes(b, "little")], np.uint64))[0])
    for i in range(len(data) - k + 1):
        hs = [h(data[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(hs) in (hs[0], hs[-1]):
            value = int(tb.combine([np.array([x], np.uint64) for x in (hs[0], hs[-1])])[0])
            places.setdefault(value, i)
    order = sorted(places)
    n = max(sample.keep, sum(v < 2**64 // sample.share for v in order))
    return {v: places[v] for v in order[:n]}


def brute_likeness(a, b, sample):
    union = sorted({*a, *b})
    most = max(min(sample.keep, len(union)), sum(v < 2**64 // sample.share for v in union))
    both = sorted((a[v], b[v]) for v in union[:most] if v in a and v in b)
    longest = [0] * len(both)
    for i, (_, y) in enumerate(both):
        longest[i] = 1 + max((longest[j] for j in range(i) if both[j][1] < y), default=0)
    return max(longest, default=0) / most


@pytest.mark.parametrize("sample", [syncmers.DEFAULT, syncmers.Sample(8, 4), syncmers.Sample(1, 1)])
def test_fingerprints_and_likeness_against_brute_force(sample):
    r = random.Random(6)
    texts = []
    for n in (3, 40, 200, 240, 250, 256, 262, 600, 2500):
        text = "".join(r.choice("abcdefghij ") for _ in range(n))
        cut = r.randrange(n)
        texts += [text, text[:cut] + "inserted " + text[cut:], text[n // 2 :] + text[: n // 2], text + "ten more b"]
    got = syncmers.fingerprints(*tb.column_bytes(pa.array(texts)), sample)
    want = [brute_fingerprint(t, sample) for t in texts]
    for g, w, t in zip(got, want, texts, strict=True):
        assert dict(zip(g[0].tolist(), g[1].tolist(), strict=True)) == w or len(t) < 20
    for i in range(0, len(texts), 4):
        for j in range(i, i + 4):
            if len(texts[i]) >= 40:
                assert math.isclose(syncmers.likeness(got[i], got[j], sample), brute_likeness(want[i], want[j], sample))


def test_likeness_does_not_jump_with_the_length():
    r = random.Random(6)
    for n in (60, 120, 240, 250, 256, 262, 500, 1000):
        for _ in range(10):
            text = "".join(r.choice("abcdefghij ") for _ in range(n))
            a, b = syncmers.fingerprints(*tb.column_bytes(pa.array([text, text + "ten more b"])))
            assert syncmers.likeness(a, b) > 0.95 * n / (n + 16) - 8 / n and syncmers.likeness(b, b) == 1


def test_edits_with_ids_of_any_kind(spark):
    r = random.Random(12)
    words = [" ".join(r.choice(["ab", "cde", "fghi", "é"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    for kind, ids in (("string", [f"k{i % 90:03d}" for i in range(300)]), ("long", [i % 90 for i in range(300)]), ("date", [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(300)])):
        rows = [*zip(ids, words, strict=True), (None, "null id one"), (None, None)]
        d = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
        ties = {r.t: r.x for r in d.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("x")).collect()}
        order = sorted([(i, t or "") for i, t in rows], key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, ties[x[1]]))
        want = []
        for k, (i, t) in enumerate(order):
            after, half = order[(k + 1) % len(order)][1], len(t) // 2
            want.append((str(i), len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
        for ranges in (1, 7):
            got = syncmers.compare_with_edits(d, ranges=ranges).collect()
            assert sorted((str(x.doc_id), x.n_chars, x.edited_sha256) for x in got) == sorted(want)


def test_fingerprints_grow_and_insertions_keep_likeness():
    r = random.Random(7)
    words = lambda n: [f"w{r.randint(0, 10**5)}" for _ in range(n)]
    text = words(1500)
    for n in (1, 2, 4):
        cut = sorted(r.sample(range(1500), n))
        new = [w for a, b in zip([0, *cut], [*cut, 1500], strict=True) for w in [*words(8 * (a > 0)), *text[a:b]]]
        a, b = syncmers.fingerprints(*tb.column_bytes(pa.array([" ".join(text), " ".join(new)])))
        assert syncmers.likeness(a, b) > 0.85
    passage = words(60)
    long = [" ".join([*words(9000), *passage, *words(9000)]) for _ in range(2)]
    a, b = syncmers.fingerprints(*tb.column_bytes(pa.array(long)))
    assert len(a[0]) > 1000 and syncmers.likeness(a, b) > 0


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    import glob

    duckdb = pytest.importorskip("duckdb")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    r = c.sql(queries.SQL[name])
    at = [r.columns.index(x) for x in columns]
    assert sorted(repr([row[x] for x in columns]) for row in df.collect()) == sorted(repr([row[i] for i in at]) for row in r.fetchall())


def test_mix_meets_targets(spark):
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.randint(0, 60)), r.choice(["a", "b", "b", "b", None, "é"])) for i in range(400)]
    got = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, source = {i: len(t.split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    weight = dict(zip(["a", "b", "é", None], [3, 1, 2, 3], strict=True))
    target, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]]:
        for s in over:
            target[s] = 2 * total[s]
            open_.discard(s)
            left -= target[s]
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for x in got:
        assert x.size == size[x.doc_id] and 0 <= x.taken <= 2 * x.size and math.isclose(x.target, target[source[x.doc_id]], rel_tol=1e-9)
        taken[source[x.doc_id]] += x.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    places = [x.position for x in got if x.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1


def test_the_mix_of_many_like_rows(spark):
    rows = [(None, None, "a")] * 300 + [(1, "w w w", "a")] * 50 + [(i, "x y", None) for i in range(20)] + [(7, "", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.plan_mix(d).collect()
    assert len(got) == len(rows) and sum(x.taken for x in got if x.source_size == 150) == round(next(x.target for x in got if x.source_size == 150))
    assert all(x.taken == 0 and x.position is None for x in got if not x.size) and all(x.taken <= 2 * x.size for x in got)
    plan = sum(x.copies + (x.part > 0 and 2 * x.part >= x.size) for x in got)
    assert mixing.apply_mix(d).count() == plan


def test_license_templates(spark):
    d = spark.createDataFrame([(1, "x " * 50 + "Licensed under the (very) Apache License, Version 2.0, and CC BY too"), (2, "under the old version of the general public"), (3, "RELEASED under the MIT license. " * 2)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(d).collect()}
    assert got[1].base_labels == "cc-by" and got[1].first_word == 60 and "cc-by" in got[1].labels
    assert got[2].labels == "" and got[2].score == 0 and got[3].labels == "mit" and got[3].n_notices >= 2 and got[3].score == 1


@needs_data
def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, DATA).cache()
    report = {r.doc_id for r in quality.quality_report(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == report
    texts = {r.doc_id: r.text for r in kept.collect()}
    first = corpus_pipeline.keep_first_of_class(spark, kept, DATA).cache()
    assert {r.doc_id for r in first.select("doc_id").collect()} == {i for i, c in joined(texts).items() if i == c}
    hidden = {r.doc_id: r for r in corpus_pipeline.hide_secrets(spark, first, DATA).collect()}
    assert len(hidden) == first.count()
    for i, r in hidden.items():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text)
        if not secrets.base_spans(texts[i]) and secrets.MARK not in r.text:
            assert r.text == texts[i]
    plan = {r.doc_id: r for r in mixing.plan_mix(first).collect()}
    times = Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, first, DATA).collect())
    assert times == Counter({i: n for i, r in plan.items() if (n := r.copies + (r.part > 0 and 2 * r.part >= r.size))})
    assert zlib.crc32(b"1") % 5 == spark.range(1).select((F.crc32(F.lit("1")) % 5).alias("x")).first().x
