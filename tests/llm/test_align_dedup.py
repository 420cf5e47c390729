"""Cross-tokenizer alignment and exact duplicates against brute force, and their edge cases."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import exactdedup, tokenalign
from textloom.llm.pieces import public_model

TEXTS = [
    None, "", " ", "a  b", "\n x \t", "plain words of a sentence, repeated words of a sentence", "one▁two", "naïve 漢字 😀 ẞß", "<|endoftext|> <s></s><unk>", "x" * 3000, "\x00 y\x1c z", "tab\tand\nlines\r\n  indented   code()",
    "　wide space", "don't they're we'll", "1234567890 3.14159 1e-9", "a " * 500, "hello hello hello", "ﬁ ﬂ ½ ② Ⅷ", "é combining", "trailing ",
]


def made(n, seed):
    r = random.Random(seed)
    signs = [*"abcdefghijklmnopqrstuvwxyz' .,!?-\n\t0123456789", "é", "漢", "😀", "  ", " the ", "tion"]
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 200))) for _ in range(n)]


def naive(rows):
    """Rows of op12 by tokenizer libraries and plain loops."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_model(tokenalign.BYTE_MODEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_model())
    entry = {i: t for t, i in a.get_vocab().items()}
    byte = tokenalign.byte_of_sign()
    bytes_a = lambda i: bytes(byte[c] for c in entry[i])
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for k, text in rows:
        text = text or ""
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        if not text or b"".join(map(bytes_a, x)) != f" {text}".encode() or b"".join(map(bytes_b, y)) != f" {text}".encode():
            docs.append((k, [], [], [], []))
            continue
        spans = []
        for ids, of in ((x, bytes_a), (y, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at := at + len(of(i))))
            spans.append(own)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (t, f) in enumerate(spans[1]) if max(s, t) < min(e, f)]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([x[i] for i, (s, e) in enumerate(spans[0]) if lo < e <= hi], [y[j] for j, (s, e) in enumerate(spans[1]) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        counts.update((x[i], y[j]) for i, j in links)
        docs.append((k, x, y, groups, [(x[i], y[j]) for i, j in links]))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    said = lambda ids: ",".join(map(str, ids))
    sha = lambda g: hashlib.sha256(";".join(f"{said(p)}|{said(q)}" for p, q in g).encode()).hexdigest() if g else ""
    return sorted((k, len(x), len(y), len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha(g)) for k, x, y, g, ls in docs)


def test_alignment_equals_brute_force(spark):
    rows = list(enumerate([*TEXTS, *made(60, 1), *TEXTS[5:8]]))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in ("block", "id", "n_a", "pair", "count")})
    got = tokenalign.align(d, public_model(tokenalign.BYTE_MODEL), public_model(), block_bytes=700).collect()
    assert sorted(map(tuple, got)) == naive(rows)


def test_alignment_of_empty_and_odd_tables(spark):
    d = spark.createDataFrame([("k", "a b"), (None, None), ("k", "a b")], "doc_id string, text string")
    models = public_model(tokenalign.BYTE_MODEL), public_model()
    got = sorted(tokenalign.align(d, *models, with_groups=True).collect(), key=repr)
    assert [r.n_a for r in got] == [2, 2, 0] and got[0] == got[1] and [tuple(g) for g in got[0].groups] == [(1, 1), (2, 2)] and got[2].groups == []
    assert tokenalign.align(d.limit(0), *models).collect() == []
    assert [r.n_links for r in tokenalign.align(d.where("doc_id is null"), *models).collect()] == [0]


def test_runs_of_random_ends():
    r = np.random.default_rng(1)
    for _ in range(600):
        top, share, lost = int(r.integers(1, 4000)), r.choice([0.002, 0.1, 0.9]), r.choice([0, 0.01, 0.5])
        ends = np.unique(np.append(r.integers(1, top + 1, int(top * share)), top))
        a, b = (np.unique(np.append(ends[r.random(len(ends)) >= q], top)) for q in (lost, lost / 3))
        la, lb, ga, gb = tokenalign.spread(*tokenalign.runs(a, b))
        all_ends, common = np.union1d(a, b), np.intersect1d(a, b)
        assert sorted(zip(la, lb, strict=True)) == list(zip(np.searchsorted(a, all_ends), np.searchsorted(b, all_ends), strict=True))
        assert np.array_equal(a[ga - 1], common) and np.array_equal(b[gb - 1], common)


def test_both_libraries_give_the_same_ids():
    pair = tokenalign.Pair(public_model(tokenalign.BYTE_MODEL), public_model())
    other = tokenalign.Pair._by_file(public_model(tokenalign.BYTE_MODEL))
    signs = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x1F000, 0x1FB00)]
    texts = [f" a{c}b 1{c}2 {c} !{c}! {c}{c}" for c in signs] + made(500, 2) + [t or "" for t in TEXTS]
    assert pair.encode_a(texts) == [list(x) for x in other(texts)]
    # Words apart give what whole texts give.
    texts = [t or "" for t in TEXTS] + made(500, 3)
    (a, at), (b, bt) = pair.encode(texts)
    assert [a[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == pair.encode_a([f" {t}" for t in texts])
    assert [b[i:j].tolist() for i, j in zip(bt[:-1], bt[1:], strict=True)] == pair.b.encode(texts)


DUPLICATES = [(1, "x"), (2, "x"), (5, "x"), (5, "x"), (3, None), (4, ""), (None, "y"), (None, "y"), (9, "z"), (None, "z"), (7, "long " * 5000), (8, "long " * 5000), (6, "long " * 4999 + "lung ")]


def by_hand(rows):
    of = defaultdict(list)
    for k, t in rows:
        of[t or ""].append(k)
    out = []
    for t, ids in of.items():
        keep = max((k for k in ids if k is not None), default=None)
        kept = False
        for k in ids:
            out.append((k, keep, len(ids), k == keep and not kept, hashlib.sha256(t.encode()).hexdigest()))
            kept |= k == keep
    return sorted(out, key=repr)


#: A digest of two values, one without any information, and the real one: results must be the same.
@pytest.mark.parametrize("digest", [exactdedup.sha256, lambda t: F.left(F.sha2(t, 256), F.lit(1)), lambda t: F.lit("same")])
def test_duplicates(spark, digest):
    r = random.Random(4)
    rows = DUPLICATES + [(100 + k, r.choice(["p", "q", "r" * 400, f"own {k}"])) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).withColumns({c: F.lit(1) for c in ("id", "key", "size", "keep", "salt", "m")})
    got = exactdedup.mark_duplicates(d, digest=digest, salts=3)
    texts = d.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).distinct()
    if digest is exactdedup.sha256:
        assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, bytes(x.text_key).hex()) for x in got.collect()), key=repr) == by_hand(rows)
    else:
        assert sorted([(x.doc_id, x.keep_id, x.group_size, x.kept) for x in got.collect()], key=repr) == sorted([x[:4] for x in by_hand(rows)], key=repr)
    assert texts.count() >= exactdedup.combine(d, digest=digest).count() == len({t or "" for _, t in rows})


def test_dropped_and_normalised(spark):
    d = spark.createDataFrame(DUPLICATES, "doc_id long, text string").withColumns({"size": F.lit("s"), "keep": F.lit("k")})
    got = exactdedup.drop_duplicates(d)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr) == sorted({(k, t) for k, t in [(5, "x"), (4, ""), (None, "y"), (9, "z"), (8, "long " * 5000), (6, "long " * 4999 + "lung ")]}, key=repr)
    mixed = spark.createDataFrame([("a", "X"), ("b", "x")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id) for r in exactdedup.mark_duplicates(mixed, normalise=F.lower).collect()} == {("a", "b"), ("b", "b")}
    assert exactdedup.mark_duplicates(d.limit(0)).collect() == [] and exactdedup.drop_duplicates(d.limit(0)).collect() == []


def test_queries_read_all_rows(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = exactdedup.op13_exact_dedup(spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows)
    assert sorted(map(tuple, tokenalign.op12_token_alignment(spark, folder).collect()))[:40] == naive_whole(rows)[:40]


def naive_whole(rows):
    """naive over whole texts is quadratic a text: links of long ones come from sorted ends instead."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_model(tokenalign.BYTE_MODEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_model())
    pair = tokenalign.tokenizers_of(public_model(tokenalign.BYTE_MODEL), public_model())
    counts, docs = Counter(), []
    for k, t in rows:
        x, y = a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t)
        ea, eb = np.cumsum(pair.size_a[x]), np.cumsum(pair.size_b[y])
        if not t or "▁" in t:
            docs.append((k, [], [], [], []))
            continue
        both = np.union1d(ea, eb)
        links = [(x[i], y[j]) for i, j in zip(np.searchsorted(ea, both), np.searchsorted(eb, both), strict=True)]
        counts.update(links)
        at = np.intersect1d(ea, eb)
        ia, ib = [0, *(np.searchsorted(ea, at) + 1)], [0, *(np.searchsorted(eb, at) + 1)]
        docs.append((k, x, y, [(x[ia[g] : ia[g + 1]], y[ib[g] : ib[g + 1]]) for g in range(len(at))], links))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    said = lambda ids: ",".join(map(str, ids))
    sha = lambda g: hashlib.sha256(";".join(f"{said(p)}|{said(q)}" for p, q in g).encode()).hexdigest() if g else ""
    return sorted((k, len(x), len(y), len(g), len(ls), sum(counts[p] == most[p[1]] for p in ls), sum(counts[p] for p in ls), sha(g)) for k, x, y, g, ls in docs)
