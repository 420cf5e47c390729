"""Cross-tokenizer alignment by diagonal run skipping.

Two tokenizers, A (byte-level BPE) and B (SentencePiece), cut the same bytes.
The arrays of their tokens' ends are walked together. While both tokens of a
pair end at the same byte the walk goes along a diagonal, at a fixed shift
between the two indexes; the length of such a run is found by exponential
probing, that is by comparing ever longer slices of the two arrays and halving
the last one. Where ends differ, the group is resolved token by token until
both end together, and the shift becomes what it is then.

A task works on blocks of texts of bounded size. A block gives a row for each
document, with its different id pairs as codes, and one row with the block's
different pairs and their counts, so that only sums travel: counts of pairs
are added up over the corpus, and each block gets back those of its own pairs.
The highest count of a B id is a table of one row a B id at most.

A's vocabulary runs in the library that goes by ranks, which gives the same ids
as the file's own library where ids are in the order of merges (tests compare
them). The pieces of a block's texts between single spaces are encoded once each:
no token of either goes on from another sign to a space. Texts with other white
space beside a space are encoded whole.

Edge cases: a null or empty text has no tokens; nor has one whose bytes are
not what either tokenizer's tokens join to, as where a text holds U+2581.
Without tokens all numbers are 0 and groups_sha256 is the empty string.
Repeated rows get a row each and count each time. Only the two named columns
are read, so other columns cannot clash. An empty table gives an empty result.
Texts are read whole, however long: one of more than the block size is a block
of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import scratch
from textloom.llm import textbytes as tb
from textloom.llm.pieces import public_model

BYTE_MODEL = "byte_bpe_50k.json"
#: Bytes of the texts of a block. A token of one byte takes about 150 bytes of a worker's memory.
BLOCK = 2_000_000
MARK = "\u2581"
#: Fixed value: where byte-level tokenizers of this family cut texts before they merge bytes.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def runs(a: np.ndarray, b: np.ndarray) -> tuple[array, array, array]:
    """The alignment of two arrays of ends that have the same last end.

    Returns steps, a flat array of (length of a diagonal run, number of A tokens, number of B tokens of the irregular
    group that follows, 0 and 0 where none does), and the links of irregular groups as two arrays of indexes.
    """
    steps, left, right = array("q"), array("q"), array("q")
    # Bound once: the walk takes millions of steps a block.
    add_step, add_left, add_right = steps.append, left.append, right.append
    n, i, j = len(a), 0, 0
    # Unequal signs past the ends stop every comparison.
    a, b = [*a.tolist(), -1], [*b.tolist(), -2]
    while i < n:
        start, near = i, i + 8
        # Along the diagonal: eight pairs one by one, then slices of 8, 16, 32, ... while they are equal, then halves of the one that is not.
        while a[i] == b[j]:
            i += 1
            j += 1
            if i == near:
                size = 8
                while a[i : i + size] == b[j : j + size]:
                    i, j, size = i + size, j + size, size * 2
                while size := size // 2:
                    if a[i : i + size] == b[j : j + size]:
                        i, j = i + size, j + size
        add_step(i - start)
        if i == n:
            add_step(0)
            add_step(0)
            break
        # Token by token until both end together: that shift holds from here on.
        x, y = a[i], b[j]
        start, first = i, j
        add_left(i)
        add_right(j)
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
            add_left(i)
            add_right(j)
        i += 1
        j += 1
        add_step(i - start)
        add_step(j - first)
    return steps, left, right


def spread(steps: array, left: array, right: array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links' indexes in a, in b, groups' past-last indexes in a, in b), groups in order, of what runs gives."""
    s = np.frombuffer(steps, np.int64).reshape(-1, 3) if len(steps) else np.zeros((0, 3), np.int64)
    length, odd = s[:, 0], s[:, 1] > 0
    # Tokens of each group: one of each kind along a run, then the irregular group's.
    groups = length + odd
    at = np.cumsum(groups)[odd] - 1
    size_a, size_b = np.ones(groups.sum(), np.int64), np.ones(groups.sum(), np.int64)
    size_a[at], size_b[at] = s[odd, 1], s[odd, 2]
    ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
    straight = np.ones(len(size_a), bool)
    straight[at] = False
    return np.concatenate([ends_a[straight] - 1, np.frombuffer(left, np.int64)]), np.concatenate([ends_b[straight] - 1, np.frombuffer(right, np.int64)]), ends_a, ends_b


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Entries of a table end to end, one for each of which; entry k lies at start[k] in flat and has size[k] places."""
    n = size[which]
    return flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, first) of a list for each text."""
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
    return np.fromiter(chain.from_iterable(lists), np.int64, first[-1]), first


class Pair:
    """Both tokenizers, their tokens' bytes, and the names that the digest of groups is made of."""

    def __init__(self, byte_model: str, piece_model: str):
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        with open(byte_model, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        byte = byte_of_sign()
        self.bytes_a = [b""] * (max(spec["vocab"].values(), default=-1) + 1)
        for entry, i in spec["vocab"].items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        self.encode_a = self._ranked(spec) or self._by_file(byte_model)
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # Pieces of a text between spaces are encoded apart if no token goes on from another sign to a space.
        self.apart = not any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(n) if not (self.b.is_control(i) or self.b.is_unknown(i)))
        # A token with the sign that follows it: A's go on with a comma or end their side, B's go on or end the group.
        self.parts = np.array([f"{i}{sign}" for size, signs in ((len(self.bytes_a), ",|"), (n, ",;")) for sign in signs for i in range(size)], object)
        self.flat = [(np.frombuffer(b"".join(t), np.uint8), np.cumsum(size) - size) for t, size in ((self.bytes_a, self.size_a), (self.bytes_b, self.size_b))]

    def _ranked(self, spec: dict):
        """The model's own vocabulary in the faster of two libraries, where ids are in the order of merges, which is what it goes by; else None."""
        first = len(spec["vocab"]) - len(spec["merges"])
        merged = ("".join(m if isinstance(m, list) else m.split(" ", 1)) for m in spec["merges"])
        if first < 256 or any(spec["vocab"].get(m) != first + k for k, m in enumerate(merged)):
            return None
        import tiktoken

        own = {t: i for i, t in enumerate(self.bytes_a) if i < first + len(spec["merges"])}
        coder = tiktoken.Encoding("byte_level", pat_str=BYTE_LEVEL, mergeable_ranks=own, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]

    @staticmethod
    def _by_file(byte_model: str):
        # Spark's tasks fill the cores already; the library reads this at its first batch.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(byte_model)
        coder.encode_special_tokens = True
        return lambda texts: [x.ids for x in coder.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1) if texts else []

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and for B: (ids of all texts, first), without regard to what they join to; first[d]:first[d + 1] are those of text d."""
        if not self.apart:
            return [_flat(f(x)) for f, x in ((self.encode_a, [f" {t}" for t in texts]), (self.encode_b, texts))]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, code, first = coded.dictionary.to_pylist(), coded.indices.to_numpy(), split.offsets.to_numpy()
        bare = np.array([not w or w.strip() != w for w in words], bool)
        whole = np.flatnonzero(tb.per_text(bare[code], first))
        out = []
        for f, own, full in ((self.encode_a, [f" {w}" for w in words], [f" {texts[d]}" for d in whole]), (self.encode_b, words, [texts[d] for d in whole])):
            # Texts to be encoded whole are words of their own, which stand in their place.
            ids, at = _flat(f(own) + f(full))
            plain = np.ones(len(texts), bool)
            plain[whole] = False
            count = np.where(plain, np.diff(first), 1)
            start = np.concatenate([[0], np.cumsum(count)])
            word = np.empty(start[-1], np.int64)
            word[start[whole]] = len(words) + np.arange(len(whole))
            word[np.repeat(plain, count)] = code[np.repeat(plain, np.diff(first))]
            size = np.diff(at)
            out.append((gather(ids, at[:-1], size, word), np.concatenate([[0], np.cumsum(size[word])])[start]))
        return out

    def like(self, side: int, ids: np.ndarray, first: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, whether its tokens join to its bytes."""
        (flat, start), size = self.flat[side], (self.size_a, self.size_b)[side]
        same = tb.per_text(size[ids], first) == np.diff(offsets)
        # Byte by byte for texts of the right size only.
        own = ids[np.repeat(same, np.diff(first))]
        got = gather(flat, start, size, own)
        wrong = np.concatenate([[0], np.cumsum(got != data[np.repeat(same, np.diff(offsets))])])
        edge = np.concatenate([[0], np.cumsum(np.where(same, np.diff(offsets), 0))])
        return same & (wrong[edge[1:]] == wrong[edge[:-1]])


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin-1 signs are themselves, the rest come in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


_pairs: dict[tuple[str, str], Pair] = {}


def tokenizers_of(byte_model: str, piece_model: str) -> Pair:
    """Both tokenizers, loaded once in each process."""
    if (key := (byte_model, piece_model)) not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


class Aligned:
    """A block's alignment. a, b: ids, of text d in first_a[d]:first_a[d + 1] and so on; link_a, link_b and group_a,
    group_b (past-last) are indexes of them. Texts without tokens have none of these."""

    def __init__(self, pair: Pair, texts: list[str]):
        data, offsets = tb.column_bytes(pa.array([f" {t}" if t else "" for t in texts], pa.large_string()))
        both = pair.encode(texts)
        good = (offsets[1:] > offsets[:-1]) & pair.like(0, *both[0], data, offsets) & pair.like(1, *both[1], data, offsets)
        (self.a, self.first_a), (self.b, self.first_b) = ((ids[np.repeat(good, np.diff(first))], np.concatenate([[0], np.cumsum(np.where(good, np.diff(first), 0))])) for ids, first in both)
        # The texts lie end to end. Both tokenizers end where a text does, so that no group and no link goes on into the next.
        walked = runs(np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b]))
        self.link_a, self.link_b, self.group_a, self.group_b = spread(*walked)
        self.first_group = np.searchsorted(self.group_a, self.first_a, "right")

    def groups_sha256(self, pair: Pair) -> list[str]:
        """The digest of ``a1,a2|b1;a3|b2,b3`` for each text, the empty string where it has no tokens."""
        na, nb = len(self.a), len(self.b)
        part_a, part_b = self.a.copy(), self.b + 2 * pair.size_a.size
        part_a[self.group_a - 1] += pair.size_a.size
        part_b[self.group_b - 1] += pair.size_b.size
        out = np.empty(na + nb, np.int64)
        # An A token stands after the B tokens of the groups before its own, a B token after the A tokens up to its own group's end.
        before = np.concatenate([[0], self.group_b])[: len(self.group_b)]
        out[np.arange(na) + np.repeat(before, np.diff(self.group_a, prepend=0))] = part_a
        out[np.arange(nb) + np.repeat(self.group_a, np.diff(self.group_b, prepend=0))] = part_b
        parts, at = pair.parts[out].tolist(), (self.first_a + self.first_b).tolist()
        return [hashlib.sha256("".join(parts[i:j])[:-1].encode()).hexdigest() if i < j else "" for i, j in zip(at[:-1], at[1:], strict=True)]


def _blocks(batches, limit: int):
    """Lists of ids and of texts, of whole texts of about so many bytes of UTF-8 together."""
    ids, texts, size = [], [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for k, t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lengths, strict=True):
            if texts and size + n > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(k)
            texts.append(t or "")
            size += n
    if texts:
        yield ids, texts


def _encode(docs: DataFrame, byte_model: str, piece_model: str, limit: int, with_groups: bool) -> DataFrame:
    """A row per document and one per block (is_block), with the id pairs that they hold: codes, counts and, for blocks, pairs."""
    kind = docs.schema[0].dataType.simpleString()

    def run(batches):
        pair = tokenizers_of(byte_model, piece_model)
        width, at = len(pair.bytes_b), TaskContext.get()
        number = at.partitionId() << 32
        for ids, texts in _blocks(batches, limit):
            x, n = Aligned(pair, texts), len(texts)
            coded = pa.array(x.a[x.link_a] * width + x.b[x.link_b]).dictionary_encode()
            pairs, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy().astype(np.int64)
            counts = np.bincount(codes, minlength=len(pairs))
            # Each document's different codes, in order, as differences: small numbers, which compress well.
            owner, size = np.searchsorted(x.first_a, x.link_a, "right") - 1, max(len(pairs), 1)
            own, times = np.unique(owner * size + codes, return_counts=True)
            doc, code = own // size, own % size
            numbers = [np.diff(x.first_a), np.diff(x.first_b), np.diff(x.first_group), np.bincount(owner, minlength=n)]
            first = np.searchsorted(doc, np.arange(n + 1))
            gap = np.diff(code, prepend=0)
            gap[first[:-1][first[:-1] < len(code)]] = code[first[:-1][first[:-1] < len(code)]]
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v, t))
            groups = pa.nulls(n, group_type)
            if with_groups:
                local = [v - np.repeat(f[:-1], np.diff(x.first_group)) for v, f in ((x.group_a, x.first_a), (x.group_b, x.first_b))]
                groups = pa.ListArray.from_arrays(pa.array(x.first_group, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in local], ["a", "b"]))
            yield pa.RecordBatch.from_arrays([
                pa.array([number] * n, pa.int64()), pa.array([False] * n), pa.array(ids, id_type), *[pa.array(v, pa.int64()) for v in numbers], pa.array(x.groups_sha256(pair), pa.string()), groups,
                lists(gap, pa.int32()), lists(times, pa.int32()), pa.nulls(n, pa.list_(pa.int64())),
            ], names=names)
            one = lambda v, t: pa.array([v], pa.list_(t))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([True]), pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, group_type), pa.nulls(1, pa.list_(pa.int32())), one(counts, pa.int32()), one(pairs, pa.int64())], names=names)
            number += 1

    from pyspark.sql.pandas.types import to_arrow_type

    id_type, group_type = to_arrow_type(docs.schema[0].dataType), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    names = ["block", "is_block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "gaps", "times", "pairs"]
    return docs.mapInArrow(run, f"block long, is_block boolean, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<struct<a:int,b:int>>, gaps array<int>, times array<int>, pairs array<long>")


def pair_counts(encoded: DataFrame, width: int) -> DataFrame:
    """pair, count and best (whether no pair of its B id has more) over the corpus."""
    own = encoded.where("is_block").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = own.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    # One row a B id: as many as the tokenizer has pieces, whatever the corpus.
    most = F.broadcast(counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("most")))
    return counts.join(most, F.col("pair") % width == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_model: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, block_bytes: int = BLOCK) -> DataFrame:
    """Per row of docs: its id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, on demand, groups: the past-last indexes of each group's tokens."""
    import sentencepiece

    tb.bound_batches(docs.sparkSession)
    width = sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()
    encoded = scratch.write(_encode(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), byte_model, piece_model, block_bytes, with_groups))
    counts = scratch.write(pair_counts(encoded, width))
    asked = encoded.where("is_block").select("block", F.posexplode("pairs").alias("code", "own"))
    known = asked.join(counts, F.col("own") == F.col("pair")).select(F.col("block").alias("of"), "code", "count", "best")
    rows = encoded.where("not is_block").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "gaps", "times")

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        code = right.column("code").to_numpy()
        count[code], best[code] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        gaps, times = left.column("gaps").combine_chunks(), left.column("times").combine_chunks()
        first = gaps.offsets.to_numpy().astype(np.int64)
        total, n = np.cumsum(gaps.values.to_numpy(), dtype=np.int64), times.values.to_numpy().astype(np.int64)
        # Codes are running sums of gaps that begin anew in each document.
        before = np.concatenate([[0], total])[first[:-1]]
        codes = total[first[0] : first[-1]] - np.repeat(before, np.diff(first))
        n, first = n[first[0] : first[-1]], first - first[0]
        sums = [tb.per_text(n * x[codes], first) for x in (best, count)] if size else [np.zeros(left.num_rows, np.int64)] * 2
        kept = [left.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.table([*kept, pa.array(sums[0]), pa.array(sums[1]), left.column("groups_sha256"), left.column("groups")], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(add, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups array<struct<a:int,b:int>>")
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * with_groups)


def op12_token_alignment(spark, sf_dir: str, byte_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_model or public_model(BYTE_MODEL), piece_model or public_model())
