"""Secret scans with a linear-chain conditional random field.

Tokens are tagged B (a secret begins), I (it goes on) or O from their shape,
the words and signs beside them and figures of the whole file. The model is
fitted by gradient ascent on forward-backward expectations, over lines made
from a fixed seed and over a bounded sample of the corpus: the texts of the
``sample_rows`` ids of smallest hash, labelled by the base patterns, of each of
which at most ``sample_windows`` windows of 24 tokens are learned from. Nothing
else is learned from, and only these windows are sent to the driver. Decoding is exact Viterbi. A token whose O emission leads by
more than transitions could ever make up for is O in every best path, so the
chain falls into short independent runs between such tokens, and the runs of
hundreds of texts are decoded together.

Spans of three base patterns always stay; the field adds its spans (kind
``crf``) unless they lie inside a base span. A span of the field that goes on
where a base span ends stays whole, and redaction hides the union. Offsets are code points, ends exclusive.

Edge cases: a null or empty text has no spans. Repeated rows get a row each.
Only the named columns are read, so other columns cannot clash. An empty table
gives an empty result (the model is then fitted on the made lines alone).
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import textbytes as tb

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words beside a secret that the field may look at.
CUES = [*KEYWORDS, "pwd", "pass", "auth", "bearer", "credential", "credentials", "private_key", "client_secret", "access_key", "secret_key", "access_token", "api", "key", "authorization", "apitoken"]
KINDS = ("assign", "access", "hex", "crf")
TOKEN = tb._table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"_+/-", *range(0x80, 0x100)])

_DIGIT, _UPPER, _LOWER = tb._table(range(48, 58)), tb._table(range(65, 91)), tb._table(range(97, 123))
_HEXY, _HIGH = tb._table([*range(48, 58), *range(97, 103)]), tb._table(range(0x80, 0x100))
N_FEATURES = 33
O, B, I = 0, 1, 2
MARK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_CUE_HASHES = np.sort(tb.hash_spans(*(lambda d: (np.frombuffer("".join(d).encode(), np.uint8), *(lambda e: (e - np.array([len(x) for x in d]), e))(np.cumsum([len(x) for x in d]))))(CUES)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first, features as 0 or 1) of the tokens of a block."""
    starts, ends, first = tb.spans(data, offsets, TOKEN)
    n = len(starts)
    x = np.zeros((n, N_FEATURES), np.float32)
    if not n:
        return starts, ends, first, x

    def count(table):
        c = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=c[1:])
        return c, c[ends] - c[starts]

    cd, digits = count(_DIGIT)
    _, upper = count(_UPPER)
    _, lower = count(_LOWER)
    _, hexy = count(_HEXY)
    _, high = count(_HIGH)
    size = ends - starts
    # Changes between a digit and another byte inside a token.
    turn = np.zeros(len(data) + 1, np.int32)
    isdigit = _DIGIT[data]
    turn[2:] = np.cumsum(isdigit[1:] != isdigit[:-1])
    turns = turn[ends] - turn[np.minimum(starts + 1, ends)]
    text = tb.owner(first)
    inside_prev = np.concatenate([[False], text[1:] == text[:-1]])
    inside_next = np.concatenate([text[1:] == text[:-1], [False]])
    before = np.where(starts > offsets[text], data[np.maximum(starts - 1, 0)], 32)
    after = np.where(ends < offsets[text + 1], data[np.minimum(ends, len(data) - 1)], 32)
    quotes = (34, 39)
    mixed = (digits > 0) & (upper + lower > 0) & (size >= 8)
    cue = np.isin(tb.hash_spans(tb.LOWER[data], starts, ends), _CUE_HASHES)
    gap_from = np.concatenate([[0], ends[:-1]])
    signs = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data == 61) | (data == 58), out=signs[1:])
    assigned = inside_prev & (signs[starts] > signs[np.minimum(gap_from, starts)]) & (starts - gap_from <= 6)
    back = lambda v, k=1: np.concatenate([np.zeros(k, v.dtype), v[:-k]]) if len(v) > k else np.zeros(len(v), v.dtype)
    ahead = lambda v: np.concatenate([v[1:], np.zeros(1, v.dtype)])
    blanks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~tb.NOT_SPACE[data], out=blanks[1:])
    # Signs but no blank stand between a token and the one before it.
    glued = inside_prev & (blanks[starts] == blanks[np.minimum(gap_from, starts)])
    length = np.maximum(np.diff(offsets), 1)
    total = tb.per_text(isdigit, offsets) / length
    code = tb.per_text((data == 61) | (data == 123) | (data == 59) | (data == 40), offsets) / length
    columns = [
        np.ones(n, bool), size >= 8, size >= 12, size >= 16, size >= 24, size >= 40,
        digits > 0, digits * 5 >= size, mixed, (hexy == size) & (size >= 8), digits == size, (upper > 0) & (lower > 0) & (digits > 0),
        high > 0, turns >= 3, (upper == size) & (size > 1), (turns >= 6) & (size >= 16),
        inside_prev & back(cue), inside_prev & back(cue, 2) & back(inside_prev), np.isin(before, quotes), np.isin(after, quotes),
        assigned, inside_prev & np.isin(before, (46, 61)) & (starts - gap_from <= 1), inside_prev & back(mixed), inside_next & ahead(mixed),
        glued, ahead(glued), glued & back(assigned) & (size >= 2),
        assigned & back(cue) & (size >= 8), cue, (total >= 0.05)[text], (code >= 0.01)[text], (lower == size) & (size < 16), (upper > 1) & (lower > 1) & (turns == 0) & (size >= 16),
    ]
    for k, c in enumerate(columns):
        x[:, k] = c
    return starts, ends, first, x


@dataclass(frozen=True)
class Field:
    """Weights of labels by features, and of pairs of neighbouring labels."""

    weights: np.ndarray
    moves: np.ndarray

    @property
    def reach(self) -> float:
        """The most that moves can win by tagging a token B or I and not O; after an O, a following I has to turn into B."""
        t, best = self.moves, -1e9
        for p, y, q, r in ((p, y, q, r) for p in range(3) for y in (B, I) for q in range(3) for r in range(3)):
            q2 = B if q == I else q
            if min(t[p, y], t[y, q], t[q, r]) > -1e8:
                best = max(best, t[p, y] + t[y, q] + t[q, r] - t[p, O] - t[O, q2] - t[q2, r] if t[q2, r] > -1e8 else best)
        return float(best)


def viterbi(score: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of many chains laid end to end, chain c being first[c]:first[c + 1]; outside it stand O labels."""
    n = np.diff(first)
    out = np.zeros(len(score), np.int8)
    back = np.zeros((len(score), 3), np.int8)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    now = np.zeros((len(n), 3))
    for t in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -t, "left"))
        at = start[:k] + t
        if t == 0:
            now[:k] = moves[O] + score[at]
            continue
        step = now[:k, :, None] + moves[None]
        back[at] = step.argmax(1)
        now[:k] = step.max(1) + score[at]
    label = (now + moves[:, O]).argmax(1)
    for t in range(int(n[0]) - 1 if len(n) else -1, -1, -1):
        k = int(np.searchsorted(-n, -t, "left"))
        at = start[:k] + t
        out[at] = label[:k]
        label[:k] = back[at, label[:k]]
    return out


def decode(x: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """The best label of every token, exactly as one Viterbi pass over each whole text gives it."""
    out = np.zeros(len(x), np.int8)
    if not len(x):
        return out
    score = x.astype(np.float64) @ field.weights.T
    follow = np.concatenate([np.maximum(score[1:, I] - score[1:, B], 0), [0]])
    sure = score[:, O] - np.maximum(score[:, B], score[:, I]) > field.reach + follow
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return out
    text = tb.owner(first)[open_]
    new = np.ones(len(open_), bool)
    new[1:] = (open_[1:] != open_[:-1] + 1) | (text[1:] != text[:-1])
    out[open_] = viterbi(score[open_], field.moves, np.append(np.flatnonzero(new), len(open_)))
    return out


def train(x: np.ndarray, y: np.ndarray, live: np.ndarray, steps: int = 80, rate: float = 0.5, ridge: float = 1e-3) -> Field:
    """Fits a field to windows: x is (windows, length, features), y labels, live says which places are tokens (a prefix of each)."""
    n, length, f = x.shape
    w, moves = np.zeros((3, f)), np.zeros((3, 3))
    hard = np.zeros((3, 3))
    hard[O, I] = -1e9
    gw2, gm2 = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    one = np.eye(3)[y] * live[..., None]
    pairs = live[:, 1:] & live[:, :-1]
    seen = np.einsum("nlk,nlf->kf", one, x)
    seen_moves = np.einsum("nla,nlb->ab", one[:, :-1] * pairs[..., None], one[:, 1:])
    total = live.sum()
    for _ in range(steps):
        t = moves + hard
        s = x @ w.T
        s[:, 0, I] -= 1e9
        a, b = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        a[:, 0] = s[:, 0]
        for k in range(1, length):
            m = a[:, k - 1, :, None] + t
            top = m.max(1)
            a[:, k] = np.where(live[:, k, None], top + np.log(np.exp(m - top[:, None]).sum(1)) + s[:, k], a[:, k - 1])
        for k in range(length - 2, -1, -1):
            m = t + (s[:, k + 1] + b[:, k + 1])[:, None]
            top = m.max(2)
            b[:, k] = np.where(live[:, k + 1, None], top + np.log(np.exp(m - top[..., None]).sum(2)), 0)
        top = a[:, -1].max(1)
        z = top + np.log(np.exp(a[:, -1] - top[:, None]).sum(1))
        p = np.exp(np.minimum(a + b - z[:, None, None], 0)) * live[..., None]
        q = np.exp(np.minimum(a[:, :-1, :, None] + t + (s[:, 1:] + b[:, 1:])[:, :, None] - z[:, None, None, None], 0)) * pairs[..., None, None]
        gw = (seen - np.einsum("nlk,nlf->kf", p, x)) / total - ridge * w / f
        gm = (seen_moves - q.sum((0, 1))) / total - ridge * moves / 9
        gw2, gm2 = gw2 + gw**2, gm2 + gm**2
        w, moves = w + rate * gw / np.sqrt(gw2), moves + rate * gm / np.sqrt(gm2)
    moves = moves + hard
    return Field(w, moves)


def made_lines(seed: int = 7, n: int = 700) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with and without secrets: (text, spans)."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: some("etaoinshrdlucmf", r.randint(2, 11))
    words = lambda k: " ".join(r.choice([word(), word(), word().capitalize(), word() + ","]) for _ in range(k))
    out = []
    for i in range(n):
        left, right = words(r.randint(3, 9)), words(r.randint(3, 9))
        if i % 2:
            key = r.choice(CUES)
            key = r.choice([key, key.upper(), key.capitalize()])
            kind = r.randint(0, 7)
            secret = [
                lambda: some("0123456789abcdef", r.choice([24, 32, 40, 64])), lambda: some(alnum, r.randint(20, 44)), lambda: some(alnum + "+/", r.randint(24, 48)),
                lambda: ".".join(some(alnum + "_-", k) for k in (r.randint(16, 30), r.randint(24, 60), r.randint(24, 43))),
                lambda: r.choice(["sk", "pk", "ghp", "xoxb"]) + "_" + some(alnum, r.randint(20, 36)), lambda: "AKIA" + some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: some(alnum, r.randint(8, 19)),
                lambda: some("!#$%&*?~^", r.randint(1, 2)).join(some(alnum, r.randint(2, 7)) + some("0123456789", k) for k in (0, 0, r.randint(1, 2))),
            ][kind]()
            sign, quote = r.choice([" = ", "=", ": ", ":", " := ", " "]), r.choice(["", '"', "'"])
            if kind in (1, 2, 3, 4, 5) and r.random() < 0.3:
                key, sign = word(), " "
            head = f"{left} {key}{sign}{quote}"
            out.append((f"{head}{secret}{quote} {right}", [(len(head), len(head) + len(secret))]))
        else:
            plain = r.choice([
                lambda: r.choice(CUES) + r.choice([" is ", ": ", " of ", " = "]) + words(2), lambda: some("0123456789", r.randint(4, 16)), lambda: f"+1 ({some('0123456789', 3)}) {some('0123456789', 3)}-{some('0123456789', 4)}",
                lambda: f"{word()}.{word()}{some('0123456789', 2)}@mail{some('0123456789', 1)}.example.com", lambda: f"https://{word()}.example.org/{word()}/{word()}-{word()}?id={some('0123456789', 5)}",
                lambda: some("etaoinshrdlucmf", r.randint(18, 30)), lambda: f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
                lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:00", lambda: word().capitalize() + word().capitalize() + word().capitalize(), lambda: f"{word()}_{word()}_{r.randint(1, 99)}", lambda: some("#*$%&|<>=-", 8),
                lambda: "-".join(word() for _ in range(5)), lambda: "/".join(word() for _ in range(5)),
            ])()
            out.append((f"{left} {plain} {right}", []))
    return out


Window = tuple[np.ndarray, np.ndarray]


def windows(text: str, secrets: list[tuple[int, int]], number: int, size: int = 24, others: int = 2, most: int | None = None) -> list[Window]:
    """(features, labels) of stretches of tokens about each secret, and of some others; at most ``most`` of them, evenly taken."""
    data, offsets = tb.column_bytes(pa.array([text]))
    s, e, _, x = features(data, offsets)
    if not len(s):
        return []
    y = np.zeros(len(s), np.int64)
    at = []
    for a, b in secrets:
        a, b = len(text[:a].encode()), len(text[:b].encode())
        own = np.flatnonzero((s < b) & (e > a))
        if len(own):
            y[own], y[own[0]] = I, B
            at.append(max(0, int(own[0]) - size // 2))
    at += [int(z) for z in np.random.default_rng(number).integers(0, max(1, len(s) - size), others)]
    if most is not None and len(at) > most:
        at = [at[k * len(at) // most] for k in range(most)]
    # A window that would begin inside a secret begins where the secret does.
    starts = []
    for a in at:
        while y[a] == I:
            a -= 1
        starts.append(a)
    return [(x[a : a + size], y[a : a + size]) for a in starts]


def labelled(text: str) -> list[tuple[int, int]]:
    """What the base patterns call secrets: values of assignments, keys, and hex strings that are not plain numbers."""
    spans = []
    for start, kind, end in base_spans(text):
        if kind == 0:
            m = ASSIGN.match(text, start)
            spans.append((m.start(2), m.end(2)))
        elif kind == 1 or not text[start:end].isdigit():
            spans.append((start, end))
    return spans


def fit(sample: list[Window] | None = None, steps: int = 80) -> Field:
    """The field for made lines and sampled windows."""
    pairs = [w for k, (t, spans) in enumerate(made_lines()) for w in windows(t, spans, k)] + list(sample or ())
    length = max(len(y) for _, y in pairs)
    x, y, live = np.zeros((len(pairs), length, N_FEATURES)), np.zeros((len(pairs), length), np.int64), np.zeros((len(pairs), length), bool)
    for k, (a, b) in enumerate(pairs):
        x[k, : len(a)], y[k, : len(b)], live[k, : len(b)] = a, b, True
    return train(x, y, live, steps)


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 256, sample_windows: int = 6) -> Field:
    """Fits on at most sample_windows windows of each of the sample_rows ids of smallest hash. Texts stay in the tasks; an id with several has the one of smallest hash."""
    ids = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).select(F.xxhash64("id").alias("h"), "text")

    def run(batches):
        for b in batches:
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = windows(text, labelled(text), h & 0xFFFFFFFF, most=sample_windows)
                xs, ys = [w[0].astype(np.uint8).tobytes() for w in got], [w[1].astype(np.uint8).tobytes() for w in got]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(got), pa.int64()), pa.array(range(len(got)), pa.int32()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["h", "k", "x", "y"])

    got = sorted(rows.mapInArrow(run, "h long, k int, x binary, y binary").collect(), key=lambda r: (r.h, r.k))
    return fit([(np.frombuffer(r.x, np.uint8).reshape(-1, N_FEATURES), np.frombuffer(r.y, np.uint8)) for r in got])


def find(texts: list[str], data: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, index of kind, end) of all spans of each text of a block, sorted."""
    out = [base_spans(t) for t in texts]
    starts, ends, first, x = features(data, offsets)
    label = decode(x, first, field)
    begin = np.flatnonzero(label == B)
    if len(begin):
        text = tb.owner(first)
        stop = np.append(np.flatnonzero(label != I), len(label))
        last = stop[np.searchsorted(stop, begin, "right")] - 1
        # Code points before each byte, counted once for the block.
        points = np.concatenate([[0], np.cumsum(tb.LEAD[data])])
        low = points[offsets[text[begin]]]
        inside: dict[int, tuple[list[int], list[int]]] = {}
        added = []
        for d, s, e in zip(text[begin].tolist(), (points[starts[begin]] - low).tolist(), (points[ends[last]] - low).tolist(), strict=True):
            if d not in inside:
                inside[d] = [x[0] for x in out[d]], list(accumulate((x[2] for x in out[d]), max))
            begins, reach = inside[d]
            # Of the base spans that begin here or before, the one that reaches furthest tells whether any holds this span.
            k = bisect_right(begins, s)
            if not k or reach[k - 1] < e:
                added.append((d, (s, 3, e)))
        for d, span in added:
            out[d].append(span)
    return [sorted(x) for x in out]


def _blocks(batch: pa.RecordBatch, column: int, field: Field):
    data, offsets = tb.column_bytes(batch.column(column))
    for i, j in tb.blocks(offsets, tb.BLOCK_BYTES // 2):
        texts = [t or "" for t in batch.column(column).slice(i, j - i).to_pylist()]
        yield i, j, texts, find(texts, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], field)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row per row of docs: counts of the base kinds, the digest of the base spans, and all spans."""
    tb.bound_batches(docs.sparkSession)
    field = field or fit_on(docs, id_col, text_col)

    def run(batches):
        for b in batches:
            for i, j, _, found in _blocks(b, 1, field):
                written = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in x] for x in found]
                base = [",".join(w for w, (_, k, _) in zip(ws, x, strict=True) if k < 3) for ws, x in zip(written, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), *(pa.array([sum(k == want for _, k, _ in x) for x in found], pa.int64()) for want in range(3)), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array([",".join(w) for w in written])],
                    names=names,
                )

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by a mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, _, e in sorted(found):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], MARK]
        at = e
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", field: Field | None = None) -> DataFrame:
    """docs with every secret replaced by a mark, and the length in code points renewed; null texts stay null."""
    tb.bound_batches(docs.sparkSession)
    field = field or fit_on(docs, id_col, text_col)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches):
        for b in batches:
            for i, j, texts, found in _blocks(b, at, field):
                part = b.slice(i, j - i)
                if not any(found):
                    yield part
                    continue
                null = part.column(at).is_null().to_pylist()
                new = [None if z else redact(t, x) for t, x, z in zip(texts, found, null, strict=True)]
                cols = list(part.columns)
                cols[at] = pa.array(new, cols[at].type)
                if length_at is not None:
                    old = cols[length_at].to_pylist()
                    cols[length_at] = pa.array([len(t) if x else o for t, x, o in zip(new, found, old, strict=True)], cols[length_at].type)
                yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
