"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is a set of shingles of five words, each weighted by 1 + ln(count). A
shingle draws, from its own hash, the arrivals of a Poisson process of its
weight as rate; each arrival falls on one of the sketch's components and a
component keeps the shingle that arrives first. A shingle stops as soon as its
next arrival is later than every component's first. The chance that two
sketches agree in a component is the probability Jaccard similarity; for equal
weights that is the Jaccard similarity.

Each text has a second, plain sketch whose shingles all weigh 1, so that its
agreement is the Jaccard similarity whatever the counts. Texts whose sketches
agree in a band of either are candidates: at a Jaccard similarity of 0.8 two
plain sketches share none of their bands with a probability of 2e-9. A pair is linked if the
exact Jaccard similarity of its sets of shingles is ``threshold`` or more, and
classes are the connected components of the links; the class id is the
smallest id in it.

Scale and skew: exact copies are first reduced to one representative. In a
bucket, members are verified against one pivot instead of each other. Buckets
whose members still lie in different components go on with new pivots as long
as that finds links. What is then left open, such as large groups that stay
just under the threshold, is settled exactly by a prefix-filtered similarity
join: two sets that are similar enough share one of their few rarest shingles,
and pairs of different components that do are verified. Shingles are ordered
by the exact number of open texts that hold them, those of one text alone are
in no pair, and of the component that holds a shingle most often no two
members are paired. So no link between members of a bucket is lost, and pairs
within a class of thousands are never listed. Nothing is collected but counts;
lineage is cut by tables in the shared folder, which are removed once the
classes are written.

Edge cases: null counts as empty. Texts of one to four words are one shingle;
texts without words are only like exact copies. Rows of one id are one
document; if their texts differ, the text of smallest SHA-256 stands for all
of them. Rows with a null id are compared with none and have a null class.
Only the two named columns are read, so other columns cannot clash. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import scratch
from textloom.llm import textbytes as tb

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 8
#: Rounds of pivots at most; a round that links less than this part of what is open is the last.
ROUNDS, WORTH = 8, 0.02
#: Components of the plain sketch, in which all shingles weigh the same: whatever their counts, the chance that two agree in one is the Jaccard similarity.
PLAIN_BANDS, PLAIN_ROWS = 51, 5
COMPONENTS = max(BANDS * ROWS, PLAIN_BANDS * PLAIN_ROWS)
#: A pair whose plain sketches agree in a part of their components that is smaller than the threshold by more than this is
#: far from any link: at a similarity of 0.8 a link falls short once in 100 billion, at any other once in 500 million at most.
MARGIN = 0.2
_SALT = np.uint64(0xA0761D6478BD642F)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of a block's texts."""
    data = tb.LOWER[data]
    starts, ends, first = tb.spans(data, offsets, tb.WORD)
    gram, _, gf = tb.grams(tb.hash_spans(data, starts, ends), first, k, whole_if_short=True)
    text = tb.owner(gf)
    order, new = tb.same_groups(tb.mix(gram ^ tb.mix(text.astype(np.uint64) + np.uint64(1))))
    at = np.flatnonzero(new)
    return text[order][at], gram[order][at], np.diff(np.append(at, len(order)))


def weights(count: np.ndarray) -> np.ndarray:
    return 1 + np.log(count)


def sketch(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """(n, m): for each text and component, the shingle that arrives first. Texts without shingles have zeros."""
    q, e = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    state, s, w, d, h = shingle, shingle, weight, text, np.zeros(len(shingle))
    last, turn = np.full(n, np.inf), 0
    while len(s):
        state = tb.mix(state + tb._GOLD)
        component = ((state >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        u = ((tb.mix(state ^ _SALT) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        h = h - np.log(u) / w
        key = d * m + component.astype(np.int64)
        np.minimum.at(q, key, h)
        won = q[key] == h
        e[key[won]] = s[won]
        turn += 1
        # Arrivals after all components have their first change nothing, so it does to look for the end now and then.
        if turn < 3 or turn % 8 == 0:
            live = np.zeros(n, bool)
            live[d] = True
            live = np.flatnonzero(live)
            last[live] = q.reshape(n, m)[live].max(1)
            go = h < last[d]
            state, s, w, d, h = state[go], s[go], w[go], d[go], h[go]
    return e.reshape(n, m)


def bands(sketches: np.ndarray, b: int = BANDS, r: int = ROWS) -> np.ndarray:
    """(n, b): a hash of each band, different for different bands."""
    return np.stack([tb.combine([np.full(len(sketches), i, np.uint64), *(sketches[:, i * r + j] for j in range(r))]) for i in range(b)], 1)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets given as sorted arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts, each given by its sorted shingles and their weights: what sketches estimate."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1][i], b[1][j]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    # The sum over j of max(x_j / x_i, y_j / y_i): the first is larger for ratios x_j / y_j of at least i's own.
    above, below = np.cumsum(x), y.sum() - np.cumsum(y)
    return float((1 / ((only_x + above) / x + (only_y + below) / y)).sum())


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (SHA-256 of the text), bands (empty for texts without words), rough: a byte of each component of the plain sketch, and n: how many shingles."""

    def run(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            for i, j in tb.blocks(offsets):
                own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                text, gram, count = shingles(own, off)
                plain = sketch(text, gram, np.ones(len(gram)), j - i)
                # Without a repeated shingle all weights are 1, and the weighted sketch is the plain one.
                full, again = plain.copy(), np.unique(text[count > 1])
                own_text = np.searchsorted(again, text)
                some = np.isin(text, again)
                full[again] = sketch(own_text[some], gram[some], weights(count[some]), len(again))
                # Other hashes for the plain bands, so that the two kinds do not meet.
                got = np.concatenate([bands(full), tb.mix(bands(plain, PLAIN_BANDS, PLAIN_ROWS) ^ _SALT)], 1)
                n = np.bincount(text, minlength=j - i)
                some = n > 0
                flat = pa.array(got[some].ravel().view(np.int64))
                ends = np.concatenate([[0], np.cumsum(some * got.shape[1])]).astype(np.int32)
                arr = pa.ListArray.from_arrays(pa.array(ends), flat)
                keys = [hashlib.sha256(own[off[k] : off[k + 1]]).digest() for k in range(j - i)]
                rough = [x.tobytes() for x in (plain >> np.uint64(56)).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(keys, pa.binary()), arr, pa.array(rough, pa.binary()), pa.array(n, pa.int64())], names=["id", "key", "bands", "rough", "n"])

    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, key binary, bands array<long>, rough binary, n long")


def _close(pairs: DataFrame, rough: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose plain sketches agree well enough for a closer look."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                keep = (a == b).mean(1) >= threshold - MARGIN
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = rough.withColumnsRenamed({"id": "ia", "rough": "ra", "n": "na"}), rough.withColumnsRenamed({"id": "ib", "rough": "rb", "n": "nb"})
    sizes = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    return pairs.join(right, F.col("b") == F.col("ib")).join(left, F.col("a") == F.col("ia")).where(sizes).select("a", "b", "ra", "rb").mapInArrow(run, f"a {kind}, b {kind}")


def _verified(pairs: DataFrame, rough: DataFrame | None, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their whole texts; with rough, those that are far from it are left out before texts are read."""
    if rough is not None:
        pairs = scratch.write(_close(pairs, rough, threshold))

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = [pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in (2, 3)]
            lo = 0
            while lo < len(a):
                # Each text of a stretch is cut into shingles once, though it may be in many pairs.
                at: dict = {}
                texts, size, hi = [], 0, lo
                while hi < len(a) and (hi == lo or size < tb.BLOCK_BYTES):
                    for c, key in ((2, a[hi]), (3, b[hi])):
                        if key not in at:
                            at[key] = len(texts)
                            texts.append(batch.column(c)[hi].as_py())
                            size += int(sizes[c - 2][hi])
                    hi += 1
                text, gram, _ = shingles(*tb.column_bytes(pa.array(texts, pa.large_string())))
                order = np.lexsort((gram, text))
                gram = gram[order]
                cut = np.searchsorted(text[order], np.arange(len(texts) + 1))
                one = lambda k: gram[cut[k] : cut[k + 1]]  # noqa: E731, B023
                keep = [i for i in range(lo, hi) if jaccard(one(at[a[i]]), one(at[b[i]])) >= threshold]
                if keep:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], names=["a", "b"])
                lo = hi

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = texts.withColumnsRenamed({"id": "ia", "text": "ta"}), texts.withColumnsRenamed({"id": "ib", "text": "tb"})
    # First by b, of which there are many; then by a, the pivots: a frequent one is split by adaptive execution.
    joined = pairs.join(right, F.col("b") == F.col("ib")).join(left, F.col("a") == F.col("ia")).select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """v and c for every end of an edge (a, b): c is the smallest vertex of v's connected component.

    Each round takes the smallest label among neighbours and then the label of that label, so long paths shrink fast.
    """
    both = scratch.write(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).distinct())
    labels = scratch.write(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")))
    while True:
        near = both.join(labels.withColumnsRenamed({"v": "n", "c": "nc"}), F.col("u") == F.col("n")).groupBy("v").agg(F.min("nc").alias("m"))
        step = labels.join(near.withColumnRenamed("v", "v2"), F.col("v") == F.col("v2")).select("v", F.col("c").alias("old"), F.least("c", "m").alias("c1"))
        jump = step.join(labels.withColumnsRenamed({"v": "j", "c": "jc"}), F.col("c1") == F.col("j"), "left").select("v", F.least("c1", "jc").alias("c"), "old")
        new = scratch.write(jump)
        labels = new.select("v", "c")
        if new.where("c <> old").isEmpty():
            return labels


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: its id, class_id (the smallest id of its class) and is_first (whether it is that one)."""
    tb.bound_batches(docs.sparkSession)
    with scratch.passing(docs.sparkSession):
        sketched = scratch.write(_sketched(docs, id_col, text_col))
        # One text an id, one id a text.
        own = scratch.write(sketched.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("key").alias("key")))
        reps = scratch.write(own.groupBy("key").agg(F.min("id").alias("rep")))
        edges = _links(docs, sketched, reps, id_col, text_col, threshold)
        if edges is not None:
            labels = components(edges)
            reps = reps.join(labels, F.col("rep") == F.col("v"), "left").select("key", F.coalesce("c", "rep").alias("rep"))
        classes = scratch.kept(own.join(reps, "key").select(F.col("id").alias("_id"), F.col("rep").alias("class_id")))
    out = docs.select(F.col(id_col)).join(classes, F.col(id_col) == F.col("_id"), "left")
    return out.select(id_col, "class_id", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)).alias("is_first"))


def near_duplicate_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, with_similarity: bool = False) -> DataFrame:
    """Verified links (a, b) between ids of different texts, enough of them to join every class; copies of one text are not listed.

    with_similarity: also jaccard, of the sets of shingles, and probability, the probability Jaccard similarity of the weighted
    shingles that sketches estimate, both exact.
    """
    tb.bound_batches(docs.sparkSession)
    with scratch.passing(docs.sparkSession):
        sketched = scratch.write(_sketched(docs, id_col, text_col))
        own = sketched.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("key").alias("key"))
        reps = scratch.write(own.groupBy("key").agg(F.min("id").alias("rep")))
        edges = _links(docs, sketched, reps, id_col, text_col, threshold)
        if edges is None:
            edges = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false")
        edges = edges.distinct()
        return scratch.kept(link_similarities(edges, docs, id_col, text_col) if with_similarity else edges)


def link_similarities(links: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """links (a, b) between ids of docs with the exact jaccard and probability Jaccard similarity of their texts; of several texts of an id that of smallest SHA-256 counts."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("id").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                # Pair by pair: a link's two texts, however long, are what a task holds.
                text, gram, count = shingles(*tb.column_bytes(pa.array([batch.column(c)[i].as_py() for c in (2, 3)], pa.large_string())))
                sides = []
                for d in range(2):
                    own, many = gram[text == d], weights(count[text == d])
                    order = np.argsort(own)
                    sides.append((own[order], many[order]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([jaccard(sides[0][0], sides[1][0])]), pa.array([probability_jaccard(*sides)])], names=["a", "b", "jaccard", "probability"])

    left, right = texts.withColumnsRenamed({"id": "ia", "text": "ta"}), texts.withColumnsRenamed({"id": "ib", "text": "tb"})
    joined = links.join(left, F.col("a") == F.col("ia")).join(right, F.col("b") == F.col("ib")).select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, f"a {kind}, b {kind}, jaccard double, probability double")


def _links(docs: DataFrame, sketched: DataFrame, reps: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame | None:
    """Verified links enough to join all that the buckets' pairs join; None if no bucket has two members."""
    mine = (F.col("id") == F.col("rep")) & (F.col("key") == F.col("k"))
    reps = reps.withColumnRenamed("key", "k")
    banded = sketched.where(F.size("bands") > 0).join(reps, mine, "left_semi")
    banded = scratch.write(banded.select("id", F.explode("bands").alias("h")).distinct())
    shared = scratch.write(banded.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1").select(F.col("h").alias("h2"), "pivot"))
    members = scratch.write(banded.join(shared, F.col("h") == F.col("h2")).select("h", "id", "pivot"))
    ids = scratch.write(members.select("id").distinct())
    if ids.isEmpty():
        return None
    wanted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(ids, "id", "left_semi")
    texts = scratch.write(wanted.groupBy("id").agg(F.min_by("text", F.sha2("text", 256)).alias("text")))
    rough = scratch.write(sketched.join(reps, mine, "left_semi").join(ids, "id", "left_semi").select("id", "rough", "n").dropDuplicates(["id"]))
    tested = scratch.write(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    edges = scratch.write(_verified(tested, rough, texts, threshold))
    # Buckets whose members are all linked to their pivot are settled.
    linked = edges.withColumnsRenamed({"a": "la", "b": "lb"})
    loose = members.where("id <> pivot").join(linked, (F.col("pivot") == F.col("la")) & (F.col("id") == F.col("lb")), "left_anti")
    loose = scratch.write(loose.groupBy("h").agg(F.count("*").alias("n")).where("n > 0").select("h"))
    open_ = scratch.write(members.select("h", "id").join(loose, "h", "left_semi"))
    for turn in range(1, ROUNDS + 1):
        labels = components(edges)
        placed = open_.select("h", "id").join(labels, F.col("id") == F.col("v"), "left").select("h", "id", F.coalesce("c", "id").alias("c"))
        mixed = scratch.write(placed.groupBy("h").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first < last").select(F.col("h").alias("h2"), "first"))
        if mixed.isEmpty():
            return edges
        open_ = scratch.write(placed.join(mixed, F.col("h") == F.col("h2")).select("h", "id", "c", "first"))
        # A pivot from outside the first component, the same one for all buckets that hold the same members.
        drawn = F.struct(F.xxhash64("id", F.lit(turn)).alias("x"), F.col("id").alias("id"), F.col("c").alias("c"))
        pivots = open_.where("c <> first").groupBy("h").agg(F.min(drawn).alias("p"))
        pivots = scratch.write(pivots.select(F.col("h").alias("h2"), F.col("p.id").alias("pivot"), F.col("p.c").alias("pc")))
        pairs = open_.join(pivots, F.col("h") == F.col("h2")).where("c <> pc").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
        seen = tested.select("a", "b").union(tested.select("b", "a")).withColumnsRenamed({"a": "sa", "b": "sb"})
        pairs = scratch.write(pairs.distinct().join(seen, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb")), "left_anti"))
        found = scratch.write(_verified(pairs, rough, texts, threshold))
        edges = scratch.write(edges.union(found))
        if found.count() < WORTH * open_.select("id").distinct().count():
            break
        tested = scratch.write(tested.union(pairs))
    labels = components(edges)
    rest = open_.select("id").distinct().join(labels, F.col("id") == F.col("v"), "left").select("id", F.coalesce("c", "id").alias("c"))
    pairs = scratch.write(_prefix_pairs(texts.join(scratch.write(rest), "id"), threshold))
    # These have passed exact bounds already; no sketch has a say in them.
    return scratch.write(edges.union(_verified(pairs, None, texts, threshold)))


def _prefix_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """Of texts (id, text, c): the pairs (a, b) with different c that may have a Jaccard similarity of threshold or more; none that has is left out.

    In any one order of all shingles, two such sets share one of the first n - ceil(t * n) + 1 shingles of the larger and
    of the first n - ceil(2t / (1 + t) * n) + 1 of the smaller. The order is by the number of texts that hold a shingle,
    so these are the rarest ones; those that one text alone holds come first and are in no pair.
    """

    def cut(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            for i, j in tb.blocks(offsets):
                text, gram, _ = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n, at = np.bincount(text, minlength=j - i), pa.array(text + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(n[text]), pa.array(gram.view(np.int64))], names=["id", "c", "n", "g"])

    kind, t = texts.schema["id"].dataType.simpleString(), threshold
    rows = scratch.write(texts.select("id", "text", "c").mapInArrow(cut, f"id {kind}, c {kind}, n long, g long"))
    # For each shingle of several texts: how many, in how many components, and which component has most of them.
    held = rows.groupBy("g", "c").agg(F.count("*").alias("k")).groupBy("g").agg(F.sum("k").alias("df"), F.count("*").alias("parts"), F.max(F.struct("k", "c")).alias("top"))
    held = scratch.write(held.where("df > 1").select(F.col("g").alias("hg"), "df", (F.col("parts") > 1).alias("mixed"), F.col("top.c").alias("main")))
    own = Window.partitionBy("id")
    r = rows.join(held, F.col("g") == F.col("hg")).drop("hg")
    r = r.withColumn("p", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "g")) - 1)
    # A hair under, so that rounding never takes an overlap for too small.
    first = lambda part: F.col("n") - F.ceil(part * F.col("n") - 1e-9) + 1
    r = r.where(F.col("mixed") & (F.col("p") < first(t))).withColumn("short", F.col("p") < first(2 * t / (1 + t)))
    r = scratch.write(r.select("id", "c", "n", "p", "g", "short", (F.col("c") == F.col("main")).alias("in_main")))
    names = ("id", "c", "n", "p", "short", "g")
    x = r.where(~F.col("in_main")).select(*[F.col(k).alias(f"x{k}") for k in names])
    y = r.select(*[F.col(k).alias(f"y{k}") for k in names], "in_main")
    smaller = lambda a, b: F.col(f"{a}short") & ((F.col(f"{a}n") < F.col(f"{b}n")) | ((F.col(f"{a}n") == F.col(f"{b}n")) & (F.col(f"{a}id") < F.col(f"{b}id"))))
    sizes = F.least("xn", "yn") >= t * F.greatest("xn", "yn") - 1e-9
    room = F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp")) >= t / (1 + t) * (F.col("xn") + F.col("yn")) - 1e-9
    # Two members outside the main component meet once.
    once = F.col("in_main") | (F.col("xid") < F.col("yid"))
    near = (F.col("xg") == F.col("yg")) & (F.col("xc") != F.col("yc")) & once & (smaller("x", "y") | smaller("y", "x")) & sizes & room
    return x.join(y, near).select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are the first of their class, with all their columns; of rows of one id one stays. Rows with a null id stay."""
    classes = scratch.write(near_duplicate_classes(docs, id_col, text_col, threshold))
    gone = scratch.write(classes.where(~F.col("is_first")).select(F.col(id_col).alias("_gone")).distinct())
    kept = docs.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    again = scratch.write(classes.where(F.col("is_first") & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).count().where("count > 1").select("_again"))
    if again.isEmpty():
        return kept
    return kept.join(again, F.col(id_col) == F.col("_again"), "left_anti").unionByName(kept.join(again, F.col(id_col) == F.col("_again"), "left_semi").dropDuplicates([id_col]))


def op1_probminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
