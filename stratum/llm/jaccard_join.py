r"""N-gram Jaccard join with set-relation skipping, and its components.

A document's set is its distinct 5-word shingles; two documents link when
100 * |A and B| >= 75 * |A or B|, that is when their distance d = |A| + |B| -
2 |A and B| is at most (|A| + |B|) / 7.  The join is exact, and runs in steps:

1. Equal sets collapse to one class each (a combinable aggregation).
2. Prefilter: of each set only the third with the smallest hashes is counted.
   Linked sets share more than a known number of these, so a document with
   fewer that anyone else has cannot link and goes.
3. Among the rest, document frequencies of all shingles are counted.  A set with
   c shared shingles can only link if c >= 3/4 of its size, and only its
   c - 3/4 n + 1 rarest shared shingles need a place in the index lists
   (prefix filter, rarest first).
4. List skipping: an index list is met by size blocks (powers of 4/3), and
   blocks whose sizes cannot link are skipped, as are pairs whose shared
   shingles cannot suffice.  In each list the set with the largest shared part
   answers first; every other set of the list is compared to the answerer that
   it shares most lists with.
5. Answer skipping: the components of these links are found.  In each list
   only sets outside the list's main component still need answers, against sets
   of other components.  Distances to a common answerer decide many of these
   pairs without a comparison (triangle inequality, both ways); the others are
   compared.

Frequencies travel as blobs: each task sorts its shingles to buckets and sends
one row per bucket, first the counts, combined, then the places; a bucket's
task holds only its counts and streams the places.  The number of buckets
follows the input, so a bucket's size does not.  Nothing is collected to the
driver but counts.

Null and empty texts have the empty set and link with nothing; null ids too.
Texts of fewer than five words are one shingle, the whole sequence.  Rows that
repeat an id are each judged by their own text: where an id has more than one,
the join runs over numbers of the different (id, text) pairs, in the order of
their ids, and gives the ids back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import with_seq
from . import text as tx
from .storage import cut, mapped

WIDTH = 5
#: Shingles in one bucket, about.
BUCKET = 1_000_000
#: Shingles that a task gathers before it sends them.
FLUSH = 4_000_000
#: Ids that are sent to all tasks at most (some 40 bytes each, 10 MB in all); beyond, the join shuffles.
BROADCAST_IDS = 250_000
#: Buckets up to which each holds `BUCKET` shingles; beyond, they hold more, lest each task's rows become too small.
PLAIN_BUCKETS = 4096

_BLOB = "bucket int, kind int, ids binary, sizes binary, counts binary, tokens binary"
_SIZE_BLOCK = math.log(4 / 3)


def _buckets(total: int) -> int:
    return max(4, min(-(-total // BUCKET), PLAIN_BUCKETS + total // (32 * BUCKET)))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and t, a hash of the text."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.withColumn("t", F.xxhash64("text"))


def signatures(own: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, t, size of its set, and two hashes of the set."""

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2 = [], [], []
            for _, _, data, offs in tx.slabs(b.column(1)):
                for s in tx.shingle_sets(data, offs, width):
                    n.append(len(s))
                    h1.append(int(s.sum(dtype=np.uint64)))
                    h2.append(int(tx.mix(s).sum(dtype=np.uint64)))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), signed(h1), signed(h2)], ["doc_id", "t", "n", "h1", "h2"])

    return mapped(own, run, "doc_id bigint, t bigint, n bigint, h1 bigint, h2 bigint")


class _Sender:
    """Gathers (document, shingle) places and gives them as one counts row and one places row per bucket."""

    def __init__(self, buckets: int, narrow: bool):
        self.buckets, self.narrow = buckets, narrow
        self.ids: list[int] = []
        self.sizes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int, size: int, tokens: np.ndarray) -> None:
        if len(tokens):
            self.ids.append(doc_id)
            self.sizes.append(size)
            self.sets.append(tokens)
            self.size += len(tokens)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids, sizes, tokens = np.array(self.ids, np.int64), np.array(self.sizes, np.uint32), np.concatenate(self.sets)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), [len(s) for s in self.sets])
        self.ids, self.sizes, self.sets, self.size = [], [], [], 0
        bucket = (tokens % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        if self.narrow:
            tokens = (tokens >> np.uint64(24)).astype(np.uint32)
        tokens, doc = tokens[order], doc[order]
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for k in range(self.buckets):
            t, d = tokens[edges[k] : edges[k + 1]], doc[edges[k] : edges[k + 1]]
            if not len(t):
                continue
            value, many = np.unique(t, return_counts=True)
            first = np.concatenate([[True], d[1:] != d[:-1]])
            at = np.flatnonzero(first)
            places = np.diff(np.append(at, len(d))).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k, k], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([b"", ids[d[at]].tobytes()], pa.binary()), pa.array([b"", sizes[d[at]].tobytes()], pa.binary()), pa.array([many.astype(np.uint32).tobytes(), places.tobytes()], pa.binary()), pa.array([value.tobytes(), t.tobytes()], pa.binary())],
                ["bucket", "kind", "ids", "sizes", "counts", "tokens"],
            )


def _sum_by(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    v, c = values[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    return v[at], np.add.reduceat(c, at)


def _received(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple]:
    """(ids, set sizes, places per id, shingles, frequencies) of each places row; 0 for shingles that only one document has."""
    at, parts, known, df = -1, [], None, None
    for b in batches:
        for k in range(b.num_rows):
            bucket, what = b.column(0)[k].as_py(), b.column(1)[k].as_py()
            counts = np.frombuffer(b.column(4)[k].as_buffer(), np.uint32)
            tokens = np.frombuffer(b.column(5)[k].as_buffer(), kind)
            if bucket != at:
                at, parts, known = bucket, [], None
            if what == 0:
                parts.append((tokens, counts))
                continue
            if known is None:
                known, df = _sum_by(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                known, df, parts = known[df > 1], df[df > 1], []
            place = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
            have = known[place] == tokens if len(known) else np.zeros(len(tokens), bool)
            yield np.frombuffer(b.column(2)[k].as_buffer(), np.int64), np.frombuffer(b.column(3)[k].as_buffer(), np.uint32), counts.astype(np.int64), tokens, np.where(have, df[place], 0) if len(known) else np.zeros(len(tokens), np.int64)


def _dealt(blobs: DataFrame, buckets: int) -> DataFrame:
    return blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")


class _Returner:
    """Gathers what a bucket's task found for each id, and gives it as one row per part of the ids."""

    schema = "part int, ids binary, sizes binary, counts binary, keys binary"

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray, keys: np.ndarray | None = None) -> None:
        some = counts > 0
        self.held.append((ids[some], sizes[some], counts[some], keys if keys is not None else np.zeros(0, np.int64)))
        self.size += len(ids) + len(self.held[-1][3])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        ids, sizes, counts, keys = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        part = (tx.mix(ids.view(np.uint64)) % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        if len(keys):
            own = np.repeat(part, counts)
            keys = keys[np.argsort(own, kind="stable")]
            upto = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=self.parts))])
        for p in np.flatnonzero(np.diff(edges)).tolist():
            at = order[edges[p] : edges[p + 1]]
            cells = [ids[at], sizes[at].astype(np.uint32), counts[at].astype(np.uint32), keys[upto[p] : upto[p + 1]] if len(keys) else keys]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["part", "ids", "sizes", "counts", "keys"])


def _returned(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Everything that one task gets back: ids, sizes, counts, keys."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for b in batches:
        for k in range(b.num_rows):
            for c, kind in enumerate((np.int64, np.uint32, np.uint32, np.int64)):
                cols[c].append(np.frombuffer(b.column(c + 1)[k].as_buffer(), kind))
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols)


def _prefiltered(own: DataFrame, total: int, width: int) -> DataFrame:
    """Ids that the prefilter leaves."""
    buckets = _buckets(total // 3)

    @tx.released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, narrow=True)
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, _, data, offs in tx.slabs(b.column(1)):
                for k, s in enumerate(tx.shingle_sets(data, offs, width)):
                    sender.add(ids[lo + k], len(s), s[: len(s) - 2 * len(s) // 3])
                if sender.size >= FLUSH:
                    yield from sender.flush()
        yield from sender.flush()

    @tx.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _Returner(buckets)
        for ids, sizes, places, _, df in _received(batches, np.uint32):
            back.add(ids, sizes, np.add.reduceat((df > 0).astype(np.int64), np.cumsum(places) - places))
            if back.size >= FLUSH:
                yield from back.flush()
        yield from back.flush()

    @tx.released
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, counts, _ = _returned(batches)
        rows, at = np.unique(np.stack([ids, sizes.astype(np.int64)]), axis=1, return_inverse=True)
        shared = np.bincount(at.ravel(), weights=counts, minlength=rows.shape[1])
        # linked sets share n / 12 of them at least (where one has 3/4 of the other's size); 2 less for rounding
        keep = np.unique(rows[0][shared >= np.maximum(1, rows[1] // 12 - 2)])
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], ["doc_id"])

    told = mapped(_dealt(mapped(own.where("doc_id is not null"), send, _BLOB), buckets), count, _Returner.schema)
    return mapped(told.repartition(buckets, "part"), decide, "doc_id bigint")


def _index(sets: DataFrame, total: int) -> DataFrame:
    """Index lists: key (rarer shingles have smaller ones), node, its set's size n and shared size c, and the key's place pos among its shared ones."""
    buckets = _buckets(total)

    @tx.released
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(buckets, narrow=False)
        for b in batches:
            tokens = b.column(1)
            flat, offs = tokens.values.to_numpy().view(np.uint64), tokens.offsets.to_numpy()
            for k, node in enumerate(b.column(0).to_pylist()):
                sender.add(node, int(offs[k + 1] - offs[k]), flat[offs[k] : offs[k + 1]])
                if sender.size >= FLUSH:
                    yield from sender.flush()
        yield from sender.flush()

    @tx.released
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = _Returner(buckets)
        for ids, sizes, places, tokens, df in _received(batches, np.uint64):
            on = df > 0
            # the low bits tell shingles apart
            key = (np.minimum(df, 32767).astype(np.uint64) << np.uint64(48) | tokens & np.uint64((1 << 48) - 1))[on].astype(np.int64)
            back.add(ids, sizes, np.add.reduceat(on.astype(np.int64), np.cumsum(places) - places), key)
            if back.size >= FLUSH:
                yield from back.flush()
        yield from back.flush()

    @tx.released
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, counts, key = _returned(batches)
        owner = np.repeat(ids, counts)
        order = np.lexsort((key, owner))
        owner, key, n = owner[order], key[order], np.repeat(sizes.astype(np.int64), counts)[order]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        c = np.diff(np.append(first, len(owner)))
        pos, c = np.arange(len(owner)) - np.repeat(first, c), np.repeat(c, c)
        on = np.flatnonzero(pos <= c - -(-3 * n // 4))
        for lo in range(0, len(on), 65536):
            at = on[lo : lo + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(key[at], pa.int64()), pa.array(owner[at], pa.int64()), *(pa.array(x[at], pa.int32()) for x in (n, c, pos))], ["key", "node", "n", "c", "pos"])

    told = mapped(_dealt(mapped(sets, send, _BLOB), buckets), keys, _Returner.schema)
    return mapped(told.repartition(buckets, "part"), lists, "key bigint, node bigint, n int, c int, pos int")


def _fits(a: str, b: str) -> str:
    """Sizes and places allow a link of two sets whose first common shingle this is: what each has from here on must suffice.

    Sets that link pass this at their first common shingle, so what fails at
    later ones is lost nowhere.
    """
    return f"4 * least({a}.n, {b}.n) >= 3 * greatest({a}.n, {b}.n) and 7 * least({a}.c - {a}.pos, {b}.c - {b}.pos) >= 3 * ({a}.n + {b}.n)"


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, d (their distance) and whether they link."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    n = F.size("ta") + F.size("tb")
    d = both.select("a", "b", n.alias("m"), (n - 2 * F.size(F.array_intersect("ta", "tb"))).alias("d"))
    return d.select("a", "b", "d", (7 * F.col("d") <= F.col("m")).alias("link"))


def components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) of every node with an edge: alternating large and small stars.

    Self-edges, repeated and reversed edges do no harm.  Ends when a round changes nothing.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, before = cut(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _links(post: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different sets, enough to give the components of all links."""
    first = post.groupBy("key").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("s"), "node", "n", "c", "pos")).alias("p"), F.count("*").alias("many")).where("many > 1")
    first = first.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("n"), F.col("p.c").alias("c"), F.col("p.pos").alias("pos"))
    met = post.alias("x").join(first.alias("y"), F.expr(f"x.key = y.key and x.node <> y.pivot and {_fits('x', 'y')}"))
    votes = met.groupBy(F.col("x.node").alias("a"), F.col("y.pivot").alias("b")).agg(F.count("*").alias("votes"))
    asked = votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    answers = cut(_compared(asked, sets))
    done = answers.where("link").select("a", "b")
    comp = cut(components(done))

    told = answers.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "d")
    p = post.join(first.select("key"), "key").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    p = cut(p.join(told, "node", "left"))
    sizes = p.groupBy("key", "component").agg(F.count("*").alias("many"))
    main = sizes.groupBy("key").agg(F.max(F.struct("many", "component")).alias("m"), F.count("*").alias("groups")).where("groups > 1").select("key", F.col("m.component").alias("main"))
    p = p.join(main, "key").withColumn("block", F.floor(F.log("n") / F.lit(_SIZE_BLOCK)).cast("int"))
    rest = p.where("component <> main").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    near = "x.pivot is not null and x.pivot = y.pivot"
    open_pairs = rest.alias("x").join(
        p.alias("y"),
        F.expr(
            f"x.key = y.key and x.block = y.block and x.component <> y.component and (y.component = y.main or x.node < y.node) and {_fits('x', 'y')}"
            " and not (x.pivot <=> y.node) and not (y.pivot <=> x.node)"
            f" and not coalesce({near} and 7 * abs(x.d - y.d) > x.n + y.n, false)"
        ),
    )
    open_pairs = open_pairs.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(F.max(F.expr(f"coalesce({near} and 7 * (x.d + y.d) <= x.n + y.n, false)")).alias("told"))
    open_pairs = cut(open_pairs)
    more = _compared(open_pairs.where("not told").select("a", "b"), sets).where("link").select("a", "b")
    return done.union(open_pairs.where("told").select("a", "b")).union(more)


def similarity_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id, and first: whether this is the row that its component is named after."""
    return _judged(_own(docs, id_col, text_col), width).drop("t")


def _judged(own: DataFrame, width: int) -> DataFrame:
    sigs = cut(signatures(own, width))
    known = sigs.where("doc_id is not null")
    if known.groupBy("doc_id").agg((F.min("t") != F.max("t")).alias("many")).where("many").isEmpty():
        return _components_of(own, sigs, width).withColumn("first", F.col("component_id").eqNullSafe(F.col("doc_id")))
    # numbers of the (id, text) pairs stand for ids; the smallest number has the smallest id
    pairs = cut(with_seq(known.select("doc_id", "t").distinct(), "doc_id", "t", name="pair"))
    numbered = lambda d: d.join(pairs, ["doc_id", "t"], "left")
    got = _components_of(
        numbered(own).select(F.col("pair").alias("doc_id"), "text", "t"),
        cut(numbered(sigs).select(F.col("pair").alias("doc_id"), "t", "n", "h1", "h2")),
        width,
    )
    back = lambda c: pairs.select(F.col("pair").alias(c), F.col("doc_id").alias(f"{c}_back"))
    got = got.withColumn("first", F.col("component_id").eqNullSafe(F.col("doc_id")))
    for c in ("doc_id", "class_id", "component_id"):
        got = got.join(back(c), c, "left").drop(c).withColumnRenamed(f"{c}_back", c)
    return got.select("doc_id", "t", "n_shingles", "class_id", "component_id", "first")


def _components_of(own: DataFrame, sigs: DataFrame, width: int) -> DataFrame:
    """doc_id, t, n_shingles, class_id, component_id where each id has one text."""
    classes = cut(sigs.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node")))
    total = sigs.agg(F.sum("n")).first()[0] or 0
    out = sigs.join(classes, ["h1", "h2", "n"], "left")
    if total:
        left = cut(_prefiltered(own.select("doc_id", "text"), total, width).join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"))
        n_left = left.count()
        left = F.broadcast(left) if n_left <= BROADCAST_IDS else left

        @tx.released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, data, offs in tx.slabs(b.column(1)):
                    sets = tx.shingle_sets(data, offs, width)
                    flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), tx.list_array(flat, [len(s) for s in sets], pa.int64())], ["node", "tokens"])

        one = own.select("doc_id", "text").join(left, "doc_id", "left_semi")
        sets = cut(mapped(one, run, "node bigint, tokens array<bigint>"))
        kept = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
        post = cut(_index(sets, kept))
        comp = cut(components(_links(post, sets)))
        out = out.join(comp, "node", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("bigint"))
    some = F.col("doc_id").isNotNull()
    return out.select("doc_id", "t", F.col("n").alias("n_shingles"), F.when(some, F.coalesce("node", "doc_id")).alias("class_id"), F.when(some, F.coalesce("component", "node", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The documents without those that another of their component stands for, the one of the smallest id.

    Rows are told apart by id and text; rows that repeat both stay once, the
    least one by its other columns.  Rows with a null id all stay.
    """
    found = cut(_judged(_own(docs, id_col, text_col), width).where(F.col("doc_id").isNotNull()).select("doc_id", "t", "first"))
    gone = cut(found.where(~F.col("first")).select("doc_id", "t").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    t = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    d = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), t.alias("t")).join(gone, ["doc_id", "t"], "left_anti")
    if not found.where("first").groupBy("doc_id", "t").count().where("count > 1").isEmpty():
        plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        order = F.struct(*[F.col("row")[c] for c in plain])
        once = d.where("doc_id is not null").groupBy("doc_id", "t").agg(F.min_by("row", order).alias("row"))
        d = once.select("row").unionByName(d.where("doc_id is null").select("row"))
    return d.select(*[F.col("row")[c].alias(c) for c in docs.columns])
