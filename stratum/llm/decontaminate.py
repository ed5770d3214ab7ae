"""Benchmark decontamination with an FM-index per training shard.

A shard is some `SHARD_WORDS` consecutive words of whole documents.  All of
its words become symbols in order, with a separator before each document; words
that no test item has share one symbol that no search asks for.  The shard is
indexed: suffix order, Burrows-Wheeler transform, a wavelet matrix for ranks,
and sampled suffix positions.  All distinct windows of the items are searched
backwards at once; sampled positions locate the hits, which are merged to
removal spans.

Test items reach the tasks in blocks of bounded size.  One block (the usual
case) needs no shuffle; more blocks make one pass each, and a document's spans
are merged afterwards.  The rows are the same for any number of blocks.

Nulls, empty texts and texts without words have no hits.  Items without words
have no window; an item without an id has the empty one.  Repeated items and repeated documents each keep their rows.
Extra columns are ignored by `find_leaks` and kept by `remove_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .storage import cut, mapped

#: Words in a window.
WINDOW = 10
#: Bytes of item text that one pass searches for.  A word takes some 16 bytes of a broadcast, so 4 MB of text make 12 MB, or 32 MB were all words one letter.
BLOCK_BYTES = 4 << 20
#: Words in one index.
SHARD_WORDS = 1 << 18
#: Suffix positions kept: one in so many.
SAMPLE = 8

SCHEMA = (
    "doc_id bigint, n_words bigint, items array<string>, "
    "spans array<struct<word_start:bigint,word_end:bigint,byte_start:bigint,byte_end:bigint>>"
)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling over those that are not yet told apart.

    Symbols under 2 are told apart by their place, and the last symbol is one:
    no search asks for them, and repeats end there.
    """
    n = len(symbols)
    rank, single = np.empty(n, np.int64), symbols < 2
    u = int(single.sum())
    rank[single] = np.arange(u)
    todo = np.flatnonzero(~single)
    count = np.bincount(symbols[todo], minlength=2)
    rank[todo] = u + (np.cumsum(count) - count)[symbols[todo]]
    todo, step = todo[count[symbols[todo]] > 1], 1
    while len(todo):
        old = rank[todo]
        key = old * n + rank[todo + step]
        by = np.argsort(key, kind="stable")
        todo, old, key = todo[by], old[by], key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(todo))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        rank[todo] = old + np.maximum.accumulate(np.where(fresh, at, 0)) - group
        todo = todo[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class Bits:
    """Ones before each place of a bit string."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), "<u8")
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)
        self.zeros = n - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Backward search and location over an array of positive ints; 1 is never searched for."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        s = np.append(symbols, 0).astype(np.int32)
        order = suffix_order(s)
        self.n = len(s)
        bwt = s[order - 1]
        top = int(s.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=top))])
        self.bwt, self.levels = bwt, []
        v = bwt
        for bit in reversed(range(max(1, (top - 1).bit_length()))):
            on = (v >> bit) & 1 == 1
            self.levels.append((bit, Bits(on)))
            v = np.concatenate([v[~on], v[on]])
        # no step passes a symbol that is not searched for
        kept = (order % sample == 0) | (bwt < 2)
        self.kept = Bits(kept)
        self.positions = order[kept].astype(np.int32)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c stands in the first i symbols of the transform."""
        i, p = i.astype(np.int64), np.zeros(len(i), np.int64)
        for bit, ones in self.levels:
            on = (c >> bit) & 1 == 1
            a, b = ones.rank(i), ones.rank(p)
            i = np.where(on, ones.zeros + a, i - a)
            p = np.where(on, ones.zeros + b, p - b)
        return i - p

    def search(self, seq: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, first row, end row) of the phrases seq[start : start + length] that occur."""
        live = np.arange(len(starts))
        top = len(self.before) - 1
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        for j in range(length - 1, -1, -1):
            c = seq[starts[live] + j]
            on = c < top
            live, c, lo, hi = live[on], c[on], lo[on], hi[on]
            if j == length - 1:
                lo, hi = self.before[c], self.before[c + 1]
            else:
                lo, hi = self.before[c] + self.rank(c, lo), self.before[c] + self.rank(c, hi)
            on = lo < hi
            live, lo, hi = live[on], lo[on], hi[on]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by steps to the next kept one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept.at(rows))
        while len(todo):
            c = self.bwt[rows[todo]]
            rows[todo] = self.before[c] + self.rank(c, rows[todo])
            steps[todo] += 1
            todo = todo[~self.kept.at(rows[todo])]
        return self.positions[self.kept.rank(rows)] + steps


class Phrases:
    """The distinct windows of some items: word numbers of all items in a row, and by length each window's start there and its items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [i for i, _ in items]
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, data, offs in tx.slabs(pa.array([t or "" for _, t in items], pa.string())):
            low = tx.LOWER[data]
            starts, ends, first = tx.word_spans(low, offs, tx.ALNUM)
            hashes.append(tx.word_hashes(low, starts, ends))
            counts.append(np.diff(first))
        h, count = np.concatenate(hashes), np.concatenate(counts)
        self.vocabulary = np.unique(h)
        self.seq = (np.searchsorted(self.vocabulary, h) + 2).astype(np.int32)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        owner = np.repeat(np.arange(len(count), dtype=np.int32), count)
        within = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(np.repeat(count, count), window)
        begins = np.flatnonzero(within + length <= np.repeat(count, count))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for m in np.unique(length[begins]).tolist():
            self.by_length[m] = self._distinct(begins[length[begins] == m], owner, m)

    def _distinct(self, starts: np.ndarray, owner: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of different windows, and the items of each from bound to bound."""
        key = np.zeros(len(starts), np.uint64)
        for j in range(m):
            key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + self.seq[starts + j].astype(np.uint64))
        starts = starts[np.argsort(key, kind="stable")]
        same = np.ones(max(len(starts) - 1, 0), bool)
        for j in range(m):
            same &= self.seq[starts[1:] + j] == self.seq[starts[:-1] + j]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        return starts[first].astype(np.int32), np.append(first, len(starts)).astype(np.int32), owner[starts]

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """2 and up for known words, else 1."""
        out = np.ones(len(h), np.int32)
        maybe = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[at] == h[maybe], at + 2, 1)
        return out


def _ranges(lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... for each count."""
    return np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _shard_hits(parts: list[tuple], phrases: Phrases, spans: dict, items: dict) -> None:
    """Index a shard and note its rows' hits; parts are (rows, words of each, byte starts, byte ends, symbols)."""
    rows, count, b0, b1, sym = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.cumsum(count) - count
    place = np.arange(len(sym)) + np.repeat(np.arange(len(rows)), count) + 1  # a separator before each row
    seq = np.ones(len(sym) + len(rows), np.int32)
    seq[place] = sym
    index = FMIndex(seq)
    mark, hits = np.zeros(len(seq) + 1, np.int32), []
    heads = first + np.arange(len(rows)) + 1  # where each row's words begin in the index
    for m, (starts, bounds, owners) in phrases.by_length.items():
        found, lo, hi = index.search(phrases.seq, starts, m)
        if not len(found):
            continue
        at = index.locate(_ranges(lo, hi - lo))
        np.add.at(mark, at, 1)
        np.add.at(mark, at + m, -1)
        row = np.searchsorted(heads, at, "right") - 1
        # a row's windows once each, then their items
        pairs = np.unique(row * len(starts) + np.repeat(found, hi - lo))
        row, window = pairs // len(starts), pairs % len(starts)
        many = bounds[window + 1] - bounds[window]
        hits.append(np.unique(np.repeat(row, many) * len(phrases.names) + owners[_ranges(bounds[window], many)]))
    for r, k in (divmod(x, len(phrases.names)) for h in hits for x in h.tolist()):
        items.setdefault(int(rows[r]), set()).add(phrases.names[k])
    hit = np.flatnonzero(np.cumsum(mark[:-1])[place] > 0)
    if not len(hit):
        return
    own = np.repeat(np.arange(len(rows)), count)[hit]
    cut_here = (np.diff(own) != 0) | (np.diff(hit) != 1)
    begin, end = np.concatenate([[True], cut_here]), np.concatenate([cut_here, [True]])
    for r, a, b in zip(own[begin].tolist(), hit[begin].tolist(), hit[end].tolist(), strict=True):
        spans.setdefault(int(rows[r]), []).append((a - int(first[r]), b + 1 - int(first[r]), int(b0[a]), int(b1[b])))


def scan_batch(column: pa.Array, phrases: Phrases, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, dict, dict]:
    """Each row's words, and by row its hit spans (words and bytes) and items."""
    n_words, spans, items = np.zeros(len(column), np.int64), {}, {}
    parts, size = [], 0
    for lo, hi, data, offs in tx.slabs(column):
        low = tx.LOWER[data]
        starts, ends, first = tx.word_spans(low, offs, tx.ALNUM)
        count = np.diff(first)
        n_words[lo:hi] = count
        if not phrases.by_length:
            continue
        base = np.repeat(offs[:-1], count)
        parts.append((np.arange(lo, hi), count, (starts - base).astype(np.int32), (ends - base).astype(np.int32), phrases.numbers(tx.word_hashes(low, starts, ends))))
        size += len(starts)
        if size >= shard_words:
            _shard_hits(parts, phrases, spans, items)
            parts, size = [], 0
    if parts:
        _shard_hits(parts, phrases, spans, items)
    return n_words, spans, items


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks whose texts are of bounded size together; one block is on the driver at a time."""
    own = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


def find_leaks(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, with_key: bool = False) -> DataFrame:
    """Per document (`SCHEMA`): words, items with occurring windows (sorted strings), merged hit spans.

    Byte offsets are of the UTF-8 text.  With more than one block of items,
    equal documents (id and text) are searched once and give equal rows.
    with_key adds key, xxhash64 of the text (null: empty).
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    passes = [_one_pass(own, Phrases(items, window)) for items in _blocks(bench, item_col, item_text_col, block_bytes)]
    if len(passes) == 1:
        return passes[0] if with_key else passes[0].drop("key")
    union = passes[0]
    for more in passes[1:]:
        union = union.unionByName(more)
    merged = union.groupBy("doc_id", "key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )
    merged = mapped(merged.select("doc_id", "key", "n_words", "items", "spans"), _merged, merged.schema)
    keys = own.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    return keys.alias("k").join(merged.alias("m"), F.expr("k.doc_id <=> m.doc_id and k.key = m.key"), "left").select("k.doc_id", *["k.key"] * with_key, "m.n_words", "m.items", "m.spans")


_SPAN = pa.struct([(k, pa.int64()) for k in ("word_start", "word_end", "byte_start", "byte_end")])


def _span_column(spans: list[list[tuple]]) -> pa.Array:
    flat = np.array([s for own in spans for s in own], np.int64).reshape(-1, 4)
    offs = np.concatenate([[0], np.cumsum([len(own) for own in spans])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_SPAN)))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins spans that touch; they come sorted."""
    for b in batches:
        out = []
        for own in b.column(4).to_pylist():
            kept: list[list[int]] = []
            for s in own:
                a, z, x, y = (s[f.name] for f in _SPAN)
                if kept and kept[-1][1] >= a:
                    kept[-1][1], kept[-1][3] = max(kept[-1][1], z), max(kept[-1][3], y)
                else:
                    kept.append([a, z, x, y])
            out.append(kept)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], _span_column(out)], b.schema.names)


def _one_pass(own: DataFrame, phrases: Phrases) -> DataFrame:
    sent = own.sparkSession.sparkContext.broadcast(phrases)  # bounded by block_bytes

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = sent.value
        for b in batches:
            n_words, spans, items = scan_batch(b.column(1), ph)
            rows = range(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n_words, pa.int64()), pa.array([sorted(items.get(r, ())) for r in rows], pa.list_(pa.string())), _span_column([spans.get(r, []) for r in rows])],
                ["doc_id", "key", "n_words", "items", "spans"],
            )

    return mapped(own.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))), run, SCHEMA.replace("n_words", "key bigint, n_words", 1))


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without some ranges of its bytes."""
    raw, last, pieces = text.encode(), 0, []
    for s, e in spans:
        pieces.append(raw[last:s])
        last = e
    return b"".join([*pieces, raw[last:]]).decode()


def remove_leaks(docs: DataFrame, bench: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with their hit spans cut out; those left without a word by that go.  Columns stay; n_chars is the new length.

    A text that is cut is searched again, for all items, until nothing is
    found, since a cut can bring words together.  With one block of items this
    happens in the task; with more, a round finds the spans of all blocks, cuts
    them, and hands what it has cut to the next round.
    """
    blocks = _blocks(bench, "item_id", "text", block_bytes)
    first = next(blocks)
    if next(blocks, None) is not None:
        return _remove_by_rounds(docs, bench, window, block_bytes)
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(Phrases(first, window))

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph = sent.value
        for b in batches:
            column = b.column(at)
            _, spans, _ = scan_batch(column, ph)
            if not spans:
                yield b
                continue
            texts, keep = {r: column[r].as_py() for r in spans}, np.ones(b.num_rows, bool)
            todo = spans
            while todo:
                rows = sorted(todo)
                for r in rows:
                    texts[r] = _without(texts[r], [s[2:] for s in todo[r]])
                n, again, _ = scan_batch(pa.array([texts[r] for r in rows], pa.string()), ph)
                keep[rows] = n > 0
                todo = {rows[k]: v for k, v in again.items()}
            hit = np.zeros(b.num_rows, bool)
            hit[sorted(texts)] = True
            new = [texts[r] for r in sorted(texts)]
            arrays = list(b.columns)
            arrays[at] = pc.replace_with_mask(column, pa.array(hit), pa.array(new, column.type))
            if "n_chars" in names:
                c = names.index("n_chars")
                arrays[c] = pc.replace_with_mask(b.column(c), pa.array(hit), pa.array([len(t) for t in new], b.column(c).type))
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names).filter(pa.array(keep))

    return mapped(docs, run, schema)


def _remove_by_rounds(docs: DataFrame, bench: DataFrame, window: int, block_bytes: int) -> DataFrame:
    names, at, out = docs.columns, docs.columns.index("text"), None
    schema = T.StructType([*docs.schema.fields, T.StructField("__hit", T.BooleanType())])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = list(b.columns[: len(names)])
            own = zip(arrays[at].to_pylist(), b.column(len(names)).to_pylist(), strict=True)
            arrays[at] = pa.array([t if s is None else _without(t, [(x["byte_start"], x["byte_end"]) for x in s]) for t, s in own], arrays[at].type)
            yield pa.RecordBatch.from_arrays([*arrays, b.column(len(names)).is_valid()], [*names, "__hit"])

    todo = docs
    while out is None or not todo.isEmpty():
        own = todo.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
        found = find_leaks(todo.select("doc_id", "text"), bench, window=window, block_bytes=block_bytes, with_key=True).where(F.size("spans") > 0)
        found = found.dropDuplicates(["doc_id", "key"])
        one = own.alias("d").join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id and d.__key = f.key"), "left")
        done = cut(mapped(one.select(*[F.col(f"d.`{c}`") for c in names], F.col("f.spans").alias("__spans")), without, schema))
        if "n_chars" in names:
            kind = docs.schema["n_chars"].dataType
            done = done.withColumn("n_chars", F.when(F.col("__hit"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
        rest = done.where("not __hit").select(*names)
        out = rest if out is None else out.unionByName(rest)
        todo = done.where("__hit").where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).select(*names)
    return out
