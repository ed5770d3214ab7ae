"""Sequence packing by minimum bin slack.

Every document becomes its token ids and a closing id.  Whole windows of
`capacity` ids are cut from its front; the remainders go to a pool of counts
by length.  A window takes the largest remainder and then the multiset of other
remainders whose sum comes closest to the space left: a bitset of reachable
sums is grown length by length (counts by binary splitting), and the chosen
counts are read back through the bitsets that were kept.  While more documents
follow, a window is closed only where the least slack is none, since later
remainders may fit better.  At a task's end every window takes its closest
multiset, and the slack that is left is filled by a cut from the front of the
largest remainder that still waits; the last windows are powers of two, which
need no padding.

Each task packs its own rows in blocks, so nothing is shuffled and memory is
bounded by the block and the longest document.  Sequence numbers are the task's
partition times 2^40 plus a running number, the same when a task runs again.

Null and empty texts are the closing id alone.  Repeated rows are packed as
often as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from . import tokens as tk
from .storage import mapped

CAPACITY = 1024
END_ID = 0
#: Remainders that are pooled before full windows are closed.
BLOCK = 4096

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def closest(counts: dict[int, int], space: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum is the largest up to space."""
    mask, reach = (1 << (space + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, sums reachable before
    for length in sorted((n for n, c in counts.items() if c and n <= space), reverse=True):
        left, many = min(counts[length], space // length), 1
        while left:
            many = min(many, left)
            grown = reach | (reach << (length * many)) & mask
            if grown != reach:
                steps.append((length, many, reach))
                reach = grown
            left -= many
            many *= 2
        if reach >> space & 1:
            break
    goal, taken = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> goal & 1:
            goal -= length * many
            taken[length] = taken.get(length, 0) + many
    return taken


class Packer:
    """Takes documents' ids and gives pieces with their place; memory is the pool's."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.waiting = 0
        self.out: list[tuple] = []

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw, total, cap = memoryview(ids.astype("<u4").tobytes()), len(ids), self.capacity
        for s in range(0, total - cap + 1, cap):
            self.out.append((doc_id, s, cap, zlib.crc32(raw[4 * s : 4 * (s + cap)]), total, self._next(), 0))
        rest = total % cap
        if rest:
            self._put((doc_id, total - rest, bytes(raw[4 * (total - rest) :]), total))

    def _take(self, length: int) -> tuple:
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.waiting -= 1
        own = self.pool[length]
        piece = own.pop()
        if not own:
            del self.pool[length]
        return piece

    def _place(self, pieces: list[tuple]) -> None:
        sequence, at = self._next(), 0
        for doc_id, start, raw, total in pieces:
            length = len(raw) // 4
            self.out.append((doc_id, start, length, zlib.crc32(raw), total, sequence, at))
            at += length

    def _put(self, piece: tuple) -> None:
        length = len(piece[2]) // 4
        self.pool.setdefault(length, []).append(piece)
        self.counts[length] = self.counts.get(length, 0) + 1
        self.waiting += 1

    def _front(self, length: int, size: int) -> tuple:
        """The first size ids of a waiting piece; what remains of it waits on."""
        doc_id, start, raw, total = self._take(length)
        if size < length:
            self._put((doc_id, start + size, raw[4 * size :], total))
        return doc_id, start, raw[: 4 * size], total

    def close_full(self) -> None:
        """Close windows that fill up, largest remainder first, until none does."""
        for largest in sorted(self.counts, reverse=True):
            while self.counts.get(largest):
                self.counts[largest] -= 1
                chosen = closest(self.counts, self.capacity - largest)
                self.counts[largest] += 1
                if largest + sum(n * c for n, c in chosen.items()) < self.capacity:
                    break
                self._place([self._take(largest), *(self._take(n) for n, c in chosen.items() for _ in range(c))])

    def finish(self) -> None:
        """Close all that waits: windows by least slack, what is left of each filled by a cut."""
        self.close_full()
        left = sum(n * c for n, c in self.counts.items())
        while left:
            space = min(self.capacity, 1 << (left.bit_length() - 1))
            largest = max(self.counts)
            pieces = [self._front(largest, min(largest, space))]
            slack = space - len(pieces[0][2]) // 4
            chosen = closest(self.counts, slack)
            pieces += [self._take(n) for n, c in chosen.items() for _ in range(c)]
            slack -= sum(n * c for n, c in chosen.items())
            if slack:  # every waiting piece is longer than what is left
                pieces.append(self._front(max(self.counts), slack))
            self._place(pieces)
            left -= space


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Per piece (`SCHEMA`): its document, place in it, CRC of its ids, and place in its sequence."""
    path = tokenizer or tk.default_path()
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @tx.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = tk.PieceTokenizer.shared(path)
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)

        def flush() -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(packer.out), 65536):
                cols = zip(*packer.out[lo : lo + 65536], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.split()[0] for f in SCHEMA.split(", ")])
            packer.out = []

        for b in batches:
            ids_of = b.column(0).to_pylist()
            for lo, hi, data, offs in tx.slabs(b.column(1)):
                ids, first = encoder.encode_slab(data, offs)
                for r in range(lo, hi):
                    packer.add(ids_of[r], np.append(ids[first[r - lo] : first[r - lo + 1]], END_ID))
                if packer.waiting >= block:
                    packer.close_full()
            yield from flush()
        packer.finish()
        yield from flush()

    return mapped(own, run, SCHEMA)
