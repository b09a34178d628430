"""Operator 4: token-id / binary output by best-fit-decreasing packing.

Documents become token ids and an end-of-document id. Overlong documents are cut
into pieces of a row's length, losslessly (doc_id, piece number). Each task packs
the documents of its partition in windows of about ``WINDOW`` tokens, so nothing
is shuffled and memory is bounded: pieces in order of decreasing length go into
the open row whose free space fits best, found in a segment tree over capacities.

A packed row holds its ids and the position of each within its piece, both as
little-endian binary rows of a matrix (``LENGTH`` columns, filled up with the end
id and position 0), the cumulative segment lengths, and what lies in the segments.

Defined cases
-------------
* null and empty texts are documents of the end id alone;
* a document whose ids fill whole rows exactly has no empty last piece;
* equal lengths: documents in scan order; equal free space: the older row;
* repeated rows and null doc_ids are documents like any other;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END, RANKS, encode_texts, read_ranks

#: Columns of a packed row, tokens that are packed together, text bytes tokenised at a time.
LENGTH, WINDOW, CHUNK = 2048, 1 << 23, 1 << 21

SCHEMA = ("pack string, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, "
          "n_tokens int")


class CapacityTree:
    """Open rows by free space: a segment tree over capacities 0 .. top that
    finds the smallest capacity with an open row that is at least a length."""

    def __init__(self, top: int):
        self.half = 1 << top.bit_length()
        self.count = [0] * (2 * self.half)
        self.rows: list[deque[int]] = [deque() for _ in range(top + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.half
        while at:
            self.count[at] += 1
            at >>= 1

    def best(self, length: int) -> int:
        """Smallest capacity >= length with an open row, or -1."""
        at = length + self.half
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):        # up, until a right neighbour holds rows
                at >>= 1
            if at <= 1:
                return -1
            at += 1
            while at < self.half:                                       # down to its leftmost leaf
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.half

    def take(self, capacity: int) -> int:
        at = capacity + self.half
        while at:
            self.count[at] -= 1
            at >>= 1
        return self.rows[capacity].popleft()


def pack(lengths: list[int], top: int) -> list[list[int]]:
    """Best-fit-decreasing: rows of piece numbers, each at most ``top`` long."""
    rows: list[list[int]] = []
    tree = CapacityTree(top)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        free = tree.best(lengths[k]) if lengths[k] < top else -1
        if free < 0:
            row, free = len(rows), top
            rows.append([])
        else:
            row = tree.take(free)
        rows[row].append(k)
        if free > lengths[k]:
            tree.add(free - lengths[k], row)
    return rows


def pack_window(ids: np.ndarray, start: np.ndarray, size: np.ndarray, doc: list, piece: np.ndarray, name: str,
                top: int) -> pa.RecordBatch:
    """Packed rows of the pieces [start, start + size) of ``ids``."""
    rows = pack(size.tolist(), top)
    matrix = np.full((len(rows), top), END, "<u2" if END < 1 << 16 else "<u4")
    place = np.zeros((len(rows), top), "<u2" if top <= 1 << 16 else "<u4")
    count = np.arange(top)
    ends, docs, parts = [], [], []
    for r, own in enumerate(rows):
        at, cuts = 0, [0]
        for k in own:
            n = int(size[k])
            matrix[r, at:at + n] = ids[start[k]:start[k] + n]
            place[r, at:at + n] = count[:n]
            at += n
            cuts.append(at)
        ends.append(cuts)
        docs.append([doc[k] for k in own])
        parts.append([int(piece[k]) for k in own])
    return pa.RecordBatch.from_arrays(
        [pa.array([f"{name}-{r}" for r in range(len(rows))]), pa.array([m.tobytes() for m in matrix], pa.binary()),
         pa.array([p.tobytes() for p in place], pa.binary()), pa.array(ends, pa.list_(pa.int32())),
         pa.array(docs, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32())),
         pa.array([e[-1] for e in ends], pa.int32())], names=[c.split()[0] for c in SCHEMA.split(", ")])


def op4_packing(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, path: str = RANKS) -> DataFrame:
    """Packed rows of all documents. The vocabulary (a fixed size) is read on the
    driver and travels with the function."""
    ranks = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, nth = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        sizes, doc, piece, total = [], [], [], 0

        def flush():
            nonlocal nth, total
            size = np.array(sizes)
            out = pack_window(np.concatenate(held), np.cumsum(size) - size, size, doc, np.array(piece), f"{part}-{nth}", length)
            held.clear(), sizes.clear(), doc.clear(), piece.clear()
            nth, total = nth + 1, 0
            for at in range(0, out.num_rows, 1000):
                yield out.slice(at, 1000)

        for b in batches:
            bytes_ = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < b.num_rows:
                hi = lo + max(1, int(np.searchsorted(np.cumsum(bytes_[lo:]), CHUNK, side="right")))
                some = b.slice(lo, hi - lo)
                ids, off = encode_texts(some.column(1).to_pylist(), ranks)
                for k, d in enumerate(some.column(0).to_pylist()):
                    own = np.append(ids[off[k]:off[k + 1]], END).astype(np.int32)
                    for p, at in enumerate(range(0, len(own), length)):
                        held.append(own[at:at + length])
                        sizes.append(len(held[-1]))
                        doc.append(d)
                        piece.append(p)
                    total += len(own)
                    if total >= window:
                        yield from flush()
                lo = hi
        if total:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def unpack(rows, end: int = END) -> dict[tuple[int, int], np.ndarray]:
    """(doc_id, piece) -> ids of collected packed rows (for tests and readers)."""
    out = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            out[d, p] = ids[a:b]
    return out
