"""Operator 13: ranked lexical search through a document FP-tree.

Each document becomes its restricted term vector: the terms that some item asks for,
ordered by how many documents hold them. Sorted vectors that start alike share a path
of a trie. Its nodes keep, for the documents below, the largest count of every term and
the smallest length figure ``m``; a score grows with the counts and falls with ``m``,
so the two give an upper bound for the whole subtree. For every item the trie is
walked depth first, the child with the highest bound first, and a subtree is left out
once its bound can't enter the item's best ``k``. Leaves score their documents exactly.

One scan splits and counts all texts (its narrow result is written once to the shared
folder) and one pass over that result builds tries of a bounded number of documents and
searches them; a task carries each item's best ``k`` from trie to trie and returns only
those, so nothing is shuffled but ``k`` rows for each item and task. Items are taken in
blocks of a bounded number of terms, so what is sent to the tasks doesn't grow with the
tables (a block of a single longer item holds that item).

Defined cases
-------------
* null texts and texts without a term count for nothing and are never returned;
* each row of the documents is a document: repeated rows take a rank each, ordered by
  doc_id, null doc_ids last;
* repeated rows of the items are one item; the same item_id with other texts is ranked
  for each text; items without a term that a document holds return no row;
* an empty table on either side returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, running_totals

#: Documents returned per item, documents of a leaf, terms of a block of items.
TOP, LEAF, BLOCK_TERMS = 10, 16, 1 << 16
#: A trie's table of term maxima has at most this many cells (4 bytes each).
CELLS = 1 << 23
#: Bytes of a text split at a time.
SLICE = 1 << 23
#: Bytes that are no part of a term become spaces, A-Z lower case; UTF-8 bytes of other characters stay.
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> tuple[int, Counter]:
    """(number of terms, occurrences of each) of a whole text, sliced at separators."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    n, found, at = 0, Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        words = data[at:end if end >= 0 else len(data)].split()
        n, at = n + len(words), end if end >= 0 else len(data)
        found.update(words)
    return n, found


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, nth, terms, counts, size) of distinct items; ``nth`` tells same ids apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [terms_of(t)[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sorted(f) for f in found], pa.list_(pa.binary())),
                 pa.array([[f[t] for t in sorted(f)] for f in found], pa.list_(pa.int64())),
                 pa.array([len(f) for f in found], pa.int64())], names=["item_id", "terms", "counts", "size"])

    rows = (items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
            .mapInArrow(run, "item_id long, terms array<binary>, counts array<long>, size long").filter("size > 0"))
    return running_totals(rows, [F.col("item_id"), F.col("terms"), F.col("counts")], {"before": "size"}, "nth")


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, tfs): all terms counted, those of ``vocabulary`` kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, found = terms_of(text)
                own = [(vocabulary[t], c) for t, c in found.items() if t in vocabulary]
                rows.append((doc, n, [t for t, _ in own], [c for _, c in own]))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))],
                names=["doc_id", "n", "ids", "tfs"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n long, ids array<int>, tfs array<long>").filter("n > 0"))


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term: summed inside a task first, one row per term and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for r in vectors.select("ids").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


def gain(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Fixed form of the score: what a term adds."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class DocumentTree:
    """FP-tree of some documents: sorted vectors, nodes with subtree maxima and minima."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, off: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, width: int):
        wide = ranks.astype(">u4")
        order = sorted(range(len(doc)), key=lambda k: wide[off[k]:off[k + 1]].tobytes())
        sizes = np.diff(off)[order]
        self.off = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(off[:-1][order] - self.off[:-1], sizes) + np.arange(self.off[-1])
        self.doc, self.m, self.ranks, self.tfs = doc[order], m[order], ranks[at], tfs[at]
        self.span: list[tuple[int, int]] = []
        self.kids: list[list[int]] = []
        self._grow()
        n = len(self.span)
        self.low = np.zeros(n, np.int64)                    # smallest m
        self.first = np.zeros(n, np.int64)                  # smallest doc_id
        leaf_of = np.zeros(len(doc), np.int64)
        for v, (lo, hi) in enumerate(self.span):
            self.low[v], self.first[v] = self.m[lo:hi].min(), self.doc[lo:hi].min()
            if not self.kids[v]:
                leaf_of[lo:hi] = v
        self.most = np.zeros((n, width), np.int32)          # largest count of every term
        np.maximum.at(self.most.reshape(-1), np.repeat(leaf_of, sizes) * width + self.ranks, np.minimum(self.tfs, 2**31 - 1))
        for v in range(n - 1, -1, -1):                      # children have higher numbers
            for c in self.kids[v]:
                np.maximum(self.most[v], self.most[c], out=self.most[v])

    def _grow(self) -> None:
        """Nodes in preorder; a path that all documents below share is one node."""
        todo = [(0, len(self.doc), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            v = len(self.span)
            self.span.append((lo, hi))
            self.kids.append([])
            if parent >= 0:
                self.kids[parent].append(v)
            if hi - lo <= LEAF:
                continue
            a, b = self.ranks[self.off[lo]:self.off[lo + 1]], self.ranks[self.off[hi - 1]:self.off[hi]]
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:k] != b[depth:k])
            depth = depth + int(differ[0]) if len(differ) else k
            place = self.off[lo:hi] + depth
            inside = place < self.off[lo + 1:hi + 1]
            head = np.where(inside, self.ranks[np.minimum(place, len(self.ranks) - 1)] if len(self.ranks) else -1, -1)
            cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(head))).tolist(), hi]
            if len(cuts) == 2:                              # equal vectors: nothing tells them apart but m and doc_id
                if hi - lo > 2 * LEAF:
                    mid = (lo + hi) // 2
                    cuts = [lo, mid, hi]
                else:
                    continue
            todo += [(x, y, depth, v) for x, y in zip(reversed(cuts[:-1]), reversed(cuts[1:]))]

    def search(self, terms: np.ndarray, weight: np.ndarray, slot: np.ndarray, best: list, k: int) -> None:
        """Depth-first branch and bound; ``best`` is a heap of (score, -doc_id)."""
        slot[terms] = np.arange(len(terms))
        todo = [(0, int(gain(weight, self.most[0, terms].astype(np.int64), self.low[0]).sum()))]
        while todo:
            v, bound = todo.pop()
            if not bound or len(best) == k and (bound, -int(self.first[v])) <= best[0]:
                continue
            if self.kids[v]:
                kids = np.array(self.kids[v])
                bounds = gain(weight, self.most[kids[:, None], terms].astype(np.int64), self.low[kids][:, None]).sum(axis=1)
                todo += [(int(kids[j]), int(bounds[j])) for j in np.argsort(bounds, kind="stable")]
                continue
            lo, hi = self.span[v]
            a, b = self.off[lo], self.off[hi]
            where = slot[self.ranks[a:b]]
            hit = np.flatnonzero(where >= 0)
            row = np.searchsorted(self.off[lo:hi + 1], a + hit, side="right") - 1
            sums = np.zeros(hi - lo, np.int64)
            np.add.at(sums, row, gain(weight[where[hit]], self.tfs[a:b][hit], self.m[lo:hi][row]))
            for j in np.flatnonzero(sums):
                entry = (int(sums[j]), -int(self.doc[lo + j]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        slot[terms] = -1


#: Stands for a null doc_id inside a trie: after every other.
NO_ID = np.iinfo(np.int64).max


def search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    """Best ``k`` documents of every task for the items (nth, item_id, terms, counts) of a block."""
    names = sorted({bytes(t) for r in block for t in r["terms"]})
    ids = {t: i for i, t in enumerate(names)}
    vectors = cut(term_vectors(docs, ids))
    total = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    n_docs, n_terms = total["n"], total["l"]
    df = document_counts(vectors, len(names))
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((np.arange(len(names)), -df))] = np.arange(len(names))       # the most frequent first
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    items = []
    for r in block:
        t = np.array([ids[bytes(t)] for t in r["terms"]])
        w = weight[t] * np.array(r["counts"], np.int64)
        some = (df[t] > 0) & (w > 0)
        items.append((r["nth"], rank[t][some], w[some]))
    width = int((df > 0).sum())
    step = max(LEAF, min(1 << 13, CELLS // max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in items]
        slot = np.full(max(1, width), -1, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, step):
                some = b.slice(lo, step)
                doc = some.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                m = 100 - 75 + (75 * some.column(1).to_numpy() * n_docs) // n_terms
                off = some.column(2).offsets.to_numpy().astype(np.int64)
                ranks, tfs = rank[some.column(2).flatten().to_numpy()], some.column(3).flatten().to_numpy()
                by = np.lexsort((ranks, np.repeat(np.arange(len(doc)), np.diff(off))))
                tree = DocumentTree(doc, m, off - off[0], ranks[by], tfs[by], width)
                for (_, terms, w), own in zip(items, best):
                    tree.search(terms, w, slot, own, k)
        rows = [(nth, -d, s) for (nth, _, _), own in zip(items, best) for s, d in own]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array([None if d == NO_ID else d for d in cols[1]], pa.int64()),
             pa.array(cols[2], pa.int64())], names=["nth", "doc_id", "score"])

    if not width:
        return docs.sparkSession.createDataFrame([], "nth long, doc_id long, score long")
    return vectors.mapInArrow(run, "nth long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``k`` documents of every item."""
    spark = docs.sparkSession
    known = cut(item_terms(items).withColumn("block", F.expr(f"before div {block_terms}")))
    found = spark.createDataFrame([], "nth long, doc_id long, score long")
    for b in known.select("block").distinct().orderBy("block").toLocalIterator():
        block = known.filter(F.col("block") == b["block"]).select("nth", "terms", "counts").orderBy("nth").collect()
        found = found.unionByName(search_block(docs, block, k))
    order = Window.partitionBy("nth").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .join(known.select("nth", "item_id"), "nth").select("item_id", "rank", "doc_id", "score"))


def op13_lexical(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sized),
items AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, term, count(*) AS q FROM (SELECT i, item_id, unnest(terms) AS term FROM items) GROUP BY ALL),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized)
           WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts, total GROUP BY term),
scores AS (
  SELECT i, item_id, r, doc_id,
         CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sized USING (r), total GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
