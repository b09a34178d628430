"""Operator 3: approximate nearest neighbours by a permutation index.

Every vector is represented by its ``PREFIX`` nearest of ``PIVOTS`` sampled pivots, in
order. Rows are dealt by hash to blocks of about ``BLOCK_ROWS``; each block has a pivot
inverted file: the list of a pivot posts the rows that have it in their prefix, with the
place it takes there. A query's chunk goes to every block (a stated query set against all
rows, in blocks), where a query reads the lists of the pivots in its own prefix and no
others: about PREFIX^2 / PIVOTS entries a row. The lists add up to the footrule
distance of the prefixes (a pivot that only one of the two has counts as if it stood
behind the other's prefix). The rows with the smallest distances, ``SHARE`` of the block
and ``SPARE`` times the results asked for, are ranked again by the exact measure.

The measure is the inner product in double precision. Lengths are evened out for
the pivots only, by one more component sqrt(M^2 - |x|^2) with the largest length
M, so that the nearest pivots are those with the largest products.

Rows with the same vector form one class, which is indexed once with its
smallest ids (a result never needs more than ``k`` + 1 of them). A query keeps as many
more than ``k`` as there are vectors under its own id, which are left out last. The pivots are
a sample of ``PIVOTS`` classes; everything else covers all rows.

Defined cases
-------------
* vectors that are null, empty, zero, or hold a null or non-finite component
  take no part, as queries or candidates; neither do rows without a vec_id and
  vectors whose number of components isn't the most frequent one (ties: larger);
* ties go to the smaller vec_id; rows that carry the query's own vec_id are no
  candidates of it; fewer candidates than k: all of them;
* rows that repeat vec_id and vector are one candidate and one query; an id with several
  vectors is a candidate (and a query) with each of them and may take several ranks;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: The index's sample; rows of a block; queries of a chunk.
PIVOTS, BLOCK_ROWS, CHUNK_ROWS = 512, 16_384, 8_192
#: Pivots that a row is posted under and a query reads the lists of.
PREFIX = 48
#: Candidates that are ranked again in a block: a share of its rows and a multiple of k.
SHARE, SPARE = 0.1, 10


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, v as array<double>."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(sound & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()   # few sizes
    return rows.filter(F.size("v") == (size["size"] if size else 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(key, v, ids): one row per vector with its k + 1 smallest ids."""
    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64("v", F.lit(1)).alias("b"))
    keyed = rows.withColumn("key", F.concat(F.hex(key["a"]), F.lit("-"), F.hex(key["b"])))
    nth = Window.partitionBy("key").orderBy("vec_id")
    once = keyed.dropDuplicates(["key", "vec_id"])
    few = once.withColumn("nth", F.row_number().over(nth)).filter(F.col("nth") <= k + 1)    # limited before the shuffle
    return few.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Block:
    """Permutation index of some rows: pivot inverted files and vectors."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, top: float):
        self.x, self.pivots, self.top = x, pivots, top
        self.length = min(PREFIX, len(pivots))
        near = self.prefix(x, 1.0).ravel()
        by = np.argsort(near, kind="stable")
        self.rows, self.places = (by // self.length).astype(np.int32), (by % self.length).astype(np.int32)
        self.first = np.searchsorted(near[by], np.arange(len(pivots) + 1))           # list p: first[p] .. first[p + 1]

    def prefix(self, x: np.ndarray, lift: float) -> np.ndarray:
        """The nearest pivots of each vector, nearest first."""
        rest = np.sqrt(np.maximum(self.top ** 2 - (x ** 2).sum(1), 0)) * lift
        near = np.column_stack((x, rest)) @ self.pivots.T
        return np.argsort(-near, axis=1, kind="stable")[:, :self.length]

    def candidates(self, own: np.ndarray, m: int) -> np.ndarray:
        """The m rows with the smallest footrule distance to a prefix. Against two prefixes
        with no common pivot, one at places a and b takes 2 (length - max(a, b)) off the distance."""
        if m >= len(self.x):
            return np.arange(len(self.x))
        lists = [slice(self.first[p], self.first[p + 1]) for p in own]
        rows = np.concatenate([self.rows[s] for s in lists])
        nearer = np.concatenate([self.length - np.maximum(self.places[s], a) for a, s in enumerate(lists)])
        return np.argpartition(-np.bincount(rows, nearer, len(self.x)), m - 1)[:m]


def search(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    rows = usable(rows)
    cls = cut(classes(rows, k))
    n = cls.count()
    sample = [r["v"] for r in cls.select("v").orderBy("key").limit(PIVOTS).collect()]       # bounded sample
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    top = float(cls.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0])
    p = np.array(sample, float)
    pivots = np.column_stack((p, np.sqrt(np.maximum(top ** 2 - (p ** 2).sum(1), 0))))
    key = F.concat(F.hex(F.xxhash64("v")), F.lit("-"), F.hex(F.xxhash64("v", F.lit(1))))
    asking = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), key.alias("key")).distinct()
    vectors = asking.groupBy("query_id").agg(F.count(F.lit(1)).alias("own"))
    q = cut(asking.join(vectors, "query_id").groupBy("key").agg((F.max("own") + k).alias("keep")))
    n_blocks, n_chunks = -(-n // BLOCK_ROWS), max(1, -(-q.count() // CHUNK_ROWS))
    deal = F.xxhash64("key", F.lit(7))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    index = cls.select(F.pmod(deal, F.lit(n_blocks)).cast("int").alias("block"), each(n_chunks).alias("chunk"),
                       F.lit(None).cast("long").alias("keep"), "key", "v", "ids")
    ask = (q.join(cls, "key")
           .select(each(n_blocks).alias("block"), F.pmod(deal, F.lit(n_chunks)).cast("int").alias("chunk"),
                   "keep", "key", "v", F.lit(None).cast("array<long>").alias("ids")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["keep"].notna().to_numpy()
        have, qs = pdf[~asks], pdf[asks]
        names = ["key", "keep", "score", "vec_id"]
        if not len(have) or not len(qs):
            return pd.DataFrame({"key": pd.Series([], dtype=str), "keep": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype=float), "vec_id": pd.Series([], dtype="int64")})
        have = have.assign(first=[i[0] for i in have["ids"]]).sort_values("first")          # ties: smaller id first
        block = Block(np.stack(have["v"].to_numpy()), pivots, top)
        ids = have["ids"].to_numpy()
        m = SPARE * k + int(np.ceil(SHARE * len(have)))
        x = np.stack(qs["v"].to_numpy())
        result = []
        for name, keep, vec, own in zip(qs["key"], qs["keep"].astype(int), x, block.prefix(x, 0.0)):
            cand = np.sort(block.candidates(own, m))
            score = (block.x[cand] * vec).sum(1)
            best = np.argsort(-score, kind="stable")[:keep]
            found = sorted((-score[b], i) for b in best for i in ids[cand[b]])[:keep]
            result.extend((name, keep, -s, i) for s, i in found)
        return pd.DataFrame(result, columns=names)

    found = index.unionByName(ask).groupBy("block", "chunk").applyInPandas(run, "key string, keep long, score double, vec_id long")
    merge = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("nth", F.row_number().over(merge)).filter(F.col("nth") <= F.col("keep"))
    best = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("near"))
    full = asking.join(best, "key").select("query_id", "near")
    mine = F.slice(F.filter("near", lambda r: r["vec_id"] != F.col("query_id")), 1, k)
    full = full.select("query_id", F.posexplode(mine).alias("at", "r"))
    return full.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")


def op3_ann(rows: DataFrame) -> DataFrame:
    return search(rows.select("vec_id", "embedding"))
