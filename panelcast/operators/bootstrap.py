"""Bootstrap confidence intervals for macro-F1.

* :func:`bootstrap_hash` (B1) resamples rows: replicate b draws n row
  positions ``hash(b, j) mod n`` over the rows numbered in (label, prediction)
  cell order; the integer hash is the same in Spark and DuckDB, so replicates
  have an exact SQL oracle. Cost is B·n generated rows (``spark.range``, no
  cross join, no join at all) and a B·K² aggregate.
* :func:`bootstrap_multinomial` (B4) is the scalable form. Macro-F1 depends
  only on the K² confusion cells, and n draws with replacement give cell
  counts ~ Multinomial(n, cell shares): a chain of binomials, each cell's share of what
  the cells before it left. A binomial comes from hashed uniforms by column expressions
  (:func:`binomial`), so the replicates have an exact SQL oracle, no worker runs Python and
  the cost is B·K², independent of n.
* :func:`bootstrap_ci` (B2, B3): mean and the 2.5 / 97.5 percentiles with
  linear interpolation (numpy's default) per group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M


# Fixed constants of the draw hash (shared with the SQL oracle): values stay
# below 2^31 before every multiplication, so 64-bit arithmetic never overflows.
HASH_P = 2147483647          # 2^31 - 1
HASH_SEED_MUL = 2000003
HASH_ROUNDS_HI = ((48271, 11, 16), (69621, 7, 13))
HASH_ROUNDS_LO = ((40692, 5, 15), (16807, 3, 12))


def _mix(x: Column, rounds) -> Column:
    for mul, add, shift in rounds:
        x = (x * mul + add) % HASH_P
        x = x.bitwiseXOR(F.shiftright(x, shift))
    return x


def hash_index(b: Column, j: Column, n: Column) -> Column:
    """Row position drawn by replicate b for draw j among n rows. Two
    independent 31-bit mixes (multiply-mod-prime with xor-shifts) form one
    value below 2^62, so every position of groups far beyond 2^31 rows can be
    drawn; then mod n. Pure integer arithmetic: cheap, codegen-friendly and
    identical in DuckDB."""
    seed = (b.cast("bigint") * HASH_SEED_MUL + j.cast("bigint")) % HASH_P
    return (_mix(seed, HASH_ROUNDS_HI) * F.lit(2147483648) + _mix(seed, HASH_ROUNDS_LO)) % n


def bootstrap_hash(scored: DataFrame, group: list[str], B: int,
                   label: str = "obs_class", pred: str = "pred_class") -> DataFrame:
    """B1: macro-F1 of each replicate, one row per (group, b).

    Replicate b draws n row positions ``hash(b, j) mod n``. Macro-F1 only
    needs the drawn row's (label, prediction) cell, so rows are numbered in
    cell order: position p falls in the cell whose cumulative-count interval
    holds p. The ≤ K² interval bounds per group come from one aggregate, the
    draws are generated by ``spark.range`` and mapped to cells arithmetically,
    and only replicate × cell counts are shuffled (no join of the B·n draws)."""
    spark: SparkSession = scored.sparkSession
    conf = M.confusion(scored, group, label, pred).collect()   # ≤ groups × K² rows
    by_group: dict[tuple, list] = {}
    for r in conf:
        by_group.setdefault(tuple(r[g] for g in group), []).append((int(r["label"]), int(r["pred"]), int(r["n"])))
    draws = None
    for key, cells in sorted(by_group.items()):
        cells.sort()
        n = sum(c for _, _, c in cells)
        b, j = F.expr(f"id div {n}"), F.col("id") % n
        pos = hash_index(b, j, F.lit(n))
        lab, prd, upper = None, None, 0
        for cl, cp, c in cells:                 # cumulative upper bounds in cell order
            upper += c
            lab = F.when(pos < upper, F.lit(cl)) if lab is None else lab.when(pos < upper, F.lit(cl))
            prd = F.when(pos < upper, F.lit(cp)) if prd is None else prd.when(pos < upper, F.lit(cp))
        d = spark.range(0, B * n).select(*[F.lit(v).alias(g) for g, v in zip(group, key)], b.alias("b"),
                                         lab.alias("label"), prd.alias("pred"))
        draws = d if draws is None else draws.unionByName(d)
    if draws is None:
        return spark.createDataFrame([], f"{', '.join(g + ' string' for g in group)}, b bigint, f1_macro double")
    conf_b = draws.groupBy(*group, "b", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    keys = [*group, "b"]
    return M.summary(M.per_class(conf_b, keys), keys).select(*keys, "f1_macro")


def bootstrap_ci(reps: DataFrame, group: list[str], value: str = "f1_macro",
                 lo: float = 0.025, hi: float = 0.975, n_test: DataFrame | None = None) -> DataFrame:
    """B2 + B3: mean, percentile interval, replicate count per group."""
    q = F.percentile(F.col(value), F.array(F.lit(lo), F.lit(hi)))
    out = reps.groupBy(*group).agg(
        F.avg(value).alias("macro_f1_mean"), q.alias("_q"), F.count(F.lit(1)).alias("B"))
    out = out.select(*group, "macro_f1_mean", F.col("_q")[0].alias("ci_2_5"), F.col("_q")[1].alias("ci_97_5"), "B")
    if n_test is not None:
        out = out.join(n_test, group, "left")
    return out


def _mixed(x: int, rounds) -> int:
    """``_mix`` of a number known here."""
    for mul, add, shift in rounds:
        x = (x * mul + add) % HASH_P
        x ^= x >> shift
    return x % HASH_P


def uniform(m: Column, j: int) -> Column:
    """The j-th uniform number of a replicate, inside (0, 1); ``m`` is the replicate's mixed number."""
    y = (m * F.lit(_mixed((j * HASH_SEED_MUL + 1) % HASH_P, HASH_ROUNDS_HI))) % HASH_P
    return (_mix(y, HASH_ROUNDS_LO) % HASH_P + F.lit(0.5)) / F.lit(float(HASH_P))


#: Below this expected count (of the rarer outcome) a binomial is drawn by inversion, in so many steps;
#: above it by the normal quantile with its skewness term, whose error there is below 0.1 % of the spread.
FEW, STEPS = 30, 120


def binomial(n: Column, p: float, u1: Column, u2: Column) -> Column:
    """Binomial(n, p) from two uniform numbers."""
    if p >= 1.0:
        return n
    q = 1.0 - p
    rare = min(p, q)
    ratio = rare / (1.0 - rare)
    first = F.exp(n * F.log(F.lit(1.0 - rare)))

    def step(acc: Column, k: Column) -> Column:
        pmf = acc["pmf"] * (acc["n"] - k + 1.0) / k * F.lit(ratio)
        return F.struct(pmf.alias("pmf"), (acc["cdf"] + pmf).alias("cdf"), (acc["x"] + (acc["cdf"] < acc["u"]).cast("bigint")).alias("x"),
                        acc["u"].alias("u"), acc["n"].alias("n"))

    start = F.struct(first.alias("pmf"), first.alias("cdf"), F.lit(0).cast("bigint").alias("x"), u1.alias("u"), n.cast("double").alias("n"))
    x = F.least(F.aggregate(F.array(*[F.lit(float(k)) for k in range(1, STEPS + 1)]), start, step, lambda acc: acc["x"]), n)
    small = x if p <= q else n - x
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
    v = n * p + F.sqrt(n * p * q) * z + F.lit((q - p) / 6.0) * (z * z - 1.0)
    large = F.greatest(F.lit(0).cast("bigint"), F.least(n, F.floor(v + 0.5)))
    return F.when(n * rare < FEW, small).otherwise(large)


def multinomial_cells(scored: DataFrame, group: list[str], B: int, label: str = "obs_class", pred: str = "pred_class") -> DataFrame:
    """(group, b, label, pred, n): the cells of every replicate, which add up to the group's rows."""
    spark: SparkSession = scored.sparkSession
    cells: dict[tuple, list] = {}
    for r in M.confusion(scored, group, label, pred).collect():                   # ≤ groups × K² rows
        cells.setdefault(tuple(r[g] for g in group), []).append((int(r["label"]), int(r["pred"]), int(r["n"])))
    out = None
    for nth, key in enumerate(sorted(cells)):
        own = sorted(cells[key])
        left = sum(n for _, _, n in own)
        reps = spark.range(0, B).select(F.col("id").alias("b"), (_mix((F.col("id") + 1) % HASH_P, HASH_ROUNDS_HI) % HASH_P).alias("_m"),
                                        F.lit(left).cast("bigint").alias("_left"))
        for k, (_, _, n) in enumerate(own):
            j = 2 * (64 * nth + k)
            reps = reps.withColumns({"_u": uniform(F.col("_m"), j), "_v": uniform(F.col("_m"), j + 1)})
            reps = reps.withColumn(f"_n{k}", binomial(F.col("_left"), n / left, F.col("_u"), F.col("_v")))
            reps = reps.withColumn("_left", F.col("_left") - F.col(f"_n{k}"))
            left -= n
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.lit(p).alias("pred"), F.col(f"_n{k}").alias("n"))
                                   for k, (c, p, _) in enumerate(own)]))
        rows = reps.select(*[F.lit(v).alias(g) for g, v in zip(group, key)], "b", each.alias("c")).select(*group, "b", "c.*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], f"{', '.join(g + ' string' for g in group)}, b bigint, label int, pred int, n bigint")
    return out


def bootstrap_multinomial(scored: DataFrame, group: list[str], B: int, label: str = "obs_class",
                          pred: str = "pred_class") -> DataFrame:
    """Replicate macro-F1 from multinomial draws over the confusion cells."""
    keys = [*group, "b"]
    drawn = multinomial_cells(scored, group, B, label, pred).filter("n > 0")
    return M.summary(M.per_class(drawn, keys), keys).select(*keys, "f1_macro")
