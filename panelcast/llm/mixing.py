"""Operator 6: mixing sources to target weights.

Words are summed per source (partial sums, so a hot source is one row per
task), the sources' targets are found by filling up to their caps, and each
document is emitted floor(rate) times plus one more time with the probability
of the fraction, drawn by a hash of the seed, its id, its text and, among rows
that repeat, its number. Texts are read and counted once by the query: the rest
works on a narrow copy.

Rows that repeat are found by counts of 64-bit hashes, and only they are numbered: in
``shuffle partitions`` salted parts of each group first, then by the parts' running
totals, so a row repeated any number of times is never one task's.

Defined cases
-------------
* null text: size 0; documents of size 0 get taken 0 under any rate;
* sources are ranked by code point, null last; null is a source of its own;
* rows that repeat (doc_id, text, source) draw a number each, so that a source made of
  repeats comes as near its target as one of different rows;
* a source without words has target 0; if no source has words all targets are 0;
* an empty table returns an empty table; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, cut, running_totals, shuffle_partitions

#: Salts of the join when the sources are too many for a broadcast; least salts of a group of repeats.
SALTS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target) from rows (source, size).

    Targets are min(cap x size, level x weight) with the one level that makes
    them add up to ``share`` of all words (or all caps, if those are less).
    With sources in order of cap x size / weight the capped ones come first,
    so prefix sums give the level."""
    agg = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = running_totals(agg, [F.col("source").asc_nulls_last()], {}, "nth")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("nth", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"))
    ranked = ranked.withColumn("top", F.lit(cap) * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("weight"))
    filled = running_totals(ranked, [F.col("ratio"), F.col("source").asc_nulls_last()],
                            {"top_before": "top", "weight_before": "weight"}, "at")
    whole = filled.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    total, all_weight = float(whole["s"] or 0) * share, float(whole["w"] or 0)
    level = (F.lit(total) - F.col("top_before")) / (F.lit(all_weight) - F.col("weight_before"))
    filled = filled.withColumn("level", level)
    first = filled.filter(F.col("ratio") > F.col("level")).agg(F.min(F.struct("at", "level")).alias("m")).first()["m"]
    target = F.col("top") if first is None else F.least(F.col("top"), F.lit(first["level"]) * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def draw(doc_id: Column, text: Column, nth: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of an MD5; ``text`` is a text_key."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text, nth.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def number_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` and ``nth``: 1 to m for the m rows that share ``who``."""
    hashed = rows.withColumn("h", F.xxhash64("who"))
    again = cut(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h"))
    n = again.count()
    if not n:
        return rows.withColumn("nth", F.lit(1).cast("long"))
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    once = hashed.join(again, "h", "left_anti").withColumn("nth", F.lit(1).cast("long"))
    parts = max(SALTS, shuffle_partitions(rows.sparkSession))
    some = cut(hashed.join(again, "h", "left_semi")
               .withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")))
    before = Window.partitionBy("who").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = some.groupBy("who", "salt").agg(F.count(F.lit(1)).alias("m")).select(
        "who", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("who", "salt").orderBy(F.lit(1))
    numbered = (some.withColumn("at", F.row_number().over(inside)).join(shift, ["who", "salt"])
                .withColumn("nth", F.col("at") + F.col("shift")))
    return once.select(*rows.columns, "nth").unionByName(numbered.select(*rows.columns, "nth"))


def mix_copies(rows: DataFrame, seed: int = 1, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
               cap: float = 2.0) -> DataFrame:
    """(d, size, source_size, target, copies) from rows (d, doc_id, s, size, text): any payload d,
    the source, the words and the text_key of each document."""
    targets = cut(source_targets(rows.select(F.col("s").alias("source"), "size"), weights, share, cap))
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    who = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text",
                      F.coalesce(F.md5(F.col("s").cast("binary")), F.lit("-")))
    rows = number_repeats(rows.withColumn("who", who))
    on = [rows["s"].eqNullSafe(targets["t_source"])]
    if targets.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(targets), on)
    else:   # as exact, for any number of sources: both sides salted
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("who", "nth"), F.lit(SALTS)).cast("int"))
        spread = targets.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(spread, [rows["s"].eqNullSafe(spread["t_source"]), rows["salt"] == spread["t_salt"]])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("rate", rate)
    extra = (draw(F.col("doc_id"), F.col("text"), F.col("nth"), seed) < F.col("rate") - F.floor("rate")).cast("int")
    return rows.select("d", "size", "source_size", "target", (F.floor("rate").cast("int") + extra).alias("copies"))


def rows_of(docs: DataFrame, payload: Column) -> DataFrame:
    return docs.select(payload.alias("d"), docs["doc_id"].alias("doc_id"), docs["source"].alias("s"),
                       word_count(docs["text"]).alias("size"), text_key(docs["text"]).alias("text"))


def op6_mixing(docs: DataFrame, seed: int = 1) -> DataFrame:
    out = mix_copies(cut(rows_of(docs, docs["doc_id"])), seed)
    return out.select(F.col("d").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def stage_mixing(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents as often as the mix takes them; same columns."""
    whole = F.struct(*[docs[c] for c in docs.columns])
    out = mix_copies(rows_of(docs, whole), seed).withColumn("d", F.explode(F.array_repeat("d", F.col("copies"))))
    return out.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) AS nth
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE
             ELSE 2.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS top, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
f AS (SELECT *, row_number() OVER o AS spot,
             (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
v AS (SELECT arg_min(level, spot) AS level FROM f WHERE ratio > level),
t AS (SELECT source, source_size, least(top, coalesce((SELECT level FROM v) * weight, top)) AS target FROM f),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('1|' || coalesce(d.doc_id::VARCHAR, '') || '|' || md5(coalesce(d.text, '')) || '|' || nth), 1, 13))::BIGINT
               / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""
