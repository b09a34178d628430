"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir

#: White space of the text contracts: space and U+0009 to U+000D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word: a longest run of characters that are not white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only when a count shows at most this many (narrow) rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """A copy in the shared folder of ``spark.checkpoint.dir``: expensive rows
    are made once, and a lost executor is answered from the copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def worker_cache(owner: str) -> dict:
    """A dict that lives as long as the Python worker process (workers are reused between tasks,
    unpickled functions are not), or until another operator's functions ask for theirs: a worker
    that serves one pipeline stage after the other holds the tables of one."""
    home = sys.modules.setdefault("_panelcast_worker_cache", types.ModuleType("_panelcast_worker_cache")).__dict__
    if home.get("owner") != owner:
        home["owner"], home["cache"] = owner, {}
    return home["cache"]


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is. ``lower`` is used only
    where it can't touch anything else (ASCII text)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str], rank: str) -> DataFrame:
    """Global 0-based ``rank`` under the total order ``order`` and, for each
    ``sums`` item (new column -> summed column), the sum over all earlier rows.

    Rows are range-partitioned and sorted, tagged with their partition, and
    written once; totals per partition (one row each) give every partition its
    offset. No task holds more than one range."""
    tagged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .withColumn("_rt_part", F.spark_partition_id())
                 .withColumn("_rt_row", F.monotonically_increasing_id()))
    per_part = tagged.groupBy("_rt_part").agg(
        F.min("_rt_row").alias("_rt_first"), F.count(F.lit(1)).alias("_rt_n"),
        *[F.sum(c).alias(f"_rt_s_{k}") for k, c in sums.items()])
    before = Window.orderBy("_rt_part").rowsBetween(Window.unboundedPreceding, -1)   # one row per range partition
    offsets = per_part.select(
        "_rt_part", "_rt_first", F.coalesce(F.sum("_rt_n").over(before), F.lit(0)).alias("_rt_off"),
        *[F.coalesce(F.sum(f"_rt_s_{k}").over(before), F.lit(0)).alias(f"_rt_o_{k}") for k in sums])
    inside = Window.partitionBy("_rt_part").orderBy("_rt_row").rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(F.broadcast(offsets), "_rt_part")
    out = out.withColumn(rank, F.col("_rt_row") - F.col("_rt_first") + F.col("_rt_off"))
    for k, c in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_rt_o_{k}"))
    return out.drop("_rt_part", "_rt_row", "_rt_first", "_rt_off", *[f"_rt_o_{k}" for k in sums])
