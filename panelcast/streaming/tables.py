"""Tables that a streaming job writes epoch by epoch and that outlive its restarts.

An :class:`EpochTable` is a folder::

    rows/epoch=N      the rows of micro-batch N, written as one parquet table
    compact/upto=N    the newest row of every key of the epochs up to N

A folder counts only with its ``_SUCCESS`` file. Spark runs a micro-batch again if
it isn't known to have ended; it then writes the same ``epoch=N`` from anew, so a
reading is never there twice under one epoch. Readers take the newest complete
``compact`` and the epochs after it; what it has superseded is removed afterwards, so
a job that dies between the two steps leaves a right table.

:meth:`compact` runs only once the epochs since the last one hold as many rows as the
compacted table: a row is rewritten a logarithmic number of times, and the table
stays within twice the number of its keys (and the epochs of one period).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import drop_path, list_path, path_exists

#: Epochs after which compaction is considered.
PERIOD = 16


class EpochTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], period: int = PERIOD):
        self.spark, self.path, self.keys, self.period = spark, path.rstrip("/"), keys, period

    def _complete(self, kind: str) -> list[int]:
        """Numbers of the complete folders ``kind/name=N``, ascending."""
        found = []
        for name in list_path(self.spark, f"{self.path}/{kind}"):
            if "=" in name and path_exists(self.spark, f"{self.path}/{kind}/{name}/_SUCCESS"):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    def compacted(self) -> int:
        """The epoch up to which the table is compacted; -1 if it isn't."""
        return max(self._complete("compact"), default=-1)

    def epochs(self, before: int | None = None) -> list[int]:
        """Complete epochs after the compacted ones, below ``before`` if given."""
        done = self.compacted()
        return [e for e in self._complete("rows") if e > done and (before is None or e < before)]

    def write(self, rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/epoch={epoch}")

    def epoch(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows/epoch={epoch}")

    def forget(self, before: int) -> None:
        """Remove the epochs below ``before`` (snapshots that a newer one replaces)."""
        for e in self._complete("rows"):
            if e < before:
                drop_path(self.spark, f"{self.path}/rows/epoch={e}")

    def _parts(self, before: int | None = None) -> list[DataFrame]:
        parts = [self.epoch(e).withColumn("epoch", F.lit(e)) for e in self.epochs(before)]
        done = self.compacted()
        if done >= 0:
            parts.append(self.spark.read.parquet(f"{self.path}/compact/upto={done}").withColumn("epoch", F.lit(done)))
        return parts

    def rows(self, schema: StructType | None = None, before: int | None = None) -> DataFrame:
        """All rows that haven't been superseded by compaction, with their epoch."""
        parts = self._parts(before)
        if not parts:
            if schema is None:
                raise ValueError(f"{self.path} holds no rows and no schema is given")
            return self.spark.createDataFrame([], StructType([*schema.fields, StructField("epoch", IntegerType())]))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def latest(self, schema: StructType | None = None, before: int | None = None) -> DataFrame:
        """The newest row of every key."""
        return newest_rows(self.rows(schema, before), self.keys)

    def compact(self, before: int) -> bool:
        """Compact the epochs below ``before``, which have all ended, if they are worth it."""
        tail = self.epochs(before)
        if len(tail) < self.period:
            return False
        done = self.compacted()
        n = sum(self.epoch(e).count() for e in tail)                        # row counts of parquet footers
        if done >= 0 and n < self.spark.read.parquet(f"{self.path}/compact/upto={done}").count():
            return False
        self.latest(before=before).write.mode("overwrite").parquet(f"{self.path}/compact/upto={tail[-1]}")
        self.sweep()
        return True

    def sweep(self) -> None:
        """Remove what the newest compaction has superseded."""
        done = self.compacted()
        for e in self._complete("rows"):
            if e <= done:
                drop_path(self.spark, f"{self.path}/rows/epoch={e}")
        for e in self._complete("compact"):
            if e < done:
                drop_path(self.spark, f"{self.path}/compact/upto={e}")

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def newest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the newest epoch of every key; a key has few epochs."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("epoch"))
    return rows.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") == 1).drop("_rn", "epoch")
