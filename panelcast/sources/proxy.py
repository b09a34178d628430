"""Driver tables as a panel (FIXTURES.md §D).

``events`` becomes a station panel: ``event_type`` is the station, ``ts`` the
timestamp, ``event_id`` breaks ties, and the reading is a whole number of
0.254 mm gauge tips derived from ``value``; every 97th event is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import PROXY_SPEC, PanelSpec

# Fixed values of the proxy panel definition:
#   missing when event_id % 97 = 0, else greatest(0, floor(value / 50) - 2) * 0.254
MISSING_EVERY = 97
VALUE_PER_TIP = 50.0
TIP_OFFSET = 2
TIP_MM = 0.254


# Declared schema of the driver's ``events`` table: reading it needs no
# schema-inference job over the files' footers.
EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
SCHEMAS = {"events": EVENTS_SCHEMA}


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    r = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return r.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_panel(events: DataFrame, spec: PanelSpec = PROXY_SPEC) -> DataFrame:
    rain = (F.greatest(F.lit(0.0), F.floor(F.col("value") / F.lit(VALUE_PER_TIP)) - F.lit(TIP_OFFSET))
            * F.lit(TIP_MM))
    return events.select(
        F.col("event_type").alias(spec.station),
        F.col("ts").alias(spec.ts),
        F.when(F.col("event_id") % MISSING_EVERY == 0, F.lit(None).cast("double"))
         .otherwise(rain).alias(spec.rain),
        F.col("event_id").alias(spec.tie or "event_id"),
    )


def load_panel(spark: SparkSession, sf_dir: str, spec: PanelSpec = PROXY_SPEC) -> DataFrame:
    return events_panel(load_table(spark, sf_dir, "events"), spec)


# DuckDB form of the same panel, used by the oracle SQL.
PANEL_SQL = f"""
panel AS (
  SELECT event_type AS station,
         ts AS "TIMESTAMP",
         CASE WHEN event_id % {MISSING_EVERY} = 0 THEN CAST(NULL AS DOUBLE)
              ELSE greatest(CAST(0.0 AS DOUBLE), floor(value / CAST({VALUE_PER_TIP} AS DOUBLE)) - {TIP_OFFSET})
                   * CAST({TIP_MM} AS DOUBLE) END AS Rain_mm_Tot,
         event_id
  FROM events
)"""
