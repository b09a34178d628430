"""Sources for panel observations (S1, S2) and missing-value normalisation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import PanelSpec

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def normalise_missing(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """pandas has one missing value (NaN), Spark two (NaN and NULL): turn NaN
    into NULL on every floating column so later ``count``/``isNull`` logic sees
    a single kind of missing."""
    float_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = float_cols if cols is None else float_cols & set(cols)
    if not targets:
        return df
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in targets else F.col(c)
        for c in df.columns
    ])


# What the CSV reader of the original pipeline takes as missing.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
                  "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def observation_schema(spec: PanelSpec, columns: Iterable[str], strings: Iterable[str] = ()) -> T.StructType:
    """Explicit schema in the file's column order: station and any listed
    text columns as string, the timestamp as text (parsed after the scan),
    every other column — rain and the open tail of readings — as double."""
    text = {spec.station, spec.ts, *strings}
    return T.StructType([T.StructField(c, T.StringType() if c in text else T.DoubleType(), True) for c in columns])


def file_schema(spark: SparkSession, path: str, spec: PanelSpec, strings: Iterable[str] = ()) -> T.StructType:
    """Schema in the order of the header, which a one-line scan reads: a user schema
    binds CSV columns by position."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    missing = {spec.station, spec.ts, spec.rain} - set(header)
    if missing:
        raise ValueError(f"columns missing from {path}: {sorted(missing)}")
    return observation_schema(spec, header, strings)


def parse_ts(col: Column, ts_format: str | None = None) -> Column:
    """Text → TIMESTAMP without time zone; unreadable text is missing."""
    if ts_format is None:
        return col.try_cast("timestamp_ntz")
    return F.when(F.try_to_timestamp(col, F.lit(ts_format)).isNotNull(), F.to_timestamp_ntz(col, F.lit(ts_format)))


def read_observations_csv(spark: SparkSession, path: str, spec: PanelSpec,
                          strings: Iterable[str] = (), schema: T.StructType | None = None,
                          ts_format: str | None = None) -> DataFrame:
    """S1 + S2: header CSV scan with an explicit schema (no inference), parse
    the timestamp, normalise NaN to NULL. Empty fields and ``NA`` become NULL. So do
    fields that can't be read: :func:`csv_rejects` reports them."""
    schema = schema or file_schema(spark, path, spec, strings)
    df = (spark.read.schema(schema)
          .option("header", True)
          .option("mode", "PERMISSIVE")
          .option("nullValue", "")
          .option("nanValue", "NaN")
          .csv(path))
    # Missing tokens in numeric columns fail the double parse and are read as
    # NULL in PERMISSIVE mode; NaN survives as NaN and is normalised. In text
    # columns they are named.
    for c in {spec.station, spec.ts, *strings}:
        df = df.withColumn(c, F.when(~F.col(c).isin(*MISSING_TOKENS), F.col(c)))
    df = df.withColumn(spec.ts, parse_ts(F.col(spec.ts), ts_format))
    return normalise_missing(df)


def csv_rejects(spark: SparkSession, path: str, spec: PanelSpec, strings: Iterable[str] = (),
                schema: T.StructType | None = None, ts_format: str | None = None) -> DataFrame:
    """What :func:`read_observations_csv` can't read, one row per field: (file, record,
    column_name, value), ``record`` the line as it stands. A line with too few or too many
    fields is one row without column and value. Missing tokens are no rejects.

    A pass over the file's lines as text, apart from the reader's own."""
    schema = schema or file_schema(spark, path, spec, strings)
    given = lambda c: c.isNotNull() & ~F.trim(c).isin(*MISSING_TOKENS)
    fields = ", ".join(f"`{f.name}` string" for f in schema) + ", _odd string"
    lines = (spark.read.text(path).filter(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("record"))
             .withColumn("_f", F.from_csv("record", fields, {"columnNameOfCorruptRecord": "_odd", "nullValue": ""})))
    heads = F.lit(True)
    for f in schema.fields:
        heads = heads & F.col(f"_f.`{f.name}`").eqNullSafe(F.lit(f.name))
    whole = F.col("_f._odd").isNull()       # a line of the wrong length is reported as such, not field by field
    items = [F.when(~whole, F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("value")))]
    for f in schema.fields:
        v = F.col(f"_f.`{f.name}`")
        if f.name == spec.ts:
            read = parse_ts(v, ts_format)
        elif isinstance(f.dataType, T.StringType):
            continue
        else:
            read = F.trim(v).try_cast(f.dataType.simpleString())
        items.append(F.when(whole & given(v) & read.isNull(), F.struct(F.lit(f.name).alias("column_name"), v.alias("value"))))
    return (lines.filter(~heads).select("file", "record", F.explode(F.array_compact(F.array(*items))).alias("x"))
            .select("file", "record", "x.column_name", "x.value"))


def read_observations_parquet(spark: SparkSession, path: str) -> DataFrame:
    return normalise_missing(spark.read.parquet(path))


def format_ts(col: Column | str, fmt: str = TS_FORMAT) -> Column:
    """Timestamp → text (``%Y-%m-%d %H:%M:%S``)."""
    return F.date_format(col, fmt)
