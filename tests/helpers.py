from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from panelcast.spec import PanelSpec

# Hand-fixture panel spec: tie-break column "rid", 1 hour hold-out.
SPEC = PanelSpec(tie="rid", holdout="1 HOUR")
PANEL_SCHEMA = T.StructType([
    T.StructField("station", T.StringType()), T.StructField("TIMESTAMP", T.TimestampNTZType()),
    T.StructField("Rain_mm_Tot", T.DoubleType()), T.StructField("rid", T.LongType()),
])
T0 = dt.datetime(2024, 3, 1, 0, 0)


def ts(i: int) -> dt.datetime:
    return T0 + dt.timedelta(minutes=15 * i)


def panel(spark, rows):
    """rows: (station, step or datetime or None, rain)."""
    out = []
    for rid, (st, step, rain) in enumerate(rows):
        t = step if (step is None or isinstance(step, dt.datetime)) else ts(step)
        out.append((st, t, rain, rid))
    return spark.createDataFrame(out, PANEL_SCHEMA)


def by_rid(df, *cols):
    return {r["rid"]: tuple(r[c] for c in cols) for r in df.select("rid", *cols).collect()}
