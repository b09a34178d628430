"""Scaling probe for the chunked series windows (not a registered query).

Generates an N-row, 15-minute panel in Spark where one station holds 70 % of
the rows, then times the labelling + history windows in the chunked form and
in the plain ``partitionBy(station)`` form (noop sink).

usage: python tools/scale_probe.py [rows=8000000] [cpus=8]
"""

from __future__ import annotations

import json
import sys
import time

sys.path.insert(0, ".")
from pyspark.sql import functions as F  # noqa: E402

from panelcast.operators import features as ft  # noqa: E402
from panelcast.operators import targets as tg  # noqa: E402
from panelcast.plans import jobs  # noqa: E402
from panelcast.session import get_session  # noqa: E402
from panelcast.spec import PanelSpec  # noqa: E402


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 8_000_000
    cpus = int(sys.argv[2]) if len(sys.argv) > 2 else 8
    spark = get_session(f"local[{cpus}]", partitions=cpus * 4)
    hot = int(n * 0.7)
    rest = (n - hot) // 3
    parts = []
    for i, (name, rows) in enumerate([("HOT", hot), ("B", rest), ("C", rest), ("D", rest)]):
        parts.append(spark.range(0, rows).select(
            F.lit(name).alias("station"),
            F.expr("timestamp_ntz'2015-06-01 00:00:00' + make_dt_interval(0, 0, id * 15)").alias("TIMESTAMP"),
            F.when(F.rand(7 + i) < 0.01, F.lit(None).cast("double"))
             .otherwise(F.floor(F.rand(11 + i) * F.rand(13 + i) * 4) * 0.254).alias("Rain_mm_Tot"),
            (F.col("id") + i * 10 ** 12).alias("rid")))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.repartition(cpus * 4).checkpoint(eager=True)   # materialise the input once
    spec = PanelSpec(tie="rid", holdout="1 YEAR", chunk_rows=1 << 18)
    out = {"rows": n, "cpus": cpus}
    for method in ("chunked", "plain"):
        t = time.perf_counter()
        jobs.labelled_features(df, spec, method=method, context=False).write.format("noop").mode("overwrite").save()
        out[f"label_features_{method}_sec"] = round(time.perf_counter() - t, 2)
    t = time.perf_counter()
    ft.cross_station(df, spec).write.format("noop").mode("overwrite").save()
    out["cross_station_sec"] = round(time.perf_counter() - t, 2)
    t = time.perf_counter()
    tg.with_holdout_flag(df, spec).write.format("noop").mode("overwrite").save()
    out["holdout_flag_sec"] = round(time.perf_counter() - t, 2)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
