"""CSV scan with explicit schema and NaN / NULL normalisation."""

import os
import tempfile

from panelcast.sources.observations import read_observations_csv
from panelcast.spec import STATION_SPEC


def test_nan_null_empty_na(spark):
    d = tempfile.mkdtemp(prefix="panelcast-csv-")
    with open(os.path.join(d, "obs.csv"), "w") as f:
        f.write("TIMESTAMP,station,Rain_mm_Tot\n")
        f.write("2024-01-01 00:00:00,CER,NaN\n2024-01-01 00:15:00,CER,\n")
        f.write("2024-01-01 00:30:00,CER,NA\n2024-01-01 00:45:00,CER,0.254\n")
    df = read_observations_csv(spark, d, STATION_SPEC, ts_format="yyyy-MM-dd HH:mm:ss")
    vals = [r["Rain_mm_Tot"] for r in df.orderBy("TIMESTAMP").collect()]
    assert vals == [None, None, None, 0.254]
    assert dict(df.dtypes)["TIMESTAMP"] == "timestamp_ntz"


def test_parquet_source_normalises_nan(spark):
    import math

    from panelcast.sources.observations import read_observations_parquet
    d = tempfile.mkdtemp(prefix="panelcast-pq-")
    df = spark.createDataFrame([("A", float("nan"), 1.5), ("B", None, float("nan")), ("C", 0.254, 2.0)],
                               "station string, Rain_mm_Tot double, AirTC double")
    df.write.mode("overwrite").parquet(d)
    got = {r["station"]: (r["Rain_mm_Tot"], r["AirTC"]) for r in read_observations_parquet(spark, d).collect()}
    assert got == {"A": (None, 1.5), "B": (None, None), "C": (0.254, 2.0)}
    assert not any(isinstance(v, float) and math.isnan(v) for pair in got.values() for v in pair)


def test_missing_tokens_in_text_columns(spark, tmp_path):
    from panelcast.sources.observations import read_observations_csv
    from panelcast.spec import STATION_SPEC as spec
    f = tmp_path / "obs.csv"
    f.write_text(f"{spec.station},{spec.ts},{spec.rain}\nNA,2024-01-01 00:00:00,0.2\nNorte,NA,NA\nnan,null,1.0\nSur,2024-01-01 00:15:00,\n")
    rows = read_observations_csv(spark, str(f), spec).collect()
    got = [(r[spec.station], r[spec.ts] is None, r[spec.rain]) for r in rows]
    assert got == [(None, False, 0.2), ("Norte", True, None), (None, True, 1.0), ("Sur", False, None)]


def test_unreadable_fields_are_reported_with_their_line(spark, tmp_path):
    from panelcast.sources.observations import csv_rejects
    lines = ["2024-01-01 00:00:00,CER,12x,1.5", "2024-01-01 00:15:00,CER,NA,nan", "2024-01-01 00:30:00,CER, 0.254 ,", "soon,JUN,0.254,null",
             "2024-01-01 00:45:00,JUN,--,?", "2024-01-01 01:00:00,JUN,1.0", '"2024-01-01 01:15:00","a,b",1e3,-1.#IND', "NA,JUN,,#N/A",
             "2024-01-01 01:30:00,MIRA,1.0,2.0,3.0", "yesterday,MIRA,x,1"]
    (tmp_path / "obs.csv").write_text("TIMESTAMP,station,Rain_mm_Tot,AirTC\n" + "\n".join(lines) + "\n")
    path = str(tmp_path / "obs.csv")
    for fmt in (None, "yyyy-MM-dd HH:mm:ss"):
        got = csv_rejects(spark, path, STATION_SPEC, ts_format=fmt).collect()
        assert all(r.file.endswith("obs.csv") for r in got)
        assert sorted((r.column_name or "", r.value or "", r.record) for r in got) == sorted([
            ("Rain_mm_Tot", "12x", lines[0]), ("TIMESTAMP", "soon", lines[3]), ("Rain_mm_Tot", "--", lines[4]), ("AirTC", "?", lines[4]),
            ("", "", lines[5]), ("", "", lines[8]), ("Rain_mm_Tot", "x", lines[9]), ("TIMESTAMP", "yesterday", lines[9])])
        rows = read_observations_csv(spark, path, STATION_SPEC, ts_format=fmt).collect()
        assert [r["Rain_mm_Tot"] for r in rows][:5] == [None, None, 0.254, 0.254, None] and [r["TIMESTAMP"] is None for r in rows] == [
            False, False, False, True, False, False, False, True, False, True]
