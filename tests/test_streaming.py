"""Streaming jobs: availableNow runs equal batch; late rows are dropped."""

import datetime as dt
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from panelcast.plans.registry import QUERIES
from panelcast.streaming import jobs as sj
from panelcast.spec import PROXY_SPEC


def test_ingest_equals_batch(spark):
    s = QUERIES["stream_ingest"](spark, SF_SMALL)
    b = QUERIES["scan_observations"](spark, SF_SMALL)
    assert s.count() == b.count()


def test_late_rows_dropped_after_watermark_advances(spark):
    d = tempfile.mkdtemp(prefix="panelcast-stream-")
    base = dt.datetime(2024, 1, 1)

    def write(name, rows):
        pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).to_parquet(
            os.path.join(d, name), coerce_timestamps="us")

    write("events_1.parquet", [(1, base, 0, "a", 200.0, ""), (2, base + dt.timedelta(hours=5), 0, "a", 200.0, "")])
    stream = (spark.readStream.schema(sj.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(d))
    from panelcast.sources import proxy
    p = proxy.events_panel(stream, PROXY_SPEC).withColumn("event_time", F.col("TIMESTAMP").cast("timestamp"))
    q_df = sj.ingest_stream(p, PROXY_SPEC).drop("event_time")
    out, ck = os.path.join(d, "out"), os.path.join(d, "ck")
    q = q_df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
    q.processAllAvailable()
    # second file: one on-time row, one row 4 hours behind the watermark, one duplicate
    write("events_2.parquet", [(3, base + dt.timedelta(hours=5, minutes=15), 0, "a", 100.0, ""),
                               (4, base, 0, "a", 100.0, ""),
                               (5, base + dt.timedelta(hours=5), 0, "a", 100.0, "")])
    q.processAllAvailable()
    q.stop()
    ids = sorted(r["event_id"] for r in spark.read.parquet(out).collect())
    assert ids == [1, 2, 3]


def test_model_alerts_equal_batch_scoring(spark):
    """Brute force: with one micro-batch and no history, the streamed alerts
    equal scoring the batch feature frame of the whole panel."""
    from panelcast.operators import modeling as MD
    from panelcast.plans import jobs
    from panelcast.plans import registry as R
    from panelcast.sources import proxy
    got = R.QUERIES["stream_alerts_model"](spark, SF_SMALL)
    d, _, nums = R.feature_table(spark, SF_SMALL, "1h")
    model, medians, _ = MD.fit_one(d.filter(F.col("is_last_year") == 0), "obs_class_1h", nums, "logreg")
    want = MD.score(model, medians, jobs.feature_frame(proxy.load_panel(spark, SF_SMALL), PROXY_SPEC))
    g = {r["event_id"]: r["pred_class"] for r in got.collect()}
    w = {r["event_id"]: r["pred_class"] for r in want.select("event_id", "pred_class").collect()}
    assert g.keys() == w.keys() and len(g) == 1000
    agree = sum(g[k] == w[k] for k in g) / len(g)
    assert agree > 0.99       # same model, same features; LR fits are deterministic


def test_model_alerts_use_history_across_batches(spark):
    """Two micro-batches (events split in time): rows of the second batch get
    their look-back from the history table, so predictions still equal
    scoring the whole panel at once."""
    from panelcast.operators import modeling as MD
    from panelcast.plans import jobs
    from panelcast.plans import registry as R
    from panelcast.sources import proxy
    ev = pd.read_parquet(f"{SF_SMALL}/events.parquet").sort_values("ts")
    half = len(ev) // 2
    d = tempfile.mkdtemp(prefix="panelcast-hist-")
    ev.iloc[:half].to_parquet(os.path.join(d, "events_1.parquet"), coerce_timestamps="us")
    ev.iloc[half:].to_parquet(os.path.join(d, "events_2.parquet"), coerce_timestamps="us")
    feat, _, nums = R.feature_table(spark, SF_SMALL, "1h")
    model, medians, _ = MD.fit_one(feat.filter(F.col("is_last_year") == 0), "obs_class_1h", nums, "logreg")
    stream = proxy.events_panel(
        spark.readStream.schema(sj.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(d), PROXY_SPEC)
    got = sj.model_alert_job(stream, PROXY_SPEC, model, medians, "hist_test")
    want = MD.score(model, medians, jobs.feature_frame(proxy.load_panel(spark, SF_SMALL), PROXY_SPEC))
    g = {r["event_id"]: r["pred_class"] for r in got.collect()}
    w = {r["event_id"]: r["pred_class"] for r in want.select("event_id", "pred_class").collect()}
    assert g == w


def test_alert_metrics_cover_matured_rows(spark):
    from panelcast.plans import registry as R
    row = R.QUERIES["stream_alert_metrics"](spark, SF_SMALL).first()
    assert row["n_rows"] == 58                        # complete hold-out rows at sf0.001
    assert 0.0 <= row["f1_macro"] <= 1.0 and abs(row["f1_micro"] - row["accuracy"]) < 1e-12


def test_alerts_over_micro_batches_equal_batch(spark):
    """Duplicates (in a batch and over batches), late readings within the
    watermark and buckets with more than 23 readings: the streamed alerts equal
    one batch over the distinct readings; context features likewise. A reading
    beyond the watermark is dropped."""
    from panelcast.operators import baselines as bl
    from panelcast.plans import jobs
    from panelcast.sources import proxy
    base = dt.datetime(2024, 1, 1)
    at = lambda m: base + dt.timedelta(minutes=m)
    rows = [(1000 * s + k, at(k // 2 + s), 0, "abc"[s], 100.0 + 37.0 * ((k * (s + 3)) % 29), "") for s in range(3) for k in range(180)]
    rows.sort(key=lambda r: (r[1], r[0]))
    late, rest = rows[150:160], rows[:150] + rows[160:]
    first, second = rest[:300], rest[300:]
    files = [first + first[40:60], second[:120] + late + first[250:260], second[120:] + second[100:130] + [(99_999, at(-500), 0, "a", 900.0, "")]]
    first_late = late[0][1]
    assert first[-1][1] - first_late < dt.timedelta(hours=1)
    d = tempfile.mkdtemp(prefix="panelcast-alerts-")
    names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    for k, f in enumerate(files):
        pd.DataFrame(f, columns=names).to_parquet(os.path.join(d, f"events_{k}.parquet"), coerce_timestamps="us")
        os.utime(os.path.join(d, f"events_{k}.parquet"), (1_700_000_000 + k, 1_700_000_000 + k))
    stream = proxy.events_panel(spark.readStream.schema(sj.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(d), PROXY_SPEC)
    panel = proxy.events_panel(spark.createDataFrame(pd.DataFrame(rows, columns=names), sj.EVENTS_SCHEMA), PROXY_SPEC)
    fitted = spark.createDataFrame([("1h", 0, 0.9, 0.05, 0.05), ("1h", 1, 0.4, 0.4, 0.2)],
                                   "horizon string, persist_class int, p0 double, p1 double, p2 double")
    got = sj.alert_stream(stream, PROXY_SPEC, fitted, "alerts_test")
    plain = jobs.feature_frame(panel, PROXY_SPEC, method="plain")
    trail = {(r["event_id"], h): r[f"trail_{h}"] for r in plain.collect() for h in ("1h", "3h", "6h")}
    alerts = {(r["event_id"], r["horizon"]): r for r in got.collect()}
    assert alerts.keys() == trail.keys() and got.count() == len(alerts)
    close = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-9)
    assert all(close(alerts[k]["trailing"], v) for k, v in trail.items())
    for (_, h), r in alerts.items():
        c = r["persist_class"]
        p0 = {("1h", 0): 0.9, ("1h", 1): 0.4}.get((h, c), bl.FALLBACK_OWN if c == 0 else bl.FALLBACK_OTHER)
        assert abs(r["p_rain"] - (1 - p0)) < 1e-12
    feats = [c for c in plain.columns if "allstations" in c or "_lag_" in c]
    score = lambda both: jobs.feature_frame(both, PROXY_SPEC).select("station", "TIMESTAMP", "event_id", *feats)
    out = sj.scored_stream(stream, PROXY_SPEC, score, "context_test").latest()
    want = {r["event_id"]: r for r in plain.select("event_id", *feats).collect()}
    have = {r["event_id"]: r for r in out.collect()}
    assert have.keys() == want.keys() and feats
    assert all(close(have[k][c], want[k][c]) for k in want for c in feats)


def test_non_local_master_needs_a_shared_folder():
    import pytest
    from panelcast import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def _write_events(folder, name, rows):
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).to_parquet(
        os.path.join(folder, name), coerce_timestamps="us")


def test_window_totals_over_micro_batches(spark):
    """A bucket that grows in a later batch keeps its newest total; a reading
    behind the watermark is in none of the windows; append mode holds the closed
    windows only. Brute force over the accepted readings."""
    from panelcast.sources import proxy
    d = tempfile.mkdtemp(prefix="panelcast-stream-")
    base = dt.datetime(2024, 1, 1, 12)
    m = lambda k: base + dt.timedelta(minutes=k)     # noqa: E731
    batches = [[(1, m(0), 0, "a", 200.0, ""), (2, m(7), 0, "b", 300.0, ""), (3, m(300), 0, "a", 250.0, "")],
               [(4, m(305), 0, "a", 400.0, ""), (5, m(250), 0, "b", 200.0, "")],
               [(6, m(1), 0, "a", 500.0, ""), (7, m(330), 0, "a", 150.0, "")]]
    for i, rows in enumerate(batches):
        path = f"events_{i}.parquet"
        _write_events(d, path, rows)
        os.utime(os.path.join(d, path), (1_700_000_000 + i, 1_700_000_000 + i))
    accepted = [r for rows in batches for r in rows if r[0] != 6]     # 6 is hours behind the watermark

    def run(mode):
        own = sj.stream_session(spark, 2)
        events = own.readStream.schema(sj.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(d)
        p = proxy.events_panel(events, PROXY_SPEC).withColumn("event_time", F.col("TIMESTAMP").cast("timestamp"))
        out = sj.run_accumulation(p, PROXY_SPEC, "t2-" + mode, mode)
        return {(r["window_len"], r["station"], r["s"], r["e"]): (round(r["rain_sum"], 6), r["n_readings"])
                for r in out.withColumn("s", F.col("window_start").cast("timestamp_ntz"))
                .withColumn("e", F.col("window_end").cast("timestamp_ntz")).collect()}

    want = {}
    for _, ts, _, station, value, _ in accepted:
        bucket = ts.replace(minute=ts.minute // 15 * 15)
        rain = max(0.0, value // 50 - 2) * 0.254
        for name, minutes in (("1h", 60), ("3h", 180), ("6h", 360)):
            for k in range(minutes // 15):
                start = bucket - dt.timedelta(minutes=15 * k)
                key = (name, station, start, start + dt.timedelta(minutes=minutes))
                total, n = want.get(key, (0.0, 0))
                want[key] = (total + rain, n + 1)
    want = {k: (round(v, 6), n) for k, (v, n) in want.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert run("update") == want
    assert run("append") == {k: v for k, v in want.items() if k[3] <= m(330 - 60)}
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_model_submission_covers_the_hold_out(spark):
    from panelcast.plans import registry as R
    sub = R.QUERIES["model_submission"](spark, SF_SMALL)
    held_out = R.labelled(spark, SF_SMALL).filter("is_last_year = 1").count()
    rows = sub.collect()
    assert len(rows) == 3 * held_out and {r["horizon"] for r in rows} == {"1h", "3h", "6h"}
    assert all(r["pred_class"] in (0, 1, 2) and 0 <= r["pred_prob"] <= 1 and r["obs_class"] is not None for r in rows)


def _readings(n, seed=0):
    """Readings of three stations, a minute or so apart, with two that come an hour late and some repeats."""
    base = dt.datetime(2024, 1, 1)
    return [(k, base + dt.timedelta(minutes=k // 3 + (seed * 7) % 5), 0, "abc"[k % 3], 100.0 + 37.0 * ((k * 11) % 29), "") for k in range(n)]


def _put(folder, name, rows, at):
    _write_events(folder, name, rows)
    os.utime(os.path.join(folder, name), (1_700_000_000 + at, 1_700_000_000 + at))


def _stream(spark, folder, event_time=False):
    from panelcast.sources import proxy
    p = proxy.events_panel(spark.readStream.schema(sj.EVENTS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), PROXY_SPEC)
    return p.withColumn("event_time", F.col("TIMESTAMP").cast("timestamp")) if event_time else p


FITTED = ([("1h", 0, 0.9, 0.05, 0.05), ("1h", 1, 0.4, 0.4, 0.2)], "horizon string, persist_class int, p0 double, p1 double, p2 double")


def _alerts(spark, folder, base=None):
    return sj.alert_stream(_stream(spark, folder), PROXY_SPEC, spark.createDataFrame(*FITTED), "restart_test", base=base)


def test_alert_job_goes_on_after_a_restart(spark, monkeypatch):
    """A second run over added files (a late one among them) equals one run over all; readings of the
    first run that nothing changes aren't scored again; a third run without files changes nothing."""
    rows = _readings(400)
    late, rest = rows[200:203], rows[:200] + rows[203:]
    d, one = tempfile.mkdtemp(prefix="panelcast-restart-"), tempfile.mkdtemp(prefix="panelcast-whole-")
    base = tempfile.mkdtemp(prefix="panelcast-job-")
    files = [rest[:150], rest[150:280], rest[280:340] + late + rest[270:275], rest[340:]]
    for k, f in enumerate(files):
        _put(one, f"events_{k}.parquet", f, k)
    want = sorted(map(tuple, _alerts(spark, one).collect()))
    for k in (0, 1):
        _put(d, f"events_{k}.parquet", files[k], k)
    first = _alerts(spark, d, base)
    assert first.count() == 3 * 280 and sorted(map(tuple, first.collect())) != want
    for k in (2, 3):
        _put(d, f"events_{k}.parquet", files[k], k)
    assert sorted(map(tuple, _alerts(spark, d, base).collect())) == want
    table = sj.EpochTable(spark, f"{base}/scores", [])
    assert table.epochs() == [0, 1, 2, 3]
    oldest = min(r[1] for r in late)
    assert table.epoch(2).agg(F.min("TIMESTAMP")).first()[0] == oldest          # from the late reading on, not before
    assert 3 * len(files[3]) <= table.epoch(3).count() <= 3 * (len(files[3]) + 3)      # its own readings, and others of its first minute
    assert sorted(map(tuple, _alerts(spark, d, base).collect())) == want and table.epochs() == [0, 1, 2, 3]
    assert len(sj.EpochTable(spark, f"{base}/history", []).epochs()) <= 2


def test_alert_job_broken_off_repeats_its_batch(spark):
    """The job dies after the scores, or after scores and history, of its second batch; the next run
    repeats the batch under the same epoch and the alerts equal those of an unbroken run."""
    import pytest
    from panelcast.streaming import tables
    rows = _readings(240)
    for after in (1, 2):
        d, base = tempfile.mkdtemp(prefix="panelcast-broken-"), tempfile.mkdtemp(prefix="panelcast-job-")
        for k in range(3):
            _put(d, f"events_{k}.parquet", rows[80 * k:80 * k + 80], k)
        want = sorted(map(tuple, _alerts(spark, d).collect()))
        real, left = tables.EpochTable.write, [after]

        def write(self, df, epoch):
            real(self, df, epoch)
            if epoch == 1:
                left[0] -= 1
                if left[0] == 0:
                    raise RuntimeError("executor lost")

        tables.EpochTable.write = write
        try:
            with pytest.raises(Exception):
                _alerts(spark, d, base)
        finally:
            tables.EpochTable.write = real
        assert sorted(map(tuple, _alerts(spark, d, base).collect())) == want
        assert sj.EpochTable(spark, f"{base}/scores", []).epochs() == [0, 1, 2]


def test_window_totals_go_on_after_a_restart(spark):
    rows = _readings(300)
    d, one, base = (tempfile.mkdtemp(prefix=f"panelcast-{n}-") for n in ("t2", "t2-whole", "t2-job"))
    own = sj.stream_session(spark, 2)

    def totals(folder, base=None):
        out = sj.run_accumulation(_stream(own, folder, True), PROXY_SPEC, "t2-restart", base=base)
        return sorted((r["window_len"], r["station"], str(r["window_start"]), round(r["rain_sum"] or 0, 6), r["n_readings"]) for r in out.collect())

    for k in range(4):
        _put(one, f"events_{k}.parquet", rows[75 * k:75 * k + 75], k)
    for k in range(2):
        _put(d, f"events_{k}.parquet", rows[75 * k:75 * k + 75], k)
    totals(d, base)
    for k in range(2, 4):
        _put(d, f"events_{k}.parquet", rows[75 * k:75 * k + 75], k)
    assert totals(d, base) == totals(one)


def test_epoch_table_is_bounded_by_its_keys(spark):
    """Many epochs that update few keys: compaction keeps the newest rows, in folders bounded by the keys."""
    base = tempfile.mkdtemp(prefix="panelcast-epochs-")
    t = sj.EpochTable(spark, base, ["k"], period=4)
    want = {}
    for e in range(30):
        rows = [(k, e) for k in range(10) if (k + e) % 3]
        want.update(rows)
        t.write(spark.createDataFrame(rows, "k long, v long").coalesce(1), e)
        t.compact(before=e)
        assert t.rows().count() <= 2 * 10 + (4 + 1) * 7 + 7
    assert dict(map(tuple, t.latest().collect())) == want
    assert t.compacted() > 0 and len(t.epochs()) <= 9
    # a compaction that died before it swept: what it replaced is not read twice
    t.latest().write.parquet(f"{base}/compact/upto=29")
    assert t.epochs() == [] and dict(map(tuple, t.latest().collect())) == want
    t.latest(before=29).limit(0).write.parquet(f"{base}/compact/upto=99")
    os.remove(f"{base}/compact/upto=99/_SUCCESS")                       # never finished: doesn't count
    assert dict(map(tuple, t.latest().collect())) == want
    t.sweep()
    assert sorted(os.listdir(f"{base}/rows")) == [] or t._complete("rows") == []


def test_alert_stream_without_readings(spark):
    d = tempfile.mkdtemp(prefix="panelcast-empty-")
    _put(d, "events_0.parquet", [(1, pd.NaT, 0, "a", 1.0, "")], 0)
    got = _alerts(spark, d)
    assert got.count() == 0 and "level" in got.columns
