"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each query starts from the proxy panel over ``events`` and uses plain
``PARTITION BY station`` windows: the reference form our chunked windows must
reproduce. Float results that depend on summation order are rounded to 6
digits on both sides.
"""

from __future__ import annotations

import math

from ..sources.proxy import PANEL_SQL
from ..spec import PROXY_SPEC

SPEC = PROXY_SPEC
HOLDOUT_SQL = "INTERVAL '7 days'"
ORDER = '"TIMESTAMP" ASC NULLS LAST, event_id ASC'
W = f"PARTITION BY station ORDER BY {ORDER}"


def frame(lo: int, hi: int) -> str:
    def b(x: int) -> str:
        if x == 0:
            return "CURRENT ROW"
        return f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"
    return f"({W} ROWS BETWEEN {b(lo)} AND {b(hi)})"


def classify_sql(expr: str, t: float) -> str:
    return (f"CASE WHEN {expr} IS NULL THEN CAST(NULL AS INTEGER) WHEN {expr} = 0 THEN 0 "
            f"WHEN {expr} <= CAST({t} AS DOUBLE) THEN 1 ELSE 2 END")


def _fwd(h) -> str:
    f = frame(1, h.steps)
    return (f"CASE WHEN station IS NOT NULL AND count(Rain_mm_Tot) OVER {f} = {h.steps} "
            f"THEN sum(Rain_mm_Tot) OVER {f} END")


FLAGGED_SQL = f"""
mx AS (SELECT max("TIMESTAMP") AS max_ts FROM panel),
flagged AS (
  SELECT p.*, CAST(year(p."TIMESTAMP") AS INTEGER) AS year,
         coalesce(CAST(p."TIMESTAMP" >= mx.max_ts - {HOLDOUT_SQL} AS INTEGER), 0) AS is_last_year
  FROM panel p CROSS JOIN mx
)"""

def _trail(k: int) -> str:
    f = frame(-(k - 1), 0)
    return f"CASE WHEN station IS NOT NULL AND count(Rain_mm_Tot) OVER {f} = {k} THEN sum(Rain_mm_Tot) OVER {f} END"


def _roll(fn: str, n: int) -> str:
    f = frame(-(n - 1), 0)
    return f"CASE WHEN station IS NOT NULL AND count(Rain_mm_Tot) OVER {f} = {n} THEN {fn}(Rain_mm_Tot) OVER {f} END"


_WINDOWED = (
    [f"{_fwd(h)} AS obs_precip_{h.name}" for h in SPEC.horizons]
    + [f"{_trail(h.steps)} AS trail_{h.name}" for h in SPEC.horizons]
    + [f"CASE WHEN station IS NOT NULL THEN lag(Rain_mm_Tot, {k}) OVER ({W}) END AS Rain_mm_Tot_lag_{k}"
       for k in SPEC.lags]
    + [x for n in SPEC.rolls for x in (f"{_roll('avg', n)} AS Rain_mm_Tot_rollmean_{n}",
                                       f"{_roll('stddev_samp', n)} AS Rain_mm_Tot_rollstd_{n}")]
)
SUMS_SQL = "sums AS (SELECT *, " + ", ".join(_WINDOWED) + " FROM flagged)"

TARGETS_SQL = "targets AS (SELECT *, " + ", ".join(
    f"{classify_sql(f'obs_precip_{h.name}', h.light_threshold)} AS obs_class_{h.name}"
    for h in SPEC.horizons) + " FROM sums)"

LABELLED_SQL = "labelled AS (SELECT * FROM targets WHERE " + " AND ".join(
    f"obs_precip_{h.name} IS NOT NULL AND obs_class_{h.name} IS NOT NULL" for h in SPEC.horizons) + ")"

BASE_CTES = ",\n".join([PANEL_SQL, FLAGGED_SQL, SUMS_SQL, TARGETS_SQL, LABELLED_SQL])


def with_base(body: str, *extra_ctes: str) -> str:
    ctes = BASE_CTES + ("".join(",\n" + c for c in extra_ctes))
    return f"WITH {ctes}\n{body}"


def hash_sql(b: str, j: str, n: str) -> str:
    """The bootstrap draw hash (operators.bootstrap.hash_index) in SQL."""
    seed = f"((CAST({b} AS BIGINT) * 2000003 + CAST({j} AS BIGINT)) % 2147483647)"

    def mix(x: str, rounds) -> str:
        for mul, add, shift in rounds:
            x = f"(({x} * {mul} + {add}) % 2147483647)"
            x = f"xor({x}, {x} >> {shift})"
        return x
    hi = mix(seed, ((48271, 11, 16), (69621, 7, 13)))
    lo = mix(seed, ((40692, 5, 15), (16807, 3, 12)))
    return f"(({hi} * 2147483648 + {lo}) % {n})"


def draws_sql(key: str, bag: str) -> str:
    """Poisson(1) draws of a row in a bag of the forest (operators.forest.draws) in SQL."""
    def mix(x: str, rounds) -> str:
        for mul, add, shift in rounds:
            x = f"(({x} * {mul} + {add}) % 2147483647)"
            x = f"xor({x}, {x} >> {shift})"
        return f"({x} % 2147483647)"
    hi, lo = ((48271, 11, 16), (69621, 7, 13)), ((40692, 5, 15), (16807, 3, 12))
    row = f"((CAST({key} AS BIGINT) % 2147483647 + (CAST({key} AS BIGINT) // 2147483647) % 2147483647 * 7) % 2147483647)"
    own = f"((CAST({bag} AS BIGINT) * 2000003 + 1) % 2147483647)"
    bounds, term, total = [], math.exp(-1), 0.0          # cumulative shares exp(-1) / k! of 2147483647
    for k in range(12):
        total += term / math.factorial(k)
        bounds.append(int(2147483647 * total))
    return (f"SELECT *, {' + '.join(f'CAST(u >= {b} AS BIGINT)' for b in bounds)} AS k FROM "
            f"(SELECT *, {mix('(x * m % 2147483647)', lo)} AS u FROM "
            f"(SELECT *, {mix(row, hi)} AS x, {mix(own, hi)} AS m FROM rows_and_bags))")


def r6(expr: str) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0 (Spark's round never yields -0.0)
    return f"(round({expr}, 6) + CAST(0.0 AS DOUBLE))"


TARGET_OUT = ", ".join(
    f"{r6(f'obs_precip_{h.name}')} AS obs_precip_{h.name}, obs_class_{h.name}" for h in SPEC.horizons)


ORACLE: dict[str, str] = {}

ORACLE["scan_observations"] = f"WITH {PANEL_SQL}\nSELECT station, \"TIMESTAMP\", Rain_mm_Tot, event_id FROM panel"

ORACLE["csv_rejects"] = (
    "SELECT 'TIMESTAMP' AS column_name, event_id || 'h' AS value FROM events WHERE event_id % 211 = 0 UNION ALL "
    "SELECT 'Rain_mm_Tot', event_id || 'x' FROM events WHERE event_id % 50 = 0")

ORACLE["holdout_flag"] = with_base(
    'SELECT event_id, station, "TIMESTAMP", year, is_last_year FROM flagged')

ORACLE["rain_leads"] = f"WITH {PANEL_SQL}\nSELECT event_id, station, " + ", ".join(
    f"CASE WHEN station IS NOT NULL THEN lead(Rain_mm_Tot, {k}) OVER ({W}) END AS Rain_mm_Tot_lead_{k}"
    for k in range(1, SPEC.max_forward + 1)) + " FROM panel"

ORACLE["obs_precip"] = with_base(
    "SELECT event_id, station, " + ", ".join(
        f"{r6(f'obs_precip_{h.name}')} AS obs_precip_{h.name}" for h in SPEC.horizons) + " FROM sums")

ORACLE["obs_class"] = with_base(
    "SELECT event_id, station, " + ", ".join(f"obs_class_{h.name}" for h in SPEC.horizons) + " FROM targets")

ORACLE["complete_horizons"] = with_base(
    f'SELECT event_id, station, "TIMESTAMP", Rain_mm_Tot, year, is_last_year, {TARGET_OUT} FROM labelled')

ORACLE["class_distribution"] = with_base("""
SELECT horizon, obs_class, n, n / sum(n) OVER (PARTITION BY horizon) AS share
FROM (
  SELECT horizon, obs_class, count(*) AS n FROM (
    """ + "\n    UNION ALL ".join(
        f"SELECT '{h.name}' AS horizon, obs_class_{h.name} AS obs_class FROM labelled" for h in SPEC.horizons) + """
  ) WHERE obs_class IS NOT NULL GROUP BY horizon, obs_class
)""")


# --- labelling variants, sorts, splits, summaries -------------------------------

ORACLE["horizon_wide"] = ORACLE["complete_horizons"]

for _key, _h in (("horizon_dataset_1h", "1h"), ("horizon_dataset", "3h"), ("horizon_dataset_6h", "6h")):
    ORACLE[_key] = with_base(
        'SELECT station, "TIMESTAMP", Rain_mm_Tot, event_id, year, is_last_year, '
        f"{r6(f'obs_precip_{_h}')} AS obs_precip_{_h}, obs_class_{_h} FROM labelled")

LONG_TARGETS = "long_targets AS (" + " UNION ALL ".join(
    f"SELECT event_id, station, \"TIMESTAMP\", is_last_year, '{h.name}' AS horizon, obs_precip_{h.name} AS obs_precip, "
    f"obs_class_{h.name} AS obs_class FROM labelled" for h in SPEC.horizons) + ")"

ORACLE["horizon_long"] = with_base(
    f'SELECT event_id, station, "TIMESTAMP", horizon, {r6("obs_precip")} AS obs_precip, obs_class FROM long_targets',
    LONG_TARGETS)

ORACLE["csv_roundtrip"] = ORACLE["scan_observations"]

ORACLE["sorted_panel"] = (f"WITH {PANEL_SQL}\nSELECT row_number() OVER (ORDER BY station ASC NULLS LAST, {ORDER}) - 1 "
                          'AS row_index, event_id, station, "TIMESTAMP" FROM panel')

ORACLE["preview"] = with_base(
    'SELECT "TIMESTAMP", station, ' + ", ".join(
        f"{r6(f'obs_precip_{h.name}')} AS obs_precip_{h.name}, obs_class_{h.name}" for h in SPEC.horizons)
    + ', is_last_year FROM labelled ORDER BY station ASC NULLS LAST, "TIMESTAMP" ASC NULLS LAST, event_id LIMIT 5')

ORACLE["train_test_split"] = with_base(
    "SELECT event_id, station, CASE WHEN is_last_year = 1 THEN 'test' ELSE 'train' END AS split FROM labelled "
    "WHERE is_last_year IN (0, 1)")

ORACLE["station_counts"] = with_base("SELECT station, count(*) AS n FROM labelled GROUP BY station")
ORACLE["split_counts"] = with_base("SELECT is_last_year, count(*) AS n FROM labelled GROUP BY is_last_year")

_N_MASTER_COLS = 12  # station, TIMESTAMP, Rain, event_id, year, is_last_year + 6 targets
ORACLE["dataset_summary"] = with_base(f"""
SELECT 'shape' AS section, 'master' AS item, CAST(count(*) AS DOUBLE) AS rows, CAST({_N_MASTER_COLS} AS DOUBLE) AS value FROM labelled
UNION ALL """ + " UNION ALL ".join(
    f"SELECT 'shape', 'dataset_{h.name}', CAST(count(*) AS DOUBLE), CAST({_N_MASTER_COLS - 2 * (len(SPEC.horizons) - 1)} AS DOUBLE) FROM labelled"
    for h in SPEC.horizons) + """
UNION ALL
SELECT 'class_share', horizon || ':' || CAST(obs_class AS VARCHAR), CAST(n AS DOUBLE), n / sum(n) OVER (PARTITION BY horizon)
FROM (SELECT horizon, obs_class, count(*) AS n FROM long_targets GROUP BY ALL)
UNION ALL
SELECT 'station', coalesce(station, 'nan'), CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM labelled GROUP BY station
UNION ALL
SELECT 'split', CAST(is_last_year AS VARCHAR), CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM labelled GROUP BY is_last_year
""", LONG_TARGETS)


# --- features ----------------------------------------------------------------------

ORACLE["time_features"] = f"""WITH {PANEL_SQL}
SELECT event_id, station, CAST(year("TIMESTAMP") AS INTEGER) AS year, CAST(hour("TIMESTAMP") AS INTEGER) AS hour,
       CAST(isodow("TIMESTAMP") - 1 AS INTEGER) AS day_of_week, CAST(month("TIMESTAMP") AS INTEGER) AS month,
       {r6('sin(CAST(2 * pi() AS DOUBLE) * hour("TIMESTAMP") / CAST(24.0 AS DOUBLE))')} AS hour_sin,
       {r6('cos(CAST(2 * pi() AS DOUBLE) * hour("TIMESTAMP") / CAST(24.0 AS DOUBLE))')} AS hour_cos
FROM panel"""

ORACLE["rain_lags"] = with_base("SELECT event_id, station, " + ", ".join(
    f"Rain_mm_Tot_lag_{k}" for k in SPEC.lags) + " FROM sums")

ORACLE["rain_rolling"] = with_base("SELECT event_id, station, " + ", ".join(
    f"{r6(f'Rain_mm_Tot_{s}_{n}')} AS Rain_mm_Tot_{s}_{n}" for n in SPEC.rolls for s in ("rollmean", "rollstd"))
    + " FROM sums")

CROSS_SQL = """
grid AS (
  SELECT station, time_bucket(INTERVAL '15 minutes', "TIMESTAMP") AS bucket_ts, sum(Rain_mm_Tot) AS Rain_mm_Tot
  FROM panel WHERE "TIMESTAMP" IS NOT NULL GROUP BY ALL
),
cs AS (
  SELECT station, bucket_ts, Rain_mm_Tot,
         avg(Rain_mm_Tot) OVER b AS rain_allstations_mean_t,
         max(Rain_mm_Tot) OVER b AS rain_allstations_max_t,
         min(Rain_mm_Tot) OVER b AS rain_allstations_min_t,
         stddev_samp(Rain_mm_Tot) OVER b AS rain_allstations_std_t,
         sum(Rain_mm_Tot) OVER b AS rain_allstations_sum_t,
         CASE WHEN Rain_mm_Tot IS NULL
              THEN CASE WHEN count(Rain_mm_Tot) OVER b > 0 THEN sum(Rain_mm_Tot) OVER b / count(Rain_mm_Tot) OVER b END
              ELSE CASE WHEN count(Rain_mm_Tot) OVER b > 1
                        THEN (sum(Rain_mm_Tot) OVER b - Rain_mm_Tot) / (count(Rain_mm_Tot) OVER b - 1) END
         END AS rain_otherstations_mean_t
  FROM grid WHERE station IS NOT NULL
  WINDOW b AS (PARTITION BY bucket_ts)
)"""
CROSS_COLS = ["rain_allstations_mean_t", "rain_allstations_max_t", "rain_allstations_min_t",
              "rain_allstations_std_t", "rain_allstations_sum_t", "rain_otherstations_mean_t"]

ORACLE["cross_station"] = with_base(
    "SELECT station, bucket_ts, " + ", ".join(r6(c) + f" AS {c}" for c in ["Rain_mm_Tot", *CROSS_COLS]) + " FROM cs",
    CROSS_SQL)

FEATURES_SQL = """
feat AS (
  SELECT l.*, CAST(hour(l."TIMESTAMP") AS INTEGER) AS hour, CAST(isodow(l."TIMESTAMP") - 1 AS INTEGER) AS day_of_week,
         CAST(month(l."TIMESTAMP") AS INTEGER) AS month,
         sin(CAST(2 * pi() AS DOUBLE) * hour(l."TIMESTAMP") / CAST(24.0 AS DOUBLE)) AS hour_sin,
         cos(CAST(2 * pi() AS DOUBLE) * hour(l."TIMESTAMP") / CAST(24.0 AS DOUBLE)) AS hour_cos,
         """ + ", ".join(f"c.{c}" for c in CROSS_COLS) + """
  FROM labelled l
  LEFT JOIN cs c ON l.station = c.station
   AND c.bucket_ts = time_bucket(INTERVAL '15 minutes', l."TIMESTAMP") - INTERVAL '15 minutes'
)"""

_FEATURE_NUMS = (["Rain_mm_Tot", "year"] + [f"trail_{h.name}" for h in SPEC.horizons]
                 + [f"Rain_mm_Tot_lag_{k}" for k in SPEC.lags]
                 + [f"Rain_mm_Tot_{s}_{n}" for n in SPEC.rolls for s in ("rollmean", "rollstd")]
                 + ["hour", "day_of_week", "month", "hour_sin", "hour_cos"] + CROSS_COLS)
_INTS = {"year", "is_last_year", "hour", "day_of_week", "month"}
for _key, _h in (("feature_matrix", "1h"), ("feature_matrix_3h", "3h"), ("feature_matrix_6h", "6h")):
    ORACLE[_key] = with_base(
        "SELECT event_id, station, " + ", ".join(c if c in _INTS else f"{r6(c)} AS {c}" for c in _FEATURE_NUMS)
        + f", obs_class_{_h} FROM feat", CROSS_SQL, FEATURES_SQL)


# --- baselines, submission, metrics -----------------------------------------------

_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT event_id, station, \"TIMESTAMP\", is_last_year, '{h.name}' AS horizon, obs_precip_{h.name} AS obs_precip, "
    f"obs_class_{h.name} AS obs_class, coalesce({classify_sql(f'trail_{h.name}', h.light_threshold)}, 0) AS persist_class "
    "FROM labelled" for h in SPEC.horizons) + ")"


def _probs(keys: str, src: str) -> str:
    return (f"SELECT {keys}, " + ", ".join(
        f"coalesce(max(CASE WHEN obs_class = {c} THEN p END), CAST(0.0 AS DOUBLE)) AS p{c}" for c in range(3))
        + f" FROM (SELECT *, n / sum(n) OVER (PARTITION BY {keys}) AS p FROM {src}) GROUP BY {keys}")


BASELINE_SQL = ",\n".join([
    _LONG,
    "pcounts AS (SELECT horizon, persist_class, obs_class, count(*) AS n FROM long WHERE is_last_year = 0 GROUP BY ALL)",
    f"pfit AS ({_probs('horizon, persist_class', 'pcounts')})",
    "ccounts AS (SELECT horizon, obs_class, count(*) AS n FROM long WHERE is_last_year = 0 GROUP BY ALL)",
    f"cfit AS ({_probs('horizon', 'ccounts')})",
    "cmajor AS (SELECT horizon, obs_class AS major_class FROM (SELECT *, row_number() OVER "
    "(PARTITION BY horizon ORDER BY n DESC, obs_class ASC) AS r FROM ccounts) WHERE r = 1)",
    "pers AS (SELECT l.*, l.persist_class AS pred_class, " + ", ".join(
        f"coalesce(f.p{c}, CASE WHEN l.persist_class = {c} THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END) AS p{c}"
        for c in range(3)) + ", 'persistence' AS model FROM long l LEFT JOIN pfit f USING (horizon, persist_class))",
    "clim AS (SELECT l.*, m.major_class AS pred_class, f.p0, f.p1, f.p2, 'climatology' AS model "
    "FROM long l LEFT JOIN cfit f USING (horizon) LEFT JOIN cmajor m USING (horizon))",
    "scored AS (SELECT *, CASE pred_class WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 END AS pred_prob, "
    "CAST(1.0 AS DOUBLE) - p0 AS p_rain FROM (SELECT * FROM pers UNION ALL BY NAME SELECT * FROM clim))",
    "test AS (SELECT * FROM scored WHERE is_last_year = 1)",
])


def metric_ctes(src: str, keys: str, prefix: str = "") -> list[str]:
    p = prefix
    return [
        f"{p}conf AS (SELECT {keys}, obs_class AS label, pred_class AS pred, count(*) AS n FROM {src} "
        f"WHERE obs_class IS NOT NULL AND pred_class IS NOT NULL GROUP BY ALL)",
        f"{p}roles AS (SELECT {keys}, label AS cls, n AS t, 0 AS p, CASE WHEN label = pred THEN n ELSE 0 END AS tp "
        f"FROM {p}conf UNION ALL SELECT {keys}, pred AS cls, 0 AS t, n AS p, 0 AS tp FROM {p}conf)",
        f"{p}pc AS (SELECT {keys}, cls, sum(tp) AS tp, sum(t) AS support, sum(p) AS predicted, "
        "CASE WHEN sum(p) > 0 THEN sum(tp) / sum(p) ELSE CAST(0.0 AS DOUBLE) END AS precision, "
        "CASE WHEN sum(t) > 0 THEN sum(tp) / sum(t) ELSE CAST(0.0 AS DOUBLE) END AS recall, "
        "CASE WHEN sum(t) + sum(p) > 0 THEN 2 * sum(tp) / (sum(t) + sum(p)) ELSE CAST(0.0 AS DOUBLE) END AS f1 "
        f"FROM {p}roles GROUP BY ALL)",
        f"{p}summ AS (SELECT {keys}, sum(tp) / sum(support) AS accuracy, avg(f1) AS f1_macro, "
        "sum(f1 * support) / sum(support) AS f1_weighted, 2 * sum(tp) / (sum(support) + sum(predicted)) AS f1_micro, "
        f"CAST(sum(support) AS BIGINT) AS n_rows FROM {p}pc GROUP BY ALL)",
    ]


def with_metrics(body: str, *extra: str) -> str:
    return with_base(body, BASELINE_SQL, *metric_ctes("test", "model, horizon"), *extra)


ORACLE["submission"] = with_base(
    "SELECT horizon, strftime(\"TIMESTAMP\", '%Y-%m-%d %H:%M:%S') AS timestamp, station AS station_id, "
    f"CAST(pred_class AS INTEGER) AS pred_class, {r6('pred_prob')} AS pred_prob, CAST(obs_class AS INTEGER) AS obs_class, "
    f"{r6('obs_precip')} AS obs_precip_mm FROM test WHERE model = 'persistence'", BASELINE_SQL)

ORACLE["submission_files"] = ORACLE["submission"]

ORACLE["pred_prob"] = with_base(
    f"SELECT event_id, horizon, pred_class, {r6('list_extract([p0, p1, p2], pred_class + 1)')} AS pred_prob, "
    f"{r6('p_rain')} AS p_rain FROM test WHERE model = 'persistence'", BASELINE_SQL)

for _m in ("accuracy", "f1_macro", "f1_weighted", "f1_micro"):
    ORACLE[_m] = with_metrics(f"SELECT model, horizon, {r6(_m)} AS {_m} FROM summ")

ORACLE["baseline_results"] = with_metrics(
    "SELECT model, horizon, " + ", ".join(f"{r6(c)} AS {c}" for c in ("accuracy", "f1_macro", "f1_weighted"))
    + " FROM summ")

ORACLE["metrics_rounded"] = with_metrics(
    "SELECT model, horizon, round_even(accuracy, 4) AS accuracy, round_even(f1_macro, 4) AS f1_macro, "
    "round_even(f1_weighted, 4) AS f1_weighted, CAST(round(round_even(accuracy, 4) * 100) AS INTEGER) AS accuracy_pct "
    "FROM summ")

ORACLE["classification_report"] = with_metrics("""
SELECT model, horizon, CAST(cls AS VARCHAR) AS item, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1_score, CAST(support AS BIGINT) AS support FROM pc
UNION ALL
SELECT model, horizon, 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), round(sum(tp) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pc GROUP BY ALL
UNION ALL
SELECT model, horizon, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM pc GROUP BY ALL
UNION ALL
SELECT model, horizon, 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pc GROUP BY ALL""")

ORACLE["confusion_matrix"] = with_metrics("""
SELECT l.model, l.horizon, l.cls AS obs_class, """ + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN c.pred = {k} THEN c.n END), 0) AS BIGINT) AS pred_{k}" for k in range(3)) + """
FROM (SELECT DISTINCT model, horizon, label AS cls FROM conf UNION SELECT DISTINCT model, horizon, pred FROM conf) l
LEFT JOIN conf c ON c.model = l.model AND c.horizon = l.horizon AND c.label = l.cls
GROUP BY l.model, l.horizon, l.cls""")

ORACLE["prediction_distribution"] = with_metrics("""
SELECT model, horizon, pred_class, n, n / sum(n) OVER (PARTITION BY model, horizon) AS share
FROM (SELECT model, horizon, pred_class, count(*) AS n FROM test WHERE pred_class IS NOT NULL GROUP BY ALL)""")

ORACLE["overfitting_gap"] = with_base(
    "SELECT s.model, s.horizon, " + ", ".join(f"{r6('s.' + c)} AS {c}" for c in ("accuracy", "f1_macro", "f1_micro", "f1_weighted"))
    + f", {r6('t.f1_macro')} AS f1_macro_train, {r6('t.f1_macro - s.f1_macro')} AS overfitting_gap, s.n_rows AS test_rows "
    "FROM summ s LEFT JOIN tr_summ t USING (model, horizon)",
    BASELINE_SQL, *metric_ctes("test", "model, horizon"),
    "train AS (SELECT * FROM scored WHERE is_last_year = 0)", *metric_ctes("train", "model, horizon", "tr_"))

BEST_SQL = ("best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY f1_macro DESC, "
            "model ASC) AS r FROM summ) WHERE r = 1)")

ORACLE["best_model"] = with_metrics(f"SELECT horizon, model AS best_model, {r6('f1_macro')} AS f1_macro FROM best",
                                    BEST_SQL)

ORACLE["metric_card"] = with_metrics(
    "SELECT horizon, round_even(accuracy, 4) AS accuracy, round_even(f1_weighted, 4) AS f1_weighted, "
    "round_even(f1_macro, 4) AS f1_macro, model AS best_model, n_rows AS test_rows FROM best", BEST_SQL)


# --- bootstrap -----------------------------------------------------------------------

B_REPLICATES = 1000
BOOT_SQL = [
    "bcells AS (SELECT horizon, obs_class AS label, pred_class AS pred, count(*) AS c FROM test "
    "WHERE model = 'persistence' AND obs_class IS NOT NULL AND pred_class IS NOT NULL GROUP BY ALL)",
    "bounds AS (SELECT *, CAST(sum(c) OVER (PARTITION BY horizon ORDER BY label, pred ROWS UNBOUNDED PRECEDING) - c "
    "AS BIGINT) AS lo, CAST(sum(c) OVER (PARTITION BY horizon) AS BIGINT) AS n FROM bcells)",
    "sizes AS (SELECT DISTINCT horizon, n FROM bounds)",
    f"draws AS (SELECT s.horizon, r.b, {hash_sql('r.b', 'j.j', 's.n')} AS idx "
    f"FROM sizes s, range({B_REPLICATES}) r(b), LATERAL (SELECT * FROM range(s.n) u(j)) j)",
    "bsrc AS (SELECT d.horizon, d.b, k.label AS obs_class, k.pred AS pred_class FROM draws d "
    "JOIN bounds k ON d.horizon = k.horizon AND d.idx >= k.lo AND d.idx < k.lo + k.c)",
    *metric_ctes("bsrc", "horizon, b", "b_"),
]

ORACLE["bootstrap_macro_f1"] = with_base(f"SELECT horizon, b, {r6('f1_macro')} AS f1_macro FROM b_summ",
                                         BASELINE_SQL, *BOOT_SQL)

ORACLE["bootstrap_ci"] = with_base(
    f"SELECT r.horizon, {r6('avg(f1_macro)')} AS macro_f1_mean, {r6('quantile_cont(f1_macro, 0.025)')} AS ci_2_5, "
    f"{r6('quantile_cont(f1_macro, 0.975)')} AS ci_97_5, count(*) AS B, max(s.n) AS n_test "
    "FROM b_summ r JOIN sizes s USING (horizon) GROUP BY r.horizon",
    BASELINE_SQL, *BOOT_SQL)


def _mix_sql(x: str, rounds) -> str:
    for mul, add, shift in rounds:
        x = f"(({x} * {mul} + {add}) % 2147483647)"
        x = f"xor({x}, {x} >> {shift})"
    return f"({x} % 2147483647)"


_HI, _LO = ((48271, 11, 16), (69621, 7, 13)), ((40692, 5, 15), (16807, 3, 12))


def uniform_sql(m: str, j: str) -> str:
    """The j-th uniform number of a replicate (operators.bootstrap.uniform)."""
    own = _mix_sql(f"((CAST({j} AS BIGINT) * 2000003 + 1) % 2147483647)", _HI)
    y = f"(({m} * {own}) % 2147483647)"
    return f"(({_mix_sql(y, _LO)} + CAST(0.5 AS DOUBLE)) / CAST(2147483647 AS DOUBLE))"


# Binomial(n, p) of the rows (n, p, u, v), as operators.bootstrap.binomial draws it.
BINOMIAL_SQL = """CASE WHEN p >= 1 THEN n WHEN n * least(p, q) < 30 THEN CASE WHEN p <= q THEN least(x, n) ELSE n - least(x, n) END
  ELSE greatest(0, least(n, CAST(floor(n * p + sqrt(n * p * q) * z + ((q - p) / 6) * (z * z - 1) + CAST(0.5 AS DOUBLE)) AS BIGINT))) END"""
_INVERSION = """list_reduce(list_prepend({'k': CAST(0 AS DOUBLE), 'pmf': pmf0, 'cdf': pmf0, 'x': CAST(0 AS BIGINT)},
  list_transform(range(1, 121), lambda k: {'k': CAST(k AS DOUBLE), 'pmf': CAST(0 AS DOUBLE), 'cdf': CAST(0 AS DOUBLE), 'x': CAST(0 AS BIGINT)})),
  lambda acc, e: {'k': e.k, 'pmf': acc.pmf * (n - e.k + 1) / e.k * ratio, 'cdf': acc.cdf + acc.pmf * (n - e.k + 1) / e.k * ratio,
                  'x': acc.x + CAST(acc.cdf < u AS BIGINT)}).x"""
MULTINOMIAL_SQL = [
    BOOT_SQL[0],
    "ordered AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY label, pred) - 1 AS idx, dense_rank() OVER (ORDER BY horizon) - 1 "
    "AS nth, CAST(sum(c) OVER (PARTITION BY horizon ORDER BY label DESC, pred DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS remaining FROM bcells)",
    f"uniforms AS (SELECT o.*, CAST(c AS DOUBLE) / remaining AS p, r.b, m, {uniform_sql('m', '2 * (64 * nth + idx)')} AS u, "
    f"{uniform_sql('m', '2 * (64 * nth + idx) + 1')} AS v FROM ordered o, (SELECT b, {_mix_sql('((b + 1) % 2147483647)', _HI)} AS m "
    f"FROM range({B_REPLICATES}) AS t(b)) r)",
    "drawn_cells AS (SELECT horizon, CAST(-1 AS BIGINT) AS idx, b, CAST(0 AS INTEGER) AS label, CAST(0 AS INTEGER) AS pred, "
    "CAST(0 AS BIGINT) AS k, max(remaining) AS rest FROM uniforms GROUP BY horizon, b UNION ALL "
    "SELECT horizon, idx, b, label, pred, k, n - k AS rest FROM (SELECT horizon, idx, b, label, pred, n, " + BINOMIAL_SQL + " AS k FROM ("
    "SELECT *, " + _INVERSION + " AS x FROM (SELECT *, exp(n * ln(1 - least(p, q))) AS pmf0, least(p, q) / (1 - least(p, q)) AS ratio, "
    "sqrt(CAST(-2 AS DOUBLE) * ln(u)) * cos(2 * pi() * v) AS z FROM ("
    "SELECT d.horizon, w.idx, d.b, w.label, w.pred, d.rest AS n, w.p, CAST(1 AS DOUBLE) - w.p AS q, w.u, w.v "
    "FROM drawn_cells d JOIN uniforms w ON w.horizon = d.horizon AND w.b = d.b AND w.idx = d.idx + 1)))))",
]
ORACLE["bootstrap_cells"] = with_base("SELECT horizon, b, label, pred, k AS n FROM drawn_cells WHERE idx >= 0", BASELINE_SQL,
                                      *MULTINOMIAL_SQL).replace("WITH ", "WITH RECURSIVE ", 1)
ORACLE["bootstrap_multinomial"] = with_base(
    f"SELECT horizon, {r6('avg(f1_macro)')} AS macro_f1_mean, {r6('quantile_cont(f1_macro, 0.025)')} AS ci_2_5, "
    f"{r6('quantile_cont(f1_macro, 0.975)')} AS ci_97_5, count(*) AS B, max(n_test) AS n_test FROM ("
    "SELECT horizon, b, avg(f1) AS f1_macro, CAST(sum(t) AS BIGINT) AS n_test FROM (SELECT horizon, b, cls, sum(t) AS t, "
    "2 * CAST(sum(tp) AS DOUBLE) / (sum(t) + sum(p)) AS f1 FROM ("
    "SELECT horizon, b, label AS cls, k AS t, 0 AS p, CASE WHEN label = pred THEN k ELSE 0 END AS tp FROM drawn_cells WHERE idx >= 0 AND k > 0 "
    "UNION ALL SELECT horizon, b, pred, 0, k, 0 FROM drawn_cells WHERE idx >= 0 AND k > 0) GROUP BY horizon, b, cls) GROUP BY horizon, b) "
    "GROUP BY horizon", BASELINE_SQL, *MULTINOMIAL_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


# --- modelling ------------------------------------------------------------------------

_MED_NUMS = [c for c in _FEATURE_NUMS]
for _key in ("impute_median", "impute_median_3h", "impute_median_6h"):       # the features don't depend on the horizon
    ORACLE[_key] = with_base(
        "SELECT column_name, " + r6("median") + " AS median FROM (" + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, CAST(median({c}) AS DOUBLE) AS median FROM feat WHERE is_last_year = 0"
            for c in _MED_NUMS) + ") WHERE median IS NOT NULL", CROSS_SQL, FEATURES_SQL)

# the vector's slots: numeric columns by name that have a training median, then the training stations by name
ORACLE["assembled_vector"] = with_base(
    "SELECT event_id, CAST(slot AS INTEGER) AS slot, " + r6("v") + " AS value FROM ("
    "SELECT event_id, (SELECT count(*) FROM med m WHERE m.median IS NOT NULL AND m.c < n.c) AS slot, coalesce(v, median) AS v FROM ("
    + " UNION ALL ".join(f"SELECT event_id, '{c}' AS c, CAST({c} AS DOUBLE) AS v FROM feat WHERE is_last_year = 1" for c in sorted(_MED_NUMS))
    + ") n JOIN med USING (c) WHERE median IS NOT NULL UNION ALL "
    "SELECT event_id, (SELECT count(*) FROM med WHERE median IS NOT NULL) + k.nth, CAST(f.station IS NOT DISTINCT FROM k.station AS DOUBLE) "
    "FROM feat f, known k WHERE is_last_year = 1)", CROSS_SQL, FEATURES_SQL,
    "med AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, CAST(median({c}) AS DOUBLE) AS median FROM feat WHERE is_last_year = 0" for c in _MED_NUMS) + ")",
    "known AS (SELECT station, row_number() OVER (ORDER BY station) - 1 AS nth FROM (SELECT DISTINCT station FROM feat "
    "WHERE is_last_year = 0 AND station IS NOT NULL))")

ORACLE["impute_mode"] = with_base(
    "SELECT station, count(*) AS n FROM labelled WHERE is_last_year = 0 AND station IS NOT NULL "
    "GROUP BY station ORDER BY n DESC, station ASC LIMIT 1")

ORACLE["one_hot_station"] = with_base(
    "SELECT l.event_id, l.station, array_to_string(list_transform(k.names, lambda s: CASE WHEN s = l.station THEN '1' "
    "ELSE '0' END), '') AS station_onehot FROM labelled l, known k",
    "known AS (SELECT list(station ORDER BY station) AS names FROM (SELECT DISTINCT station FROM labelled "
    "WHERE is_last_year = 0 AND station IS NOT NULL))")

ORACLE["class_weights"] = with_base(
    "SELECT horizon, obs_class, n_c, sum(n_c) OVER (PARTITION BY horizon) / "
    "(count(*) OVER (PARTITION BY horizon) * n_c) AS weight FROM (SELECT horizon, obs_class, count(*) AS n_c "
    "FROM long_targets WHERE is_last_year = 0 AND obs_class IS NOT NULL GROUP BY ALL)", LONG_TARGETS)


ORACLE["forest_bag_weights"] = with_base(f"""
SELECT bag, obs_class, n_draws, {r6('sum(n_draws) OVER (PARTITION BY bag) / (count(*) OVER (PARTITION BY bag) * n_draws)')} AS weight
FROM (SELECT bag, obs_class, CAST(sum(k) AS BIGINT) AS n_draws FROM drawn WHERE k > 0 GROUP BY bag, obs_class)""",
    "rows_and_bags AS (SELECT event_id, obs_class_1h AS obs_class, CAST(bag AS INTEGER) AS bag FROM labelled, range(300) AS b(bag) "
    "WHERE is_last_year = 0 AND obs_class_1h IS NOT NULL)",
    "drawn AS (" + draws_sql("event_id", "bag") + ")")


# --- dashboard products ---------------------------------------------------------------

PRODUCT_SQL = [
    "newest AS (SELECT *, \"TIMESTAMP\" >= max(\"TIMESTAMP\") OVER () - INTERVAL '1 hour' AS active FROM (SELECT *, "
    "row_number() OVER (PARTITION BY station ORDER BY \"TIMESTAMP\" DESC, event_id DESC) AS rn FROM sums "
    "WHERE \"TIMESTAMP\" IS NOT NULL AND station IS NOT NULL) WHERE rn = 1)",
    "newlong AS (" + " UNION ALL ".join(
        f"SELECT station, \"TIMESTAMP\", active, '{h.name}' AS horizon, "
        f"coalesce({classify_sql(f'trail_{h.name}', h.light_threshold)}, 0) AS pred_class FROM newest"
        for h in SPEC.horizons) + ")",
    "newprob AS (SELECT l.*, " + ", ".join(
        f"coalesce(f.p{c}, CASE WHEN l.pred_class = {c} THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END) AS p{c}"
        for c in range(3)) + " FROM newlong l LEFT JOIN pfit f ON f.horizon = l.horizon AND f.persist_class = l.pred_class)",
    "now_all AS (SELECT *, CASE pred_class WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 END AS pred_prob, "
    "CAST(1.0 AS DOUBLE) - p0 AS p_rain FROM newprob)",
    "now AS (SELECT * FROM now_all WHERE active)",
    "sidx AS (SELECT horizon, station, p_rain AS v, row_number() OVER (PARTITION BY horizon ORDER BY station) - 1 "
    "AS idx, count(*) OVER (PARTITION BY horizon) AS n FROM now)",
    "ssizes AS (SELECT DISTINCT horizon, n FROM sidx)",
    f"sdraws AS (SELECT s.horizon, r.b, {hash_sql('r.b', 'j.j', 's.n')} AS idx "
    f"FROM ssizes s, range({B_REPLICATES}) r(b), LATERAL (SELECT * FROM range(s.n) u(j)) j)",
    "sreps AS (SELECT d.horizon, d.b, avg(i.v) AS rep_mean FROM sdraws d JOIN sidx i USING (horizon, idx) GROUP BY ALL)",
    "sci AS (SELECT horizon, quantile_cont(rep_mean, 0.05) AS ci_lower, quantile_cont(rep_mean, 0.95) AS ci_upper "
    "FROM sreps GROUP BY horizon)",
    "card AS (SELECT n.horizon, strftime(max(n.\"TIMESTAMP\"), '%Y-%m-%d %H:%M:%S') AS timestamp, "
    "max(n.pred_class) AS pred_class, max(n.pred_class) > 0 AS will_rain, avg(n.p_rain) AS probability, "
    "avg(n.pred_prob) AS pred_prob_mean, CASE max(n.pred_class) WHEN 0 THEN 'Sin lluvia' WHEN 1 THEN 'Ligera' "
    "WHEN 2 THEN 'Moderada/Intensa' END AS intensity, any_value(c.ci_lower) AS ci_lower, "
    "any_value(c.ci_upper) AS ci_upper, CAST(0.9 AS DOUBLE) AS ci_level, "
    "CASE n.horizon " + " ".join(f"WHEN '{h.name}' THEN {h.minutes}" for h in SPEC.horizons) + " END AS horizon_minutes, "
    "count(*) AS n_stations, 'persistence ' || n.horizon AS model_version "
    "FROM now n LEFT JOIN sci c USING (horizon) GROUP BY n.horizon)",
]


def with_products(body: str, *extra: str) -> str:
    return with_base(body, BASELINE_SQL, *PRODUCT_SQL, *extra)


ORACLE["horizon_card"] = with_products(
    "SELECT horizon, timestamp, pred_class, will_rain, " + ", ".join(
        f"{r6(c)} AS {c}" for c in ("probability", "pred_prob_mean")) + ", intensity, "
    + ", ".join(f"{r6(c)} AS {c}" for c in ("ci_lower", "ci_upper")) + ", ci_level, horizon_minutes, n_stations, "
    "model_version FROM card")

ORACLE["station_panel"] = with_products("""
SELECT n.horizon, n.station AS station_id, r.status, r.trend, """ + r6("r.last_reading") + """ AS last_reading,
       """ + r6("n.p_rain") + """ AS probability, n.pred_class, r.recent_mm_x1000,
       CAST(sum(CASE WHEN r.status = 'active' THEN 1 ELSE 0 END) OVER (PARTITION BY n.horizon) AS BIGINT) AS n_active,
       count(*) OVER (PARTITION BY n.horizon) AS n_stations
FROM now_all n JOIN rec2 r ON r.station = n.station""",
    "top4 AS (SELECT * FROM (SELECT station, \"TIMESTAMP\", Rain_mm_Tot, row_number() OVER (PARTITION BY station "
    "ORDER BY \"TIMESTAMP\" DESC, event_id DESC) AS rn FROM panel WHERE \"TIMESTAMP\" IS NOT NULL AND station IS NOT NULL) "
    "WHERE rn <= 4)",
    "rec AS (SELECT station, string_agg(coalesce(CAST(CAST(round(Rain_mm_Tot * 1000) AS BIGINT) AS VARCHAR), 'NA'), ',' "
    "ORDER BY rn DESC) AS recent_mm_x1000, max(CASE WHEN rn = 1 THEN Rain_mm_Tot END) AS last_reading, "
    "max(CASE WHEN rn = 1 THEN \"TIMESTAMP\" END) AS last_ts, (list(Rain_mm_Tot ORDER BY rn DESC))[1] AS oldest "
    "FROM top4 GROUP BY station)",
    "rec2 AS (SELECT *, CASE WHEN last_reading > oldest THEN 'up' WHEN last_reading < oldest THEN 'down' "
    "ELSE 'stable' END AS trend, CASE WHEN last_ts >= max(last_ts) OVER () - INTERVAL '1 hour' THEN 'active' "
    "ELSE 'warning' END AS status FROM rec)")

ORACLE["network_series"] = with_products("""
SELECT CAST(NULL AS VARCHAR) AS horizon, CASE WHEN m = 0 THEN 'Ahora' ELSE CAST(m AS VARCHAR) || 'min' END AS time,
       m AS offset_min, """ + ", ".join(f"{r6(c)} AS {c}" for c in ("avg", "q10", "q90")) + """, false AS forecast
FROM (SELECT h.*, CAST(datediff('minute', lb.last, h.bucket_ts) AS INTEGER) AS m FROM hist h, lastb lb)
UNION ALL SELECT horizon, '+30min', 30, """ + r6("CAST(0.0 AS DOUBLE)") + ", " + r6("ci_lower * CAST(1.0 AS DOUBLE)")
    + ", " + r6("ci_upper * CAST(1.0 AS DOUBLE)") + """, true FROM card
UNION ALL SELECT horizon, '+60min', 60, """ + r6("CAST(0.0 AS DOUBLE)") + ", " + r6("ci_lower * CAST(0.8 AS DOUBLE)")
    + ", " + r6("ci_upper * CAST(0.8 AS DOUBLE)") + """, true FROM card""",
    "live AS (SELECT * FROM panel WHERE station IS NOT NULL AND \"TIMESTAMP\" IS NOT NULL)",
    "lastb AS (SELECT max(time_bucket(INTERVAL '15 minutes', \"TIMESTAMP\")) AS last FROM live)",
    "rgrid AS (SELECT station, time_bucket(INTERVAL '15 minutes', \"TIMESTAMP\") AS bucket_ts, "
    "sum(Rain_mm_Tot) AS Rain_mm_Tot FROM live, lastb WHERE \"TIMESTAMP\" >= last - INTERVAL '180 minutes' GROUP BY ALL)",
    "hist AS (SELECT bucket_ts, avg(Rain_mm_Tot) AS avg, quantile_cont(Rain_mm_Tot, 0.1) AS q10, "
    "quantile_cont(Rain_mm_Tot, 0.9) AS q90 FROM rgrid GROUP BY bucket_ts)")

ORACLE["prob_histogram"] = with_products("""
SELECT f.horizon, f.bin, printf('%.1f–%.1f', CAST(f.bin AS DOUBLE) / CAST(10.0 AS DOUBLE),
       CAST(f.bin + 1 AS DOUBLE) / CAST(10.0 AS DOUBLE)) AS label,
       CAST(f.bin AS DOUBLE) / CAST(10.0 AS DOUBLE) AS lo, CAST(f.bin + 1 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS hi,
       coalesce(c.count, 0) AS count,
       (CAST(f.bin + 1 AS DOUBLE) / CAST(10.0 AS DOUBLE) >= k.ci_lower AND CAST(f.bin AS DOUBLE) / CAST(10.0 AS DOUBLE) <= k.ci_upper) AS in_ci
FROM (SELECT g.horizon, CAST(r.range AS INTEGER) AS bin FROM (SELECT DISTINCT horizon FROM hcounts) g, range(10) r) f
LEFT JOIN hcounts c ON c.horizon = f.horizon AND c.bin = f.bin
LEFT JOIN card k ON k.horizon = f.horizon""",
    "hcounts AS (SELECT horizon, CAST(least(floor(pred_prob * 10), 9) AS INTEGER) AS bin, count(*) AS count "
    "FROM test WHERE model = 'persistence' AND pred_prob IS NOT NULL GROUP BY ALL)")

ORACLE["alert_level"] = with_products("""
SELECT horizon, lvl AS level,
       CASE WHEN probability >= CAST(0.7 AS DOUBLE) THEN 'high' WHEN probability >= CAST(0.4 AS DOUBLE) THEN 'medium'
            ELSE 'low' END AS band,
       (CASE WHEN lvl = 'alto' THEN 'Alta' WHEN lvl = 'medio' THEN 'Moderada' ELSE 'Baja' END)
       || ' probabilidad de precipitación ' || CASE WHEN horizon_minutes = 60 THEN 'en la próxima hora.' ELSE
          'en las próximas ' || CAST(CAST(horizon_minutes / 60 AS INTEGER) AS VARCHAR) || ' horas.' END AS message
FROM (SELECT *, CASE WHEN pred_class = 2 AND probability >= CAST(0.7 AS DOUBLE) THEN 'alto'
                     WHEN probability >= CAST(0.4 AS DOUBLE) THEN 'medio' ELSE 'bajo' END AS lvl FROM card)""")


def _fields(section: str, item: str, fields: dict[str, str], src: str, where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT horizon, '{section}' AS section, CAST({item} AS VARCHAR) AS item, '{name}' AS field, "
                              f"CAST({value} AS VARCHAR) AS value FROM {src} {where}" for name, value in fields.items())


def _six(c: str) -> str:
    return f"printf('%.6f', {c})"


_HORIZON_LIST = "(SELECT unnest([" + ", ".join(f"'{h.name}'" for h in SPEC.horizons) + "]) AS hz)"
_NETWORK = "(SELECT horizon, max(n_active) AS a, max(n_stations) AS t, avg(CASE WHEN status = 'active' THEN last_reading END) * 4 AS rate FROM st GROUP BY horizon)"
ORACLE["dashboard_fields"] = (
    f"WITH card AS ({ORACLE['horizon_card']}), st AS ({ORACLE['station_panel']}), ns AS ({ORACLE['network_series']}), "
    f"hb AS ({ORACLE['prob_histogram']}), al AS ({ORACLE['alert_level']}), mc AS ({ORACLE['metric_card']}), "
    "series AS (SELECT hz AS horizon, time, avg, q10, q90, forecast FROM ns, " + _HORIZON_LIST + " WHERE horizon IS NULL "
    "UNION ALL SELECT horizon, time, avg, q10, q90, forecast FROM ns WHERE horizon IS NOT NULL) SELECT * FROM ("
    + " UNION ALL ".join([
        _fields("prediction", "''", {
            "timestamp": "timestamp", "willRain": "will_rain", "probability": _six("probability"), "intensity": "intensity",
            "ci_lower": _six("ci_lower"), "ci_upper": _six("ci_upper"), "ci_level": _six("ci_level"), "horizon": "horizon_minutes",
            "horizonLabel": "horizon", "nStations": "n_stations", "modelVersion": "model_version"}, "card"),
        _fields("prediction", "''", {"intensityMmH": _six(r6("rate"))}, _NETWORK),
        _fields("stations", "station_id", {
            "name": "station_id", "status": "status", "trend": "trend", "lastReading": _six("last_reading"),
            "probability": _six("probability"), "recentReadings": "recent_mm_x1000"}, "st"),
        _fields("time_series", "time", {"avg": _six("avg"), "q10": _six("q10"), "q90": _six("q90"), "forecast": "forecast"}, "series"),
        _fields("bootstrap", "label", {"count": "count", "in_ci": "in_ci"}, "hb"),
        _fields("alerts", "''", {"current": "level"}, "al"),
        _fields("alerts", "1", {"text": "message"}, "al"),
        _fields("alerts", "2", {"text": "CASE WHEN level = 'bajo' AND a = t THEN 'Condiciones estables en todas las estaciones.' "
                                        "ELSE a || ' de ' || t || ' estaciones activas.' END"}, "al JOIN " + _NETWORK + " USING (horizon)"),
        _fields("alerts", "3", {"text": "'Continuar monitoreo de rutina.'"}, "al", "WHERE level = 'bajo'"),
        _fields("metrics", "''", {"accuracy": _six("accuracy"), "f1_weighted": _six("f1_weighted"), "f1_macro": _six("f1_macro"),
                                  "best_model": "best_model", "test_rows": "test_rows"}, "mc"),
    ]) + ") WHERE value IS NOT NULL")


# --- streaming ---------------------------------------------------------------------------

ORACLE["stream_ingest"] = (f"WITH {PANEL_SQL}\nSELECT station, \"TIMESTAMP\", Rain_mm_Tot, event_id FROM panel "
                           "QUALIFY row_number() OVER (PARTITION BY station, \"TIMESTAMP\" ORDER BY event_id) = 1")

_WIN = [("1h", 60), ("3h", 180), ("6h", 360)]
ORACLE["stream_accumulate"] = f"WITH {PANEL_SQL},\n" + """
assigned AS (
""" + " UNION ALL ".join(
    f"SELECT '{name}' AS window_len, station, Rain_mm_Tot, "
    f"time_bucket(INTERVAL '15 minutes', \"TIMESTAMP\") - k * INTERVAL '15 minutes' AS window_start, "
    f"time_bucket(INTERVAL '15 minutes', \"TIMESTAMP\") - k * INTERVAL '15 minutes' + INTERVAL '{m} minutes' AS window_end "
    f"FROM panel, range({m // 15}) r(k) WHERE \"TIMESTAMP\" IS NOT NULL"
    for name, m in _WIN) + """
)
SELECT window_len, station, window_start, window_end, """ + r6("sum(Rain_mm_Tot)") + """ AS rain_sum,
       count(Rain_mm_Tot) AS n_readings
FROM assigned GROUP BY ALL"""

ORACLE["stream_accumulate_append"] = ORACLE["stream_accumulate"].replace(
    "FROM assigned GROUP BY ALL",
    "FROM assigned WHERE window_end <= (SELECT max(\"TIMESTAMP\") FROM panel) - INTERVAL '1 hour' GROUP BY ALL")

ORACLE["label_pair_metrics"] = "WITH lp AS (SELECT quality AS obs_class, toxic AS pred_class, 'all' AS g FROM labels),\n" + \
    ",\n".join(metric_ctes("lp", "g")) + "\nSELECT " + ", ".join(
        f"{r6(c)} AS {c}" for c in ("accuracy", "f1_macro", "f1_weighted", "f1_micro")) + ", n_rows FROM summ"


# Persistence alerts of every reading, from the windowed panel.
ALERTS_SQL = "alerts AS (" + " UNION ALL ".join(
    f"SELECT event_id, station, \"TIMESTAMP\", '{h.name}' AS horizon, trail_{h.name} AS trail_total, "
    f"coalesce({classify_sql(f'trail_{h.name}', h.light_threshold)}, 0) AS persist_class FROM sums" for h in SPEC.horizons) + ")"
ALERT_P_SQL = ("alertp AS (SELECT a.*, CAST(1.0 AS DOUBLE) - coalesce(f.p0, CASE WHEN a.persist_class = 0 THEN CAST(0.8 AS DOUBLE) "
               "ELSE CAST(0.1 AS DOUBLE) END) AS p_rain FROM alerts a LEFT JOIN pfit f USING (horizon, persist_class))")
ORACLE["stream_alerts"] = with_base(
    f"SELECT event_id, station, \"TIMESTAMP\", horizon, {r6('trail_total')} AS trail_total, persist_class, {r6('p_rain')} AS p_rain, "
    "CASE WHEN persist_class = 2 AND p_rain >= 0.7 THEN 'alto' WHEN p_rain >= 0.4 THEN 'medio' ELSE 'bajo' END AS level "
    "FROM alertp WHERE station IS NOT NULL AND \"TIMESTAMP\" IS NOT NULL", BASELINE_SQL, ALERTS_SQL, ALERT_P_SQL)
