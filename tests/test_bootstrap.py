"""Bootstrap: the hash index is deterministic; B1 and B4 agree."""

from pyspark.sql import functions as F

from conftest import SF_MID
from panelcast.operators import bootstrap as bs


def _pairs(spark):
    lab = spark.read.parquet(f"{SF_MID}/labels.parquet")
    return lab.select(F.lit("all").alias("horizon"), F.col("doc_id"), F.col("quality").alias("obs_class"),
                      F.col("toxic").alias("pred_class"))


def test_hash_index_known_values(spark):
    row = spark.range(1).select(bs.hash_index(F.lit(0), F.lit(0), F.lit(399)).alias("a"),
                                bs.hash_index(F.lit(1), F.lit(2), F.lit(399)).alias("b")).first()
    assert (row["a"], row["b"]) == (292, 26)      # same figures as the DuckDB form


def test_hash_and_multinomial_agree(spark):
    d = _pairs(spark)
    h = bs.bootstrap_ci(bs.bootstrap_hash(d, ["horizon"], 400), ["horizon"]).first()
    m = bs.bootstrap_ci(bs.bootstrap_multinomial(d, ["horizon"], 400), ["horizon"]).first()
    assert abs(h["macro_f1_mean"] - m["macro_f1_mean"]) < 0.02
    wh, wm = h["ci_97_5"] - h["ci_2_5"], m["ci_97_5"] - m["ci_2_5"]
    assert 0.6 < wh / wm < 1.6
    assert h["B"] == 400 and m["B"] == 400


def test_multinomial_is_deterministic(spark):
    d = _pairs(spark)
    a = sorted(tuple(r) for r in bs.bootstrap_multinomial(d, ["horizon"], 50).collect())
    b = sorted(tuple(r) for r in bs.bootstrap_multinomial(d, ["horizon"], 50).collect())
    assert a == b


def test_hash_reaches_beyond_31_bits(spark):
    """Groups larger than 2^31 rows: drawn positions must cover the whole range."""
    n = 1 << 40
    mx = spark.range(0, 20000).select(bs.hash_index(F.lit(3), F.col("id"), F.lit(n)).alias("p")).agg(F.max("p")).first()[0]
    assert mx > (1 << 39)


def test_cells_add_up_and_follow_the_multinomial(spark):
    """Every replicate has n draws; means, variances and covariances of the cells are the multinomial's, for
    cells drawn by inversion (few) and by the normal quantile (many) alike."""
    import numpy as np
    share = {(0, 0): 60000, (0, 1): 2000, (1, 0): 900, (1, 1): 400, (1, 2): 12, (2, 1): 3, (2, 2): 1}
    rows = [("g", c, p, n) for (c, p), n in share.items()] + [("one", 2, 2, 5)]
    df = spark.createDataFrame(rows, "horizon string, obs_class int, pred_class int, _n_rows long")
    got = {}
    for r in bs.multinomial_cells(df, ["horizon"], 6000).collect():
        got.setdefault((r.horizon, r.b), {})[r.label, r.pred] = r.n
    total = sum(share.values())
    assert len(got) == 12000 and all(v == {(2, 2): 5} for (h, _), v in got.items() if h == "one")
    draws = np.array([[v[c] for c in share] for (h, _), v in got.items() if h == "g"], float)
    assert (draws.sum(axis=1) == total).all() and (draws >= 0).all()
    p = np.array(list(share.values())) / total
    cov = total * (np.diag(p) - np.outer(p, p))
    spread = np.sqrt(np.diag(cov))
    assert (np.abs(draws.mean(axis=0) - total * p) < 5 * spread / np.sqrt(6000)).all()
    assert np.allclose(draws.std(axis=0) / spread, 1, atol=0.06)
    assert np.abs(np.cov(draws.T) / np.outer(spread, spread) - cov / np.outer(spread, spread)).max() < 0.06
    few = draws[:, 5]                                                # three expected: the whole distribution
    want = [np.exp(-3) * 3 ** k / [1, 1, 2, 6, 24, 120][k] for k in range(6)]
    assert np.allclose([(few == k).mean() for k in range(6)], want, atol=0.03)


def test_multinomial_runs_no_python(spark):
    from test_plans import plan
    text = plan(bs.bootstrap_multinomial(_pairs(spark), ["horizon"], 50))
    assert "Python" not in text and "MapIn" not in text
