"""Imputation, one-hot, class weights and model fits."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import SF_MID
from panelcast.operators import forest as FO
from panelcast.operators import modeling as MD
from panelcast.operators.forest import ForestSpec


def test_exact_medians_match_median(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, 5.0), (10.0, None), (None, 7.0)], "a double, b double")
    med = MD.exact_medians(df, ["a", "b"])
    assert med == {"a": 3.0, "b": 5.0}
    big = spark.range(0, 20001).select((F.col("id") % 997).cast("double").alias("x"))
    assert MD.exact_medians(big, ["x"])["x"] == big.agg(F.median("x")).first()[0]


def test_all_missing_column_is_skipped(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert MD.exact_medians(df, ["a", "b"]) == {"b": 1.5}


def test_most_frequent_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "station string")
    assert MD.most_frequent(df, "station").first()["station"] == "a"


def test_one_hot_unseen_and_null_are_zero(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    train = spark.createDataFrame([("A",), ("B",), ("C",)], "station string")
    test = spark.createDataFrame([("B",), ("Z",), (None,)], "station string")
    m = Pipeline(stages=MD.station_encoder()).fit(train)
    got = [r[0] for r in m.transform(test).select(vector_to_array("station_vec")).collect()]
    assert got == [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 3 + [(2,)], "y int")
    w = {r["y"]: r["weight"] for r in MD.class_weights(df, "y").collect()}
    assert w == {0: 10 / (3 * 6), 1: 10 / (3 * 3), 2: 10 / 3}


def test_models_beat_majority_on_separable_data(spark):
    emb = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    k = 8
    df = emb.select(*[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(k)],
                    (F.col("label") % 3).alias("y"), F.lit("s").alias("station"))
    # separable: the label is a function of a feature we add
    df = df.withColumn("f_sig", F.col("y").cast("double") * 3.0)
    train, test = df.filter(F.col("f0") >= -10), df
    res, fitted, preds = MD.fit_and_evaluate(train, test, "y", [f"f{i}" for i in range(k)] + ["f_sig"],
                                             forest=ForestSpec(bags=20))
    r = {row["model"]: row["f1_macro"] for row in res.collect()}
    assert r["logreg"] > 0.9 and r["rf"] > 0.9
    sums = preds["logreg"].select(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x).alias("s"))
    assert sums.filter(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_exact_medians_of_many_kinds_of_values(spark, monkeypatch):
    """Ties, signs, zeros of both signs, infinities, subnormals, even and odd counts, missing values of
    both kinds; no pass brings more than 2^16 counters a column, and no values, to the driver."""
    inf, nan = float("inf"), float("nan")
    df = spark.range(0, 52001).select(
        (F.sin(F.col("id")) * 1000).alias("cont"),
        F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.col("id") % 97).cast("double").alias("tied"),
        F.when(F.col("id") < 25000, F.lit(0.0)).when(F.col("id") < 27001, F.col("id") / 27001.0).otherwise(F.lit(1.0)).alias("thin"),
        F.when(F.col("id") < 26000, F.lit(-1.0)).when(F.col("id") < 52000, F.lit(4.0)).alias("two"),
        F.when(F.col("id") % 2 == 0, F.lit(-inf)).otherwise(F.lit(2.0)).alias("low"),
        F.when(F.col("id") % 2 == 0, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("zero"),
        (F.col("id") * 5e-324).alias("tiny"), F.col("id").cast("int").alias("whole"),
        F.when(F.col("id") % 5 < 2, F.lit(nan)).when(F.col("id") % 5 == 2, F.col("id").cast("double")).alias("gaps"),
        F.lit(None).cast("double").alias("none"), F.lit(nan).alias("nan")).repartition(5)
    seen, real = [], MD.digit_counts
    monkeypatch.setattr(MD, "digit_counts", lambda *a: seen.append(real(*a)) or seen[-1])
    med = MD.exact_medians(df, df.columns)
    want = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in df.columns]).agg(
        *[F.median(c).alias(c) for c in df.columns]).first()
    assert med == {c: want[c] for c in df.columns if c not in ("none", "nan")} and med["two"] == 1.5
    assert len(seen) == 4 and all(d.columns == ["col", "digit", "n"] and d.groupBy("col").count().agg(F.max("count")).first()[0] <= 65536 for d in seen)
    assert MD.exact_medians(df.limit(0), ["cont"]) == {} and MD.exact_medians(df, []) == {}


def test_ordered_bits_keep_the_order():
    values = np.array([float("-inf"), -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, float("inf")])
    bits = MD.ordered_bits(values)
    assert (bits[1:] > bits[:-1]).all() and [MD.from_ordered_bits(int(b)) for b in bits] == values.tolist()


def _poisson(key, bag):
    """The draw of a row, in plain integers."""
    p = 2147483647

    def mixed(x, rounds):
        for mul, add, shift in rounds:
            x = (x * mul + add) % p
            x ^= x >> shift
        return x % p
    hi, lo = ((48271, 11, 16), (69621, 7, 13)), ((40692, 5, 15), (16807, 3, 12))
    row = (key % p + key // p % p * 7) % p
    u = mixed(mixed(row, hi) * mixed((bag * 2000003 + 1) % p, hi) % p, lo)
    total, k = 0.0, 0
    while k < 12:
        total += math.exp(-1) / math.factorial(k)
        if u < int(p * total):
            break
        k += 1
    return k


def test_bag_draws_are_poisson_and_weights_balance_each_bag(spark):
    rows = [(k * 7919 + (k % 5) * 2**33, k % 7 % 3) for k in range(4000)]
    df = spark.createDataFrame(rows, "k long, y int")
    got = {(r.bag, r.label): (r.n_draws, r.weight) for r in FO.bag_weights(df, "y", "k", 6).collect()}
    for bag in range(6):
        n = {c: sum(_poisson(k, bag) for k, y in rows if y == c) for c in range(3)}
        for c in range(3):
            assert got[bag, c][0] == n[c] and math.isclose(got[bag, c][1], sum(n.values()) / (3 * n[c]))
    counts = np.bincount([_poisson(k, b) for k, _ in rows for b in range(6)], minlength=6) / 24000
    assert np.allclose(counts[:5], [math.exp(-1) / math.factorial(k) for k in range(5)], atol=0.012)
    pairs = np.array([[_poisson(k, b) for b in range(6)] for k, _ in rows])
    assert np.abs(np.corrcoef(pairs.T) - np.eye(6)).max() < 0.06


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(4)
    y = np.repeat([0, 1, 2], [700, 200, 60])
    x = r.normal(size=(len(y), 6))
    x[:, 0] += 2.0 * y
    x[:, 1] -= 1.5 * (y == 2)
    order = r.permutation(len(y))
    df = spark.createDataFrame([(int(i), int(y[i]), x[i].tolist()) for i in order], "k long, y int, f array<double>")
    df = df.withColumn("features", array_to_vector("f"))
    return MD.with_class_weight(df, MD.class_weights(df, "y"), "y").cache()


@pytest.mark.parametrize("spec", [ForestSpec(bags=12, per_fit=5, max_depth=8), ForestSpec(bags=6, exact=True, max_depth=6, parallel=3)])
def test_forest_is_a_table_of_trees_that_vote(spark, blobs, spec, tmp_path):
    path = FO.fit_forest(blobs, "y", spec, "k", "weight", str(tmp_path / "forest"))
    nodes = spark.read.parquet(path)
    trees = {}
    for r in nodes.collect():
        trees.setdefault(r.bag, {})[r.id] = r
    assert sorted(trees) == list(range(spec.bags))
    for tree in trees.values():                           # the root's classes are balanced in every bag
        assert np.allclose(tree[0].probs, [1 / 3] * 3) and all(abs(sum(n.probs) - 1) < 1e-9 for n in tree.values())

    def vote(f):
        total = np.zeros(3)
        for tree in trees.values():
            n = tree[0]
            while n.left >= 0:
                n = tree[n.left if f[n.feature] <= n.threshold else n.right]
            total += n.probs
        return total / len(trees)

    whole = {r.k: r for r in FO.predict_forest(path, blobs).collect()}
    parts = {r.k: r for r in FO.predict_forest(path, blobs.repartition(3), limit=30).collect()}      # a tree or so at a time
    assert len(FO.tree_blocks(nodes, 30)) > 1 and len(whole) == 960
    right = 0
    for r in blobs.collect():
        want = vote(r.f)
        for got in (whole[r.k], parts[r.k]):
            assert np.allclose(got.probs, want) and got.pred_class == int(np.argmax(got.probs))
            assert math.isclose(got.pred_prob, max(want)) and math.isclose(got.p_rain, 1 - want[0], abs_tol=1e-12)
        right += whole[r.k].pred_class == r.y
    assert right > 860


def test_exact_bags_use_their_own_draws(spark, blobs, tmp_path):
    """A tree's root holds the bag's draws: with one level only, its children's weighted shares can be told by hand."""
    spec = ForestSpec(bags=4, exact=True, max_depth=1, parallel=2)
    path = FO.fit_forest(blobs, "y", spec, "k", None, str(tmp_path / "forest"))
    rows = blobs.collect()
    for bag in range(4):
        tree = {r.id: r for r in spark.read.parquet(path).filter(F.col("bag") == bag).collect()}
        n = {c: sum(_poisson(r.k, bag) for r in rows if r.y == c) for c in range(3)}
        low = np.array([sum(_poisson(r.k, bag) for r in rows if r.y == c and r.f[tree[0].feature] <= tree[0].threshold) / n[c] for c in range(3)])
        assert np.allclose(tree[tree[0].left].probs, low / low.sum())


def test_forest_of_nothing(spark, blobs, tmp_path):
    path = FO.fit_forest(blobs.limit(0), "y", ForestSpec(bags=3), None, "weight", str(tmp_path / "forest"))
    assert spark.read.parquet(path).count() == 0


def test_logistic_regression_is_at_its_optimum(spark, blobs):
    cols = [F.col("f")[i].alias(f"f{i}") for i in range(6)]
    train = blobs.select("y", "weight", F.lit("s").alias("station"), *cols)
    model, _, _ = MD.fit_one(train.drop("weight"), "y", [f"f{i}" for i in range(6)])
    gradient, loss = MD.gradient_norm(model, train, "y")
    assert 0.05 < loss < 1.2 and gradient < 1e-4 * loss
    # by hand, and away from the optimum: the check sees what one step changes
    rows = model.transform(train).collect()
    w, p = np.array([r.weight for r in rows]), np.array([r.probability.toArray() for r in rows])
    x = np.array([[1.0, *r.features.toArray()] for r in rows])
    coef = np.column_stack((np.zeros(3), model.stages[-1].coefficientMatrix.toArray()))
    g = ((p - np.eye(3)[[r.y for r in rows]]) * w[:, None]).T @ x / w.sum() + model.stages[-1].getRegParam() * coef
    g /= np.maximum(1, np.sqrt((w[:, None] * x ** 2).sum(axis=0) / w.sum()))
    assert math.isclose(np.abs(g).max(), gradient, rel_tol=1e-6, abs_tol=1e-12)
    early = MD.build_pipeline(MD.make_estimator("y", "weight", 960.0, max_iter=2), [f"f{i}" for i in range(6)]).fit(train)
    assert MD.gradient_norm(early, train, "y")[0] > 10 * gradient


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_logistic_regression_takes_few_passes(spark, tmp_path):
    """Nearly collinear features in units far apart, a constant one and a class without rows: few jobs, the
    optimum, and a model that can be kept."""
    from pyspark.ml import PipelineModel
    r = np.random.default_rng(1)
    a = r.normal(size=(3000, 3))
    x = np.column_stack((a, a @ [1, 1, 1] + 1e-3 * r.normal(size=3000), 1e4 * a[:, 0] + a[:, 1], np.full(3000, 2024.0)))
    y = np.digitize(a[:, 0] + 0.5 * r.normal(size=3000), [0.5, 1.5])
    y[y == 1] = 3
    df = spark.createDataFrame([(int(y[i]), 1.0 + i % 3, *x[i].tolist(), "ab"[i % 2]) for i in range(3000)],
                               "y int, weight double, " + ", ".join(f"f{j} double" for j in range(6)) + ", station string").cache()
    fitted = []
    pipe = MD.build_pipeline(MD.make_estimator("y", "weight", 6000.0), [f"f{j}" for j in range(6)])
    assert _jobs(spark, "newton", lambda: fitted.append(pipe.fit(df))) < 60
    gradient, loss = MD.gradient_norm(fitted[0], df, "y")
    assert gradient < 1e-9
    lr = fitted[0].stages[-1]
    assert lr.coefficientMatrix.toArray()[:, 5].tolist() == [0.0] * 4 and lr.numClasses == 4
    fitted[0].write().save(str(tmp_path / "model"))
    got, kept = (MD.predict(m, df).select("probs").toPandas()["probs"].tolist() for m in (fitted[0], PipelineModel.load(str(tmp_path / "model"))))
    assert np.array_equal(np.array(got), np.array(kept))
    one = pipe.fit(df.filter("y = 0"))
    assert {(r.pred_class, r.pred_prob) for r in MD.predict(one, df).select("pred_class", "pred_prob").collect()} == {(0, 1.0)}


def test_large_nodes_are_split_by_passes_and_small_ones_grow_in_tasks(spark, blobs, tmp_path, monkeypatch):
    """Few jobs, whatever the depth, ids without gaps, leaves of one class, and the same forest in a second run."""
    monkeypatch.setattr(FO, "TASK_ROWS", 100)
    path = str(tmp_path / "forest")
    assert _jobs(spark, "forest", lambda: FO.fit_forest(blobs, "y", ForestSpec(bags=8), None, "weight", path)) < 120
    trees = {}
    for r in spark.read.parquet(path).collect():
        trees.setdefault(r.bag, {})[r.id] = r
    assert sorted(trees) == list(range(8))
    for tree in trees.values():
        assert sorted(tree) == list(range(len(tree)))               # ids without gaps
        inner = [n for n in tree.values() if n.left >= 0]
        assert sorted([0] + [c for n in inner for c in (n.left, n.right)]) == sorted(tree)
        pure = [max(n.probs) > 1 - 1e-9 for n in tree.values() if n.left < 0]
        assert np.mean(pure) > 0.98                                 # only rows alike in all their bins stay together
    again = str(tmp_path / "again")
    FO.fit_forest(blobs, "y", ForestSpec(bags=8), None, "weight", again)
    assert sorted(map(str, spark.read.parquet(again).collect())) == sorted(map(str, spark.read.parquet(path).collect()))
    right = FO.predict_forest(path, blobs).filter("pred_class = y").count()
    assert right > 900


def test_subtree_matches_a_plain_search():
    """Each split is the best of its features by a plain search over all thresholds, in the subtree and by histogram alike."""
    r = np.random.default_rng(3)
    x, y, k = r.integers(0, 5, size=(60, 1)), r.integers(0, 3, 60), r.integers(1, 4, 60)
    weights = [np.where(y == c, k * (c + 1.0), 0.0) for c in range(3)]
    feature, split, left, right, held = FO.grow_subtree(x, weights, k, 0, ForestSpec(max_bins=5), r)

    def gini(rows):
        w = np.array([c[rows].sum() for c in weights])
        return w.sum(), (1 - ((w / w.sum()) ** 2).sum()) if w.sum() else 0.0

    def check(node, rows):
        assert np.allclose(held[node], [c[rows].sum() for c in weights])
        n, whole = gini(rows)
        gains = {}
        for b in range(4):
            lower, upper = rows[x[rows, 0] <= b], rows[x[rows, 0] > b]
            if len(lower) and len(upper):
                gains[b] = whole - sum(g * m for m, g in map(gini, (lower, upper))) / n
        if left[node] < 0:
            assert max(gains.values(), default=0.0) < 1e-8
            return
        assert feature[node] == 0 and math.isclose(gains[split[node]], max(gains.values()), abs_tol=1e-8)
        check(left[node], rows[x[rows, 0] <= split[node]])
        check(right[node], rows[x[rows, 0] > split[node]])

    check(0, np.arange(60))


@pytest.mark.parametrize("min_rows", [1, 4])
def test_subtree_is_the_same_in_groups_of_any_size(monkeypatch, min_rows):
    """Histograms of a few rows, nodes and lanes at a time give the splits and class weights of one big group."""
    r = np.random.default_rng(8)
    x, y, k = r.integers(0, 9, size=(900, 5)), r.integers(0, 3, 900), r.integers(1, 4, 900)
    weights = [np.where(y == c, k * (c + 1.0), 0.0) for c in range(3)]

    def grown():
        return FO.grow_subtree(x, weights, k, 0, ForestSpec(max_bins=9, min_rows=min_rows), np.random.default_rng(5))

    whole = grown()
    assert len(whole[0]) > 200
    for rows, nodes, lanes in ((7, 2, 3), (64, 1, 1), (1, 1000, 4)):
        for name, value in (("GROUP_ROWS", rows), ("GROUP_NODES", nodes), ("LANES", lanes)):
            monkeypatch.setattr(FO, name, value)
        assert all(np.array_equal(a, b) for a, b in zip(whole, grown()))
    # every inner node's weights are its children's, every row is in the leaf that its bins lead to
    feature, split, left, right, held = whole
    inner = np.flatnonzero(left >= 0)
    assert np.array_equal(held[inner], held[left[inner]] + held[right[inner]])
    at = np.zeros(900, int)
    while (left[at] >= 0).any():
        at = np.where(left[at] < 0, at, np.where(x[np.arange(900), feature[at]] <= split[at], left[at], right[at]))
    assert all(np.array_equal(np.bincount(at, w, len(left))[left < 0], held[left < 0, c]) for c, w in enumerate(weights))
    assert np.bincount(at, k, len(left))[left < 0].min() >= min_rows


def test_trees_of_many_rows_grow_in_their_tasks(spark, monkeypatch, tmp_path):
    """A bag of 190,000 rows needs no pass but that for its class sums, and its rows go there with a byte a bin."""
    df = spark.range(300000).select("id", (F.col("id") % 3).cast("int").alias("y"), F.lit(1.0).alias("weight"),
                                    array_to_vector(F.array(*[(F.hash("id", F.lit(j)) % 20).cast("double") for j in range(3)])).alias("features"))
    passes, binned, sums, bins = [], [], FO.task_sums, FO.with_bins
    monkeypatch.setattr(FO, "task_sums", lambda *a: passes.append(1) or sums(*a))
    monkeypatch.setattr(FO, "with_bins", lambda *a: binned.append(bins(*a)) or binned[-1])
    path = FO.fit_forest(df, "y", ForestSpec(bags=2, max_depth=4), None, "weight", str(tmp_path / "forest"))
    assert len(passes) == 1 and binned[0].select(F.max(F.length("x"))).first()[0] == 3
    assert spark.read.parquet(path).select("bag").distinct().count() == 2


def test_bins_of_sliced_batches():
    import pyarrow as pa

    from panelcast.operators.sums import columns_of
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([b"ab", b"cd", b"ef"], pa.binary())], names=["n", "x"])
    n, x = columns_of(batch.slice(1))
    assert n.tolist() == [2, 3] and x.tolist() == [list(b"cd"), list(b"ef")]
