"""Model fitting and prediction (A9, A10, M1-M9) with MLlib.

* Imputation (M1 / A9): exact median per numeric column, fitted on the
  training rows, by radix selection on the ordered bits of the values: 16 bits a
  pass, at most 65,536 counters a column, whatever the values are. Columns that are all
  missing are left as they are (scikit-learn drops them from X).
* Most frequent value (A10), ties → smallest value.
* One-hot station (M2): ``StringIndexer(alphabetAsc, keep)`` +
  ``OneHotEncoder(dropLast=True)``: k known stations → k slots, unseen or
  missing → all zeros.
* Balanced class weights (M4): n / (K · n_c) from one aggregate of at most K
  rows, broadcast under that bound.
* Logistic regression (M5) with the scikit-learn objective mapped to MLlib:
  regParam = 1 / (C · Σ weights), no standardisation, multinomial. The features are nearly
  collinear (lags, rolling means and sums of one series), on which MLlib's L-BFGS takes over a
  thousand passes: :class:`NewtonLogisticRegression` needs some ten for the same optimum.
* Random forest (M6): :mod:`.forest`, class weights balanced per bag, trees kept as rows.
* :func:`fit_and_evaluate` (M7-M9): one ``Pipeline`` per model, fitted once
  and reused for the metrics and the submission (no refit).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M
from .forest import ForestModel, ForestSpec, fit_forest
from .sums import task_sums

DIGIT = 16                  # bits of a value settled by a pass over the rows


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order (zeros of both signs are one value)."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def from_ordered_bits(bits: int) -> float:
    raw = bits & ~(1 << 63) if bits >> 63 else ~bits & (1 << 64) - 1
    return float(np.uint64(raw).view(np.float64))


def digit_counts(df: DataFrame, prefixes: dict[str, int], shift: int) -> DataFrame:
    """(col, digit, n): of the values of each column whose higher bits are ``prefixes``, how many
    have each digit at ``shift``. A task counts its rows in one array of 2^16 per column and sends
    the counters that aren't zero."""
    cols, wanted = list(prefixes), list(prefixes.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(cols), 1 << DIGIT), np.int64)
        for b in batches:
            for k, high in enumerate(wanted):
                values = b.column(k).drop_null().to_numpy(zero_copy_only=False)
                values = values[~np.isnan(values)]
                sign = (values + 0.0).view(np.uint64)
                bits = np.where(sign >> np.uint64(63), ~sign, sign | np.uint64(1 << 63))
                if shift + DIGIT < 64:
                    bits = bits[bits >> np.uint64(shift + DIGIT) == np.uint64(high)]
                digits = (bits >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)
                counts[k] += np.bincount(digits.astype(np.int64), minlength=1 << DIGIT)
        col, digit = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(col, pa.int32()), pa.array(digit, pa.int32()), pa.array(counts[col, digit])],
                                         names=["col", "digit", "n"])

    narrow = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return narrow.mapInArrow(run, "col int, digit int, n long").groupBy("col", "digit").agg(F.sum("n").alias("n"))


def exact_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians (mean of the two middle values for even n). NULL and NaN are missing;
    columns without any value are skipped (scikit-learn drops them).

    Four passes settle 16 bits each of the lower middle value; where the upper one is
    another value, it is the smallest above, one more aggregate. Per column and pass at
    most 2^16 counters reach the driver. ``df`` is read by every pass: written or cheap rows."""
    state = {c: {"prefix": 0, "below": 0, "n": None} for c in cols}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        names = list(state)
        counts: dict[str, list] = {}
        for r in digit_counts(df, {c: s["prefix"] for c, s in state.items()}, shift).collect() if names else []:
            counts.setdefault(names[r["col"]], []).append((r["digit"], r["n"]))
        for c in names:
            st, found = state[c], sorted(counts.get(c, []))
            if st["n"] is None:
                st["n"] = sum(n for _, n in found)
                if not st["n"]:
                    del state[c]
                    continue
            for digit, n in found:
                if st["below"] + n > (st["n"] - 1) // 2:
                    st["prefix"], st["count"] = st["prefix"] << DIGIT | digit, n
                    break
                st["below"] += n
    low = {c: from_ordered_bits(st["prefix"]) for c, st in state.items()}
    pairs = [c for c, st in state.items() if st["n"] // 2 >= st["below"] + st["count"]]
    high = dict(low)
    if pairs:
        x = {c: F.col(c).cast("double") for c in pairs}
        row = df.agg(*[F.min(F.when((x[c] > F.lit(low[c])) & ~F.isnan(x[c]), x[c])).alias(f"v{k}") for k, c in enumerate(pairs)]).first()
        high.update({c: row[f"v{k}"] for k, c in enumerate(pairs)})
    return {c: (low[c] + high[c]) / 2.0 for c in cols if c in low}


def fill_medians(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.fillna({c: v for c, v in medians.items() if v is not None}) if medians else df


def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """A10: value with the highest count (ties → smallest), one row. The
    pick is ``min(struct(-count, value))``: a partial/final aggregate, so no
    task ever holds the whole count table."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col(col).alias("v"))).alias("m"))
    return best.select(F.col("m.v").alias(col), (-F.col("m.neg")).alias("n"))


def class_weights(train: DataFrame, label: str, group: Iterable[str] = ()) -> DataFrame:
    """M4: balanced weights n / (K · n_c) per (group, class)."""
    group = list(group)
    counts = train.filter(F.col(label).isNotNull()).groupBy(*group, label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    return counts.withColumn("weight", F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))


def with_class_weight(df: DataFrame, weights: DataFrame, label: str, group: Iterable[str] = (),
                      weight_col: str = "weight") -> DataFrame:
    """Weights looked up per row (the table has ≤ groups × K rows)."""
    keys = [*group, label]
    return df.join(F.broadcast(weights.select(*keys, F.col("weight").alias(weight_col))), keys, "left")


def station_encoder(station: str = "station") -> list:
    return [
        StringIndexer(inputCol=station, outputCol=f"{station}_idx", handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        # the indexer already maps unseen / missing to the extra last index;
        # dropLast removes that slot, so k known stations give k slots
        OneHotEncoder(inputCols=[f"{station}_idx"], outputCols=[f"{station}_vec"], dropLast=True),
    ]


class NewtonLogisticRegression(LogisticRegression):
    """MLlib's multinomial logistic regression with an L2 penalty, fitted by Newton's method: a pass over the
    rows adds up loss, gradient and Hessian, (classes x features)^2 numbers, and the driver solves for the
    step, halved as long as it leads upward. It ends when a step can lower the loss by no more than
    tol^2 of it. The model is MLlib's own."""

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        label, weight, reg = F.col(self.getLabelCol()), F.col(self.getWeightCol()).cast("double"), self.getRegParam()
        data = dataset.select(label.cast("int").alias("y"), weight.alias("w"), F.col(self.getFeaturesCol()).alias("x")).filter("w > 0")
        classes = {r["y"]: r["w"] for r in data.groupBy("y").agg(F.sum("w").alias("w")).collect()}
        if not classes:
            raise ValueError("no training rows")
        stats = data.select(Summarizer.metrics("mean", "std", "min", "max").summary(F.col("x"), F.col("w")).alias("s")).first()["s"]
        mean, std = stats["mean"].toArray(), stats["std"].toArray()
        # a constant feature is the intercept's
        unit = np.where((std > 0) & (stats["max"].toArray() > stats["min"].toArray()), 1 / np.where(std > 0, std, 1.0), 0.0)
        k, d, total = max(classes) + 1, len(mean), sum(classes.values())
        rows = data.select("y", "w", vector_to_array("x").alias("x"))
        penalty = np.tile(np.concatenate(([0.0], reg * unit ** 2)), (k, 1))

        def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            def sums(batches: Iterator[list[np.ndarray]]) -> np.ndarray:
                loss, grad, hess = 0.0, np.zeros((k, d + 1)), np.zeros((k, d + 1, k, d + 1))
                for y, w, x in batches:
                    z = np.column_stack((np.ones(len(y)), (x - mean) * unit))
                    logits = z @ beta.T
                    logits -= logits.max(axis=1, keepdims=True)
                    p = np.exp(logits)
                    norm = p.sum(axis=1)
                    p /= norm[:, None]
                    own = np.arange(k) == y[:, None]
                    loss += w @ (np.log(norm) - logits[own])
                    grad += ((p - own) * w[:, None]).T @ z
                    for a in range(k):
                        for c in range(a, k):
                            hess[a, :, c] += (z * (w * p[:, a] * ((a == c) - p[:, c]))[:, None]).T @ z
                return np.concatenate(([loss], grad.reshape(-1), hess.reshape(-1)))

            got = task_sums(rows, 1 + beta.size + beta.size ** 2, sums) / total
            grad, hess = got[1:1 + beta.size].reshape(beta.shape), got[1 + beta.size:].reshape(*beta.shape, *beta.shape)
            for a in range(k):
                for c in range(a):
                    hess[a, :, c] = hess[c, :, a].T
            kept = np.where(np.isfinite(beta), beta, 0.0)
            return (got[0] + (penalty * kept ** 2).sum() / 2, grad + penalty * kept,
                    hess.reshape(beta.size, -1) + np.diag(penalty.reshape(-1)))

        beta = np.zeros((k, d + 1))
        # a class without rows has probability 0
        share = np.log([classes[c] if c in classes else 1.0 for c in range(k)])
        beta[:, 0] = [share[c] if c in classes else -np.inf for c in range(k)]
        loss, grad, hess = at(beta)
        for _ in range(self.getMaxIter()):
            # flat directions, as all intercepts at once, are left out
            values, vectors = np.linalg.eigh(hess)
            steep = values > values[-1] * 1e-14
            along = np.where(steep, vectors.T @ grad.reshape(-1) / np.where(steep, values, 1.0), 0.0)
            step, gain = -(vectors @ along).reshape(beta.shape), float(along @ (values * along)) / 2
            if not gain > self.getTol() ** 2 * loss:
                break
            new = at(beta + step)
            while new[0] > loss + 1e-12 * abs(loss) and np.abs(step).max() > 1e-12:
                step = step / 2
                new = at(beta + step)
            if new[0] > loss + 1e-12 * abs(loss):
                break
            beta = beta + step
            loss, grad, hess = new
        coef = beta[:, 1:] * unit
        intercept = beta[:, 0] - coef @ mean
        intercept -= intercept[np.isfinite(intercept)].mean()
        spark = dataset.sparkSession
        fitted = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            self.uid, _py2java(spark.sparkContext, DenseMatrix(k, d, coef.reshape(-1, order="F").tolist())),
            _py2java(spark.sparkContext, DenseVector(intercept.tolist())), k, True)
        return self._copyValues(LogisticRegressionModel(fitted))


def make_estimator(label: str, weight_col: str, n_train_weight: float | None = None, C: float = 1.0,
                   max_iter: int = 2000, tol: float = 1e-6) -> LogisticRegression:
    """M5: the balanced multinomial logistic regression."""
    reg = 1.0 / (C * n_train_weight) if n_train_weight else 0.0
    return NewtonLogisticRegression(featuresCol="features", labelCol=label, weightCol=weight_col,
                                    family="multinomial", regParam=reg, elasticNetParam=0.0,
                                    standardization=False, maxIter=max_iter, tol=tol)


def feature_stages(numeric: list[str], station: str = "station") -> list:
    """M3: one-hot station; numeric columns, then station slots, as one vector."""
    return [*station_encoder(station), VectorAssembler(inputCols=[*numeric, f"{station}_vec"], outputCol="features",
                                                       handleInvalid="keep")]


def build_pipeline(estimator, numeric: list[str], station: str = "station") -> Pipeline:
    """M3 + M7: features and model."""
    return Pipeline(stages=[*feature_stages(numeric, station), estimator])


def predict(model: PipelineModel | ForestModel, df: DataFrame) -> DataFrame:
    """M8 + P12: predicted class, probability array, P(predicted class) and
    P(rain) = 1 − P(class 0)."""
    if isinstance(model, ForestModel):
        return model.predict(df)
    out = model.transform(df)
    probs = vector_to_array("probability")
    return (out.withColumn("probs", probs)
            .withColumn("pred_class", F.col("prediction").cast("int"))
            .withColumn("pred_prob", F.element_at(F.col("probs"), F.col("pred_class") + 1))
            .withColumn("p_rain", F.lit(1.0) - F.element_at(F.col("probs"), 1)))


def fit_model(name: str, train: DataFrame, label: str, numeric: list[str], total_weight: float, station: str = "station",
              forest: ForestSpec = ForestSpec(), key: str | None = None) -> PipelineModel | ForestModel:
    """One model on imputed rows with their balanced ``weight``. ``key``: the rows'
    integer key, for a forest with exact bags."""
    if name == "logreg":
        return build_pipeline(make_estimator(label, "weight", total_weight), numeric, station).fit(train)
    if name == "rf":
        prep = Pipeline(stages=feature_stages(numeric, station)).fit(train)
        return ForestModel(prep, fit_forest(prep.transform(train), label, forest, key, "weight"))
    raise ValueError(name)


def gradient_norm(model: PipelineModel, train: DataFrame, label: str, weight_col: str = "weight") -> tuple[float, float]:
    """M5's optimality check: (largest component of the gradient, loss) of the penalised objective
    ``sum_i w_i loss_i / sum_i w_i + reg / 2 |coefficients|^2`` at the fitted coefficients. A
    feature's components are taken per unit of its weighted root mean square, if that is above 1
    (a year's are some 2,000 times those of a flag).

    One pass: a row adds w (p_k - [y = k]) x_j to the sum of (class k, feature j) and,
    as x_0 = 1, to the intercepts, which aren't penalised. Only those sums, classes x features of
    them, reach the driver."""
    fitted = model.stages[-1]
    k, d = fitted.numClasses, fitted.numFeatures
    rows = model.transform(train).select(
        F.col(label).cast("int").alias("y"), F.col(weight_col).cast("double").alias("w"),
        vector_to_array("features").alias("x"), vector_to_array("probability").alias("p"))

    def sums(batches: Iterator[list[np.ndarray]]) -> np.ndarray:
        scalars, parts = np.zeros(2), np.zeros((k + 1, d + 1))
        for y, w, x, p in batches:
            x, own = np.column_stack((np.ones(len(y)), x)), np.arange(k) == y[:, None]
            scalars += w.sum(), -(w * np.log(np.maximum(p[own], 1e-300))).sum()
            parts[:k] += ((p - own) * w[:, None]).T @ x
            parts[k] += w @ x ** 2
        return np.concatenate((scalars, parts.reshape(-1)))

    got = task_sums(rows, 2 + (k + 1) * (d + 1), sums)
    (total, loss), parts = got[:2], got[2:].reshape(k + 1, d + 1) / got[0]
    coef, reg = fitted.coefficientMatrix.toArray(), fitted.getRegParam()
    gradient = parts[:k] + reg * np.column_stack((np.zeros(k), coef))
    worst = (np.abs(gradient) / np.maximum(1.0, np.sqrt(parts[k]))).max()
    return float(worst), float(loss / total + reg / 2 * (coef ** 2).sum())


def fit_and_evaluate(train: DataFrame, test: DataFrame, label: str, numeric: list[str],
                     models: Iterable[str] = ("logreg", "rf"), forest: ForestSpec = ForestSpec(),
                     station: str = "station", medians: dict[str, float] | None = None, key: str | None = None,
                     ) -> tuple[DataFrame, dict[str, PipelineModel | ForestModel], dict[str, DataFrame]]:
    """M9: fit every model on the same (imputed, weighted) split; return the
    results table (U1), the fitted models and their test predictions.
    ``medians`` may be passed when the caller already has the training medians."""
    medians = exact_medians(train, numeric) if medians is None else medians
    usable = [c for c in numeric if c in medians]          # all-missing columns dropped
    train = fill_medians(train, medians).withColumn(label, F.col(label).cast("double"))
    test = fill_medians(test, medians).withColumn(label, F.col(label).cast("double"))
    weights = class_weights(train, label)
    # cached first, so the pass computing the weight total fills the cache
    # that every fit's iterations then read
    train_w = with_class_weight(train, weights, label).cache()
    total_w = train_w.agg(F.sum("weight")).first()[0]
    results, fitted, preds = None, {}, {}
    for name in models:
        model = fit_model(name, train_w, label, usable, total_w, station, forest, key)
        p = predict(model, test)
        fitted[name], preds[name] = model, p
        # E7 on the model: macro-F1 on its own training rows (one scalar from
        # a K²-row confusion aggregate, attached as a literal)
        f1_train = M.evaluate(predict(model, train_w).withColumn("obs_class", F.col(label).cast("int")),
                              []).first()["f1_macro"]
        row = M.evaluate(p.withColumn("obs_class", F.col(label).cast("int")), []).select(
            F.lit(name).alias("model"), "accuracy", "f1_macro", "f1_micro", "f1_weighted",
            F.lit(f1_train).alias("f1_macro_train"), (F.lit(f1_train) - F.col("f1_macro")).alias("overfitting_gap"),
            F.col("n_rows").alias("test_rows"))
        results = row if results is None else results.unionByName(row)
    train_w.unpersist()
    return results, fitted, preds


def fit_one(train: DataFrame, label: str, numeric: list[str], name: str = "logreg",
            forest: ForestSpec = ForestSpec(), station: str = "station", medians: dict[str, float] | None = None,
            key: str | None = None) -> tuple[PipelineModel | ForestModel, dict[str, float], list[str]]:
    """Fit one model with the same imputation and weighting as
    :func:`fit_and_evaluate`; return the model, the training medians and
    the numeric columns used, i.e. everything needed to score new rows."""
    medians = exact_medians(train, numeric) if medians is None else medians
    usable = [c for c in numeric if c in medians]
    tr = fill_medians(train, medians).withColumn(label, F.col(label).cast("double"))
    kept = [label, station, *usable, *([key] if key else [])]
    tr = with_class_weight(tr.select(*dict.fromkeys(kept)), class_weights(tr, label), label).cache()
    total_w = tr.agg(F.sum("weight")).first()[0]         # also fills the cache
    model = fit_model(name, tr, label, usable, total_w, station, forest, key)
    tr.unpersist()
    return model, medians, usable


def score(model: PipelineModel | ForestModel, medians: dict[str, float], df: DataFrame) -> DataFrame:
    return predict(model, fill_medians(df, medians))
