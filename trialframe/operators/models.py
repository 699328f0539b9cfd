"""Baseline models on tables: ridge, quadratic response surface, forest, and a fixed Gaussian process."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..plans.ordered import join_on, settle
from ..plans.ranks import with_ranks
from ..plans.stage import staged
from .forest import cell, cell_predictions, merges, usable
from .metrics import mean_by_key_baseline, pairwise_accuracy, regression_metrics, spearman
from .ranking import top_hit_sets


@dataclass(frozen=True)
class LinearModel:
    """Coefficients on standardised terms; prediction is a Column and needs no model transfer."""

    terms: dict[str, Column]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float

    def predict(self) -> Column:
        parts = zip(self.terms.values(), self.means, self.scales, self.weights)
        return reduce(lambda acc, p: acc + (p[0] - p[1]) / p[2] * p[3], parts, F.lit(self.intercept))


def _fit_linear(df: DataFrame, terms: dict[str, Column], target: str, alpha: float) -> LinearModel:
    rows = df.select(*[c.cast("double").alias(n) for n, c in terms.items()], F.col(target).cast("double").alias("__y"))
    rows = rows.filter(reduce(lambda a, b: a & b, [finite(c) for c in rows.columns]))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("__y").alias("sy"),
        *[F.avg(t).alias(f"m_{t}") for t in terms], *[F.stddev_pop(t).alias(f"s_{t}") for t in terms],
    ).first()
    means = [stats[f"m_{t}"] for t in terms]
    scales = [stats[f"s_{t}"] or 1.0 for t in terms]
    scaled = rows.select("__y", *[((F.col(t) - m) / s).alias(t) for t, m, s in zip(terms, means, scales)])
    packed = VectorAssembler(inputCols=list(terms), outputCol="__x").transform(scaled).select("__x", "__y")
    # the solver divides the penalty by the deviation of the target and the loss by n
    penalty = alpha * (stats["sy"] or 1.0) / stats["n"]
    fit = LinearRegression(
        featuresCol="__x", labelCol="__y", regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal"
    ).fit(packed)
    return LinearModel(terms, means, scales, [float(w) for w in fit.coefficients], float(fit.intercept))


def ridge_fit(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> LinearModel:
    """Ridge on features standardised by the population deviation; the intercept is not penalised."""
    return _fit_linear(df, {f: F.col(f).cast("double") for f in features}, target, alpha)


def pls_fit(df: DataFrame, features: list[str], target: str, components: int = 2) -> LinearModel:
    """Partial least squares for one target, on features standardised by the sample deviation.

    The components follow from the moments X'X and X'y alone, which one aggregation gives; what is left is
    arithmetic on matrices of the number of features.
    """
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("__y"))
    rows = rows.filter(reduce(lambda a, b: a & b, [finite(c) for c in rows.columns]))
    first = rows.agg(F.avg("__y").alias("my"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features]).first()
    means, scales = [first[f"m_{f}"] for f in features], [first[f"s_{f}"] or 1.0 for f in features]
    z = [(F.col(f) - m) / s for f, m, s in zip(features, means, scales)]
    p = len(features)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.agg(*[F.sum(z[i] * z[j]).alias(f"x{i}_{j}") for i, j in pairs], *[F.sum(z[i] * (F.col("__y") - first["my"])).alias(f"y{i}") for i in range(p)]).first()
    xx = np.zeros((p, p))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = sums[f"x{i}_{j}"]
    xy, total, weights, loads = np.array([sums[f"y{i}"] for i in range(p)]), np.zeros(p), [], []
    for _ in range(min(components, p)):
        w = xy / (np.linalg.norm(xy) or 1.0)
        r = w.copy()  # the direction in the original features
        for seen, load in zip(weights, loads):
            r -= (load @ w) * seen
        size = r @ xx @ r
        if size <= 1e-12 * max(1.0, np.trace(xx)):
            break
        load, gain = xx @ r / size, (r @ xy) / size
        total += gain * r
        xy = xy - size * gain * load
        weights.append(r)
        loads.append(load)
    return LinearModel({f: F.col(f).cast("double") for f in features}, means, scales, [float(b) for b in total], float(first["my"]))


def rsm2_fit(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> LinearModel:
    """Ridge on the standardised terms of a quadratic response surface."""
    cols = {f: F.col(f).cast("double") for f in features}
    terms = dict(cols)
    for i, a in enumerate(features):
        for b in features[i:]:
            terms[f"{a}__{b}"] = cols[a] * cols[b]
    return _fit_linear(df, terms, target, alpha)


def linear_predict(df: DataFrame, model: LinearModel, name: str = "pred") -> DataFrame:
    return df.withColumn(name, model.predict())


def forest_fit_predict(
    train: DataFrame, test: DataFrame, features: list[str], target: str, trees: int = 300, depth: int = 10, seed: int = 0,
    name: str = "pred", held: bool = False,
) -> DataFrame:
    """Random forest over all features. Trees are drawn differently from other libraries' forests.

    Where training rows outnumber the combinations of the features' bins, they are merged by them (``operators.forest``):
    same draws, same splits, and a test row takes the prediction of its combination. Several passes must then meet the
    rows in one order, so they are written first unless ``train`` is ``held``, a written table itself.
    """
    found = train.filter(finite(target)).filter(usable(features)).select(*dict.fromkeys([*features, target]))
    found = found if held else staged(found, "train")
    rows = found.count()
    if merges(train, features, rows) and (fitted := cell_predictions(found, features, target, rows, trees, depth, seed)):
        splits, preds = fitted
        placed = test.filter(usable(features)).withColumn("__cell", cell(features, splits))
        preds = preds.select(F.col("cell").alias("__at"), F.col("pred").alias(name))
        return placed.join(preds, F.col("__cell") == F.col("__at")).drop("__cell", "__at")
    pack = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip")
    forest = RandomForestRegressor(
        featuresCol="__x", labelCol=target, predictionCol=name, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all",
        seed=seed,
    ).fit(pack.transform(train.filter(finite(target))))
    return forest.transform(pack.transform(test)).drop("__x")


MAX_GP_ROWS = 5_000


def gp_score(
    candidates: DataFrame, train: DataFrame, x: str, y: str, v0: float, wl: list[float], a0: float, a1: float, v1: float
) -> DataFrame:
    """Posterior mean and deviation, in the units of ``y``, for given kernel parameters.

    The factor is quadratic in the training rows, so their number is checked; candidates stay distributed
    and are scored in Arrow batches.
    """
    held = train.select(x, y).limit(MAX_GP_ROWS + 1).collect()
    if len(held) > MAX_GP_ROWS:
        raise ValueError(f"more than {MAX_GP_ROWS} training rows")
    xs, ys = np.array([r[0] for r in held], dtype=float), np.array([r[1] for r in held], dtype=float)
    mx, sx, my, sy = xs.mean(0), xs.std(0), ys.mean(), ys.std()
    sx, sy = np.where(sx == 0, 1.0, sx), (sy if sy > 0 else 1.0)
    z, t, scale = (xs - mx) / sx, (ys - my) / sy, np.asarray(wl, dtype=float)

    def cov(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        a, b = p / np.sqrt(scale), q / np.sqrt(scale)
        sq = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)
        return v0 * np.exp(-0.5 * sq) + a0 + a1 * (p @ q.T)

    lower = np.linalg.cholesky(cov(z, z) + v1 * np.eye(len(z)))
    weights = np.linalg.solve(lower.T, np.linalg.solve(lower, t))
    inverse = np.linalg.inv(lower)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            p = (np.stack(pdf[x].to_numpy()) - mx) / sx
            k = cov(p, z)
            own = v0 + a0 + a1 * (p * p).sum(1) + v1
            var = np.maximum(own - ((k @ inverse.T) ** 2).sum(1), 0.0)
            yield pdf.drop(columns=[x]).assign(gp_mean=k @ weights * sy + my, gp_sd=np.sqrt(var) * sy)

    kept = [f for f in candidates.schema.fields if f.name != x]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["gp_mean double", "gp_sd double"])
    return candidates.mapInPandas(score, schema)


def baseline_compare(
    train: DataFrame, test: DataFrame, features: list[str], targets: list[str], ident: str, key: list[str],
    trees: int = 300, depth: int = 10,
) -> DataFrame:
    """Predictions of all baselines for all targets, with descending ranks per model and target."""
    train, test = staged(train, "train"), staged(test, "test")  # read by every fit
    parts = []
    for target in targets:
        keep = [ident, F.lit(target).alias("target"), F.col(target).cast("double").alias("obs"), F.col("pred")]
        fitted = {
            "ridge": linear_predict(test, ridge_fit(train, features, target)),
            "rsm2": linear_predict(test, rsm2_fit(train, features, target)),
            "pls": linear_predict(test, pls_fit(train, features, target)),
            "forest": forest_fit_predict(train, test, features, target, trees, depth, held=True),
            "mean": mean_by_key_baseline(train, test, key, target),
        }
        parts += [p.select(F.lit(m).alias("model"), *keep) for m, p in fitted.items()]
    preds = staged(reduce(lambda a, b: a.unionByName(b), parts), "baselines")  # ranked and scored repeatedly
    cap = settle(preds, ["model", "target"])
    for c in ("obs", "pred"):
        preds = with_ranks(preds, ["model", "target"], c, "__r", desc=True, cap=cap).withColumnRenamed("__r_min", f"{c}_rank")
        preds = preds.drop("__r_max", "__r_avg", "__r_dense")
    return preds


def baseline_report(preds: DataFrame, ident: str) -> DataFrame:
    """Errors, rank agreement and top hits per model and target."""
    by = ["model", "target"]
    out = regression_metrics(preds, by, "obs", "pred")
    rho = spearman(preds, by, "obs", "pred").select(*by, "spearman")
    pairs = pairwise_accuracy(preds, by, "obs", "pred").select(*by, "untied_pairs", "correct_pairs", "pair_accuracy")
    hits = top_hit_sets(preds, by, "obs", "pred", ident).select(*by, "top1_hit", "top2_hit")
    return join_on(join_on(join_on(out, rho, by), pairs, by), hits, by)
