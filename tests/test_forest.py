"""Forests over merged rows against MLlib's own, and a tree against brute force."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from trialframe.catalog import modelling
from trialframe.operators import forest, models
from trialframe.plans.stage import staged


def _rows(spark, n):
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 40, n), np.round(rng.normal(0, 50, n), 1), rng.exponential(1, n)
    y = 2.0 * a + b * np.sign(a - 20) + 9 * c + rng.normal(0, 8, n)
    b[::97], y[5::89] = np.nan, np.nan
    df = spark.createDataFrame(list(zip(range(n), a.tolist(), b.tolist(), c.tolist(), y.tolist())), "id int, a int, b double, c double, y double")
    df = df.withColumn("a", F.when(F.col("id") % 83 != 0, F.col("a"))).withColumn("y", F.when(F.col("id") % 71 != 0, F.col("y")))
    return staged(df.unionByName(df.filter("id < 200")).repartition(3, "id"), "rows")


def _mllib(train, test, features, target, trees, depth):
    pack = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip")
    fit = RandomForestRegressor(featuresCol="x", labelCol=target, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=0)
    known = train.filter(f"{target} IS NOT NULL AND NOT isnan({target})")
    return fit.fit(pack.transform(known)).transform(pack.transform(test))


@pytest.fixture
def no_pass_per_level(monkeypatch):
    def refuse(*args, **kwargs):
        raise AssertionError("every level of the trees reads all rows")

    monkeypatch.setattr(models, "RandomForestRegressor", refuse)


@pytest.mark.parametrize("n", [6_000, 13_000])  # all rows and a sample of them give the split candidates
def test_merged_rows_give_mllibs_forest(spark, no_pass_per_level, n):
    train = _rows(spark, n)
    test = train.select((F.col("id") + 1).alias("id"), F.lit("x").alias("cell"), (F.col("a") * 1.3 - 5).alias("a"), "b", "y")
    for target in ("y", "c"):  # one of both signs, one above zero
        test = test if target in test.columns else test.withColumn(target, F.lit(None).cast("double"))
        got = models.forest_fit_predict(train, test, ["a", "b"], target, trees=7, depth=8, name="p")
        assert got.columns == [*test.columns, "p"]
        got = sorted((r.id, r.p) for r in got.collect())
        want = sorted((r.id, r.prediction) for r in _mllib(train, test, ["a", "b"], target, 7, 8).collect())
        assert [i for i, _ in got] == [i for i, _ in want] and len(got) < test.count()
        assert np.allclose([p for _, p in got], [p for _, p in want], rtol=1e-9, atol=1e-9)


def test_many_trees_are_added_in_blocks(spark, no_pass_per_level):
    train = _rows(spark, 4_500)
    got = models.forest_fit_predict(train, train, ["a", "b"], "y", trees=33, depth=4).select("id", "pred").collect()
    want = _mllib(train, train, ["a", "b"], "y", 33, 4).select("id", "prediction").collect()
    assert np.allclose(sorted(map(tuple, got)), sorted(map(tuple, want)), rtol=1e-9)


@pytest.mark.parametrize("level", [0.1, -3.5, 0.0])
def test_constant_features_and_targets(spark, no_pass_per_level, level):
    train = staged(spark.range(5_000).select("id", F.lit(2).alias("a"), F.lit(True).alias("b"), F.lit(level).alias("y")), "flat")
    got = models.forest_fit_predict(train, train.limit(9), ["a", "b"], "y", trees=3).select("pred").collect()
    assert np.allclose([r.pred for r in got], [level] * 9, rtol=1e-12)


def test_few_rows_and_infinite_features_stay_with_mllib(spark):
    few = _rows(spark, 900)
    assert not forest.merges(few, ["a", "b"], few.count()) and not forest.merges(few, ["a", "b", "c", "id"], 10**9)
    assert forest.merges(few, ["a", "b"], 5_000) and not forest.merges(few.withColumn("a", F.array("a")), ["a", "b"], 5_000)
    train = staged(spark.range(5_000).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 2 == 0, float("inf")).otherwise(1.0).alias("b"), F.col("id").cast("double").alias("y")), "infinite")
    assert forest.cell_predictions(train, ["a", "b"], "y", 5_000, 2, 2, 0) is None
    with pytest.raises(PySparkException):  # MLlib refuses them
        models.forest_fit_predict(train, train, ["a", "b"], "y", trees=2, depth=2)


def test_a_tree_splits_where_the_variance_falls_most():
    rng = np.random.default_rng(1)
    shape = [4, 1, 5]
    counts = rng.integers(0, 3, 20).astype(float)
    sums = counts * rng.normal(0, 1, 20)
    places = [np.unravel_index(i, shape) for i in range(20)]

    def mean(members):
        return sum(sums[i] for i in members) / sum(counts[i] for i in members)

    def grow(members, depth):
        weigh = lambda part: sum(sums[i] for i in part) ** 2 / sum(counts[i] for i in part)
        best, parts = 1e-12, None
        for f, width in enumerate(shape):
            for cut in range(width - 1):
                left, right = [i for i in members if places[i][f] <= cut], [i for i in members if places[i][f] > cut]
                if sum(counts[i] for i in left) and sum(counts[i] for i in right):
                    gain = weigh(left) + weigh(right) - weigh(members)
                    if gain > best + 1e-12:
                        best, parts = gain, (left, right)
        if not depth or not parts:
            return dict.fromkeys(members, mean(members))
        return grow(parts[0], depth - 1) | grow(parts[1], depth - 1)

    for depth in (0, 1, 3, 9):
        want = grow(list(range(20)), depth)
        assert np.allclose(forest.grown(counts, sums, shape, depth), [want[i] for i in range(20)])


def test_rows_in_another_order_at_every_pass(spark, no_pass_per_level):
    def shuffled(batches):
        for batch in batches:
            yield batch.sample(frac=1.0)

    train = _rows(spark, 6_000).select("a", "b", (F.col("a") * 100.0).alias("y")).mapInPandas(shuffled, "a int, b double, y double")
    got = models.forest_fit_predict(train, train, ["a", "b"], "y", trees=12, depth=8).select("y", "pred").toPandas()
    assert ((got.pred - got.y).abs() < 150).all()  # bags that count other rows than they sum are off by thousands


def test_forest_predictions_join_once(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "merges", lambda *a: True)
    monkeypatch.setattr(models, "cell_predictions", lambda train, *a: seen.append(train))
    monkeypatch.setattr(models, "RandomForestRegressor", lambda **a: RandomForestRegressor(**a | {"numTrees": 1, "maxDepth": 1}))
    assert modelling.forest_predictions(spark, sf_dir).count() == 200
    assert seen[0].inputFiles() and all("/targets-" in f for f in seen[0].inputFiles())
