"""Random forests over rows merged by their bins: MLlib's trees without a pass over the rows per level."""

from __future__ import annotations

from functools import reduce
from math import prod

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..plans.stage import staged
from ..session import scratch_path

BINS = 32  # MLlib's default
MAX_CELLS = BINS**3  # a tree's totals are an array of this length
ROWS_A_CELL = 4
TREES_A_TASK = 10


def merges(train: DataFrame, features: list[str], rows: int) -> bool:
    """Whether rows outnumber the possible combinations of bins so that merging them shortens the fit."""
    most = BINS ** len(features)
    plain = all(isinstance(t.dataType, (NumericType, BooleanType)) for t in train.select(*features).schema)
    return plain and most <= MAX_CELLS and rows >= ROWS_A_CELL * most


def usable(features: list[str]) -> Column:
    """Rows a vector assembler keeps: no feature is null or NaN."""
    return reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features])


def thresholds(rows: DataFrame, features: list[str], n: int, seed: int) -> list[list[float]]:
    """The split candidates MLlib finds for the features, from the sample it would draw."""
    spark, fraction = rows.sparkSession, min(1.0, max(BINS * BINS, 10_000) / n)
    values = rows.select(*[F.col(f).cast("double").alias(f) for f in features])
    if fraction < 1.0:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        held = values._jdf.toJavaRDD().sample(False, fraction, draw)
        values = DataFrame(spark._jsparkSession.createDataFrame(held, values._jdf.schema()), spark)
    sample, expected = values.toPandas(), fraction * n
    return [_quantiles(sample[f].to_numpy(dtype=float), expected) for f in features]


def _quantiles(values: np.ndarray, expected: float) -> list[float]:
    found, counts = np.unique(values[values != 0], return_counts=True)
    missing = expected - counts.sum()  # MLlib takes what the sample lacks for zeros
    if missing > np.finfo(float).eps * expected * 100:
        at = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, at, 0.0), np.insert(counts.astype(float), at, missing)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) <= BINS - 1:
        return middles.tolist()
    stride, seen, picked = expected / BINS, counts[0], []
    target = stride
    for i in range(1, len(found)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            picked.append(float(middles[i - 1]))
            target += stride
    return picked


def cell(features: list[str], splits: list[list[float]]) -> Column:
    """The number of a row's combination of bins; a bin counts the thresholds below the value."""
    code = F.lit(0)
    for f, cuts in zip(features, splits):
        above = reduce(lambda a, b: a + b, [(F.col(f).cast("double") > F.lit(t)).cast("int") for t in cuts], F.lit(0))
        code = code * (len(cuts) + 1) + above
    return code


def _bagged(rows: DataFrame, cells: int, trees: int, seed: int, weight: str | None) -> DataFrame:
    """Per tree the bagged total of every cell, as ``tree, totals``.

    A forest of classifiers without splits has the cells as its classes: the class weights of its roots are the totals.
    Its draws hang on the seed, the partition and the row's place, so every such forest over ``rows`` draws the same bags,
    and those of a regression forest.
    """
    classes = {"ml_attr": {"type": "nominal", "num_vals": max(cells, 2)}}
    label = F.col("cell").cast("double").alias("label", metadata=classes)
    packed = VectorAssembler(inputCols=["none"], outputCol="x").transform(rows.select("y", label, F.lit(0.0).alias("none")))
    options = {"weightCol": weight} if weight else {}
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=0, seed=seed, **options)
    path = scratch_path(rows.sparkSession, "bags")
    forest.fit(packed).save(path)
    return rows.sparkSession.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.slice("nodeData.impurityStats", 1, cells).alias("totals")
    )


def grown(counts: np.ndarray, sums: np.ndarray, shape: list[int], depth: int) -> np.ndarray:
    """What a tree over bagged cells predicts for every cell: level by level the split with the largest fall in variance.

    Of equal splits the first feature's lowest is taken; a split without weight on a side or without a fall is none.
    """
    bins = np.unravel_index(np.arange(len(counts)), shape)
    value, live, node = np.zeros(len(counts)), np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64)
    for level in range(depth + 1):
        size = int(node.max()) + 1
        n, total = np.bincount(node, counts[live], size), np.bincount(node, sums[live], size)
        mean = total / n
        value[live] = mean[node]
        if level == depth:
            break
        apart = sums[live] - mean[node] * counts[live]
        best, by, cut = np.zeros(size), np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for f, width in enumerate(shape):
            if width < 2:
                continue
            at = node * width + bins[f][live]
            left = np.bincount(at, counts[live], size * width).reshape(size, width).cumsum(1)[:, :-1]
            off = np.bincount(at, apart, size * width).reshape(size, width).cumsum(1)[:, :-1]
            both = left * (n[:, None] - left)
            gain = np.divide(off * off * n[:, None], both, out=np.zeros_like(off), where=both > 0)
            first = gain.argmax(1)
            top = gain[np.arange(size), first]
            better = top > best
            best[better], by[better], cut[better] = top[better], f, first[better]
        split = best > 0
        if not split.any():
            break
        kept = split[node]
        live, node = live[kept], node[kept]
        place = np.choose(by[node], [b[live] for b in bins]) > cut[node]
        node = (np.cumsum(split) - 1)[node] * 2 + place
    return value


def cell_predictions(
    train: DataFrame, features: list[str], target: str, n: int, trees: int, depth: int, seed: int
) -> tuple[list[list[float]], DataFrame] | None:
    """Split candidates and a table ``cell, pred`` of the forest's prediction for every combination of bins.

    ``train``, a written table, holds ``n`` usable rows with finite targets. A tree's splits hang on a row only through its
    bins, so its bagged rows are summed per combination once, and every tree grows from these sums. Draws and splits are
    MLlib's over the same table; sums are rounded in another order, which may decide between splits of equal gain.
    None where a feature is infinite, which MLlib refuses, or thresholds or targets leave the range of doubles.
    """
    widest = [F.max(F.abs(F.col(f).cast("double"))) for f in features]
    low, high, *most = train.agg(F.min(target).cast("double"), F.max(target).cast("double"), *widest).first()
    splits = thresholds(train, features, n, seed)
    # totals of targets are class weights, which must be positive
    base = 0.0 if low > 0 else low - ((high - low) or abs(low) or 1.0)
    if not np.isfinite([high - base, *most, *[t for cuts in splits for t in cuts]]).all():
        return None
    shape = [len(cuts) + 1 for cuts in splits]
    cells = prod(shape)
    rows = train.select(cell(features, splits).alias("cell"), (F.col(target).cast("double") - base).alias("y"))
    counts, sums = _bagged(rows, cells, trees, seed, None), _bagged(rows, cells, trees, seed, "y")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values(["tree", "kind"]), np.zeros(cells)
        for i in range(0, len(pdf), 2):
            out += grown(np.asarray(pdf.totals.iloc[i], dtype=float), np.asarray(pdf.totals.iloc[i + 1], dtype=float), shape, depth)
        return pd.DataFrame({"cell": np.arange(cells, dtype=np.int32), "part": key[0], "total": out})

    both = counts.withColumn("kind", F.lit(0)).unionByName(sums.withColumn("kind", F.lit(1)))
    parts = both.groupBy((F.col("tree") / TREES_A_TASK).cast("int").alias("part")).applyInPandas(grow, "cell int, part int, total double")
    # added in one order, so that combinations in the same leaves of all trees have equal predictions
    ordered = F.array_sort(F.collect_list(F.struct("part", "total")))
    total = F.aggregate(ordered, F.lit(0.0), lambda a, p: a + p["total"])
    return splits, staged(parts.groupBy("cell").agg((total / trees + base).alias("pred")), "forest")
