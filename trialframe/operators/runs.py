"""Analytics over many optimisation runs and sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import l2
from ..functions.numeric import finite
from ..plans.ordered import join_on
from ..plans.ranks import percentiles
from .corpus import first_per_key


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts per value; null is a value."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def describe_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, one row per column."""
    tall = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    basic = (
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return percentiles(tall, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, also=basic).drop("n")


def level_summary(
    df: DataFrame, params: list[str], metrics: list[str], baseline: DataFrame | None = None, cap: int | None = None
) -> DataFrame:
    """Median, mean, deviation and count of each metric per parameter level.

    ``baseline(param, level)`` adds the relative change of the median to the baseline level's.
    """
    typed = df.select(*[F.col(p).cast("double").alias(p) for p in params], *[F.col(m).cast("double").alias(m) for m in metrics])
    tall = typed.unpivot(metrics, params, "param", "level").unpivot(["param", "level"], metrics, "metric", "value")
    tall = tall.filter(finite("value"))
    keys = ["param", "level", "metric"]
    basic = (F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    out = percentiles(tall, keys, "value", {"median": 0.5}, cap, also=basic).withColumnRenamed("n", "count")
    if baseline is None:
        return out
    base = join_on(out.select(*keys, F.col("median").alias("__base")), baseline.select("param", "level"), ["param", "level"], "left_semi")
    joined = join_on(out, base.drop("level"), ["param", "metric"], "left")
    delta = (F.col("median") - F.col("__base")) / F.greatest(F.abs("__base"), F.lit(1e-12))
    return joined.withColumn("rel_delta", delta).drop("__base")


def baseline_level(df: DataFrame, params: dict[str, float | None]) -> DataFrame:
    """Preferred level of each parameter where it occurs, else the smallest most frequent one."""
    cols = list(params)
    tall = df.select(*[F.col(p).cast("double").alias(p) for p in cols]).unpivot([], cols, "param", "level")
    wanted = F.create_map(*[x for p, v in params.items() for x in (F.lit(p), F.lit(v).cast("double"))])
    counts = tall.filter(F.col("level").isNotNull()).groupBy("param", "level").agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.col("level") == wanted[F.col("param")], F.lit(False))
    return first_per_key(counts.withColumn("preferred", first), ["param"], [F.desc("preferred"), F.desc("n"), F.asc("level")])


def best_level(summary: DataFrame, by: list[str], order: list[str], tie: str) -> DataFrame:
    """First level by the given statistics, missing ones last."""
    keys = [F.asc_nulls_last(F.when(finite(c), F.col(c))) for c in order]
    return first_per_key(summary, by, [*keys, F.asc(tie)])


def expected_batches(spark, levels: dict[str, list | Column]) -> DataFrame:
    """Every combination of the given levels, lists or array expressions such as the scalar subquery of a table's values; its
    size is the product of the lists."""
    out = spark.range(1)
    for name, values in levels.items():
        out = out.withColumn(name, F.explode(values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values])))
    return out.drop("id")


def incomplete_batches(points: DataFrame, batch: list[str], expected: int, combos: DataFrame | None = None) -> DataFrame:
    """Batches whose point count is not the expected one, absent combinations included."""
    counts = points.groupBy(*batch).agg(F.count(F.lit(1)).alias("points"))
    if combos is not None:
        counts = join_on(combos, counts, batch, "left").withColumn("points", F.coalesce("points", F.lit(0)))
    return counts.filter(F.col("points") != expected)


def batch_diversity(
    points: DataFrame, batch: list[str], x: str, expected: int, bounds: DataFrame | None = None, bound_key: list[str] | None = None
) -> DataFrame:
    """Mean pairwise distance inside each batch of exactly ``expected`` points, on scaled axes.

    ``bounds(bound_key.., lo, hi)`` holds the axis ranges. Other batches are left out before anything is
    gathered, so a gathered list never exceeds ``expected`` points.
    """
    sizes = points.groupBy(*batch).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == expected)
    rows = join_on(points.select(*batch, F.col(x).alias("__x")), sizes.select(*batch), batch, "left_semi")
    if bounds is not None:
        rows = join_on(rows, bounds, bound_key)
        low = F.zip_with("__x", "lo", lambda v, lo: v - lo)
        span = F.zip_with("hi", "lo", lambda h, lo: h - lo)
        rows = rows.withColumn("__x", F.zip_with(low, span, lambda v, s: F.when(s == 0, 0.0).otherwise(v / s)))
    held = rows.groupBy(*batch).agg(F.array_sort(F.collect_list("__x")).alias("__p"))
    pairs = [(i, j) for i in range(expected) for j in range(i + 1, expected)]
    total = reduce(lambda a, b: a + b, [l2(F.col("__p")[i], F.col("__p")[j]) for i, j in pairs], F.lit(0.0))
    return held.select(*batch, (total / float(max(1, len(pairs)))).alias("diversity"))


def seed_then_group(df: DataFrame, group: list[str], seed: str, value: str) -> DataFrame:
    """Mean per seed, then mean, sample deviation and count of the seed means."""
    per = df.groupBy(*group, seed).agg(F.avg(value).alias("__m"))
    return per.groupBy(*group).agg(
        F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("sd"), F.count(F.lit(1)).alias("n")
    )


def pivot_methods(stats: DataFrame, by: list[str], method: str, methods: list[str], values: list[str]) -> DataFrame:
    return stats.groupBy(*by).agg(
        *[F.max(F.when(F.col(method) == m, F.col(v))).alias(f"{m}_{v}") for m in methods for v in values]
    )


def winners(stats: DataFrame, by: list[str], method: str, mean: str, own: str | None = None) -> DataFrame:
    """Methods whose mean is close to the best one (rtol 1e-5, atol 1e-8), joined in order.

    Raw means are compared. ``own`` names the method whose standing is reported.
    """
    best = stats.groupBy(*by).agg(F.max(mean).alias("best_mean"))
    tied = join_on(stats, best, by).filter(
        F.abs(F.col(mean) - F.col("best_mean")) <= 1e-8 + 1e-5 * F.abs("best_mean")
    )
    out = tied.groupBy(*by).agg(F.first("best_mean").alias("best_mean"), F.array_sort(F.collect_set(method)).alias("__w"))
    cols = {"winner": F.array_join("__w", ", ")}
    if own is not None:
        cols["status"] = F.when(F.array_contains("__w", own), "best").otherwise("worse")
    return out.withColumns(cols).drop("__w")


def pivot_median(df: DataFrame, rows: list[str], pivot: str, levels: list, metric: str, cap: int | None = None) -> DataFrame:
    """Median of the metric per setting, one column per level of ``pivot``."""
    med = percentiles(df, [*rows, pivot], metric, {"median": 0.5}, cap)
    return med.groupBy(*rows).agg(*[F.max(F.when(F.col(pivot) == v, F.col("median"))).alias(f"m_{v}") for v in levels])


def best_config_history(df: DataFrame, config: list[str], metric: str, maximise: bool = True, cap: int | None = None) -> DataFrame:
    """All runs of the configuration with the best median."""
    med = percentiles(df, config, metric, {"median": 0.5}, cap)
    first = med.orderBy(F.desc("median") if maximise else F.asc("median"), *config).limit(1)
    return join_on(df, first.select(*config), config, "left_semi")


def axis_profile(best: DataFrame, axes: dict[str, tuple[float, float]], steps: int) -> DataFrame:
    """One-at-a-time sweep: each axis over its range, the others at the best point."""
    line = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / float(steps - 1))
    sweeps = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")) for a, (lo, hi) in axes.items()])
    rows = best.withColumn("__s", F.explode(sweeps)).withColumn("__u", F.explode(line))
    at = F.col("__s.lo") + F.col("__u") * (F.col("__s.hi") - F.col("__s.lo"))
    cols = {a: F.when(F.col("__s.axis") == a, at).otherwise(F.col(a).cast("double")) for a in axes}
    return rows.withColumns({"axis": F.col("__s.axis"), **cols}).drop("__s", "__u")


def model_summary(df: DataFrame, group: list[str], metric: str, keep: list[str], tie: str, minimise: bool = True) -> DataFrame:
    """Best row, mean, deviation (0 for a single run) and number of valid runs per model."""
    ok = df.withColumn("__ok", finite(metric))
    score = F.col(metric) if minimise else -F.col(metric)
    place = F.when(F.col("__ok"), F.struct(score, F.col(tie)))
    n = F.count_if("__ok")
    valid = F.when(F.col("__ok"), F.col(metric))
    return ok.groupBy(*group).agg(
        F.count(F.lit(1)).alias("runs"), n.alias("valid"), F.avg(valid).alias("mean"),
        F.when(n == 1, 0.0).otherwise(F.stddev_samp(valid)).alias("sd"),
        F.min_by(metric, place).alias("best"), *[F.min_by(c, place).alias(f"best_{c}") for c in keep],
    )


def unify_groups(tables: dict[str, DataFrame], name: str = "family") -> DataFrame:
    parts = [t.withColumn(name, F.lit(n)) for n, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def replicate_profile(df: DataFrame, by: list[str], time: str, value: str, sigma: str | None = None) -> DataFrame:
    """Mean over replicate cells, with the standard deviation of that mean if ``sigma`` is given."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")]
    if sigma is not None:
        s = F.col(sigma)
        aggs.append((F.sqrt(F.sum(s * s)) / F.count(F.lit(1))).alias("sd_mean"))
    return df.groupBy(*by, time).agg(*aggs)


