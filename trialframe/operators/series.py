"""Ordered-series operators: segments, incumbents, bands, recurrences, gradients, interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import join_on, ordered
from ..plans.ranks import percentiles


def segment_runs(df: DataFrame, by: list[str], order: list[str], iteration: str, cap: int | None = None) -> DataFrame:
    """Number the runs appended to one log: a run starts where the iteration does not increase.

    Rows without an iteration are left out.
    """
    rows = df.filter(F.col(iteration).isNotNull())
    o = ordered(rows, by, order, cap).previous(__prev=F.col(iteration))
    fresh = F.coalesce((F.col(iteration) <= F.col("__prev")).cast("long"), F.lit(0))
    o = o._replace(o.df.withColumn("__fresh", fresh)).running(segment=("sum", F.col("__fresh")))
    return o.done().drop("__prev", "__fresh")


def run_ends(segments: DataFrame, by: list[str], iteration: str, value: str) -> DataFrame:
    """Last iteration, last value and length of every segment."""
    return segments.groupBy(*by, "segment").agg(
        F.max(iteration).alias("last_iteration"), F.max_by(value, iteration).alias("final"), F.count(F.lit(1)).alias("rows")
    )


def last_complete_runs(
    df: DataFrame, by: list[str], order: list[str], iteration: str, value: str, final: int, n: int,
    seed: str | None = None, seeds: list[int] | None = None, cap: int | None = None,
) -> DataFrame:
    """Final values of the runs that count.

    Where all of ``seeds`` occur in a group, each seed gives its last complete run, or its last run if
    none is complete; elsewhere the last ``n`` complete runs of the log count.
    """
    ends = run_ends(segment_runs(df, by, order, iteration, cap), by, iteration, value)
    recent = Window.partitionBy(*by).orderBy(F.desc("segment"))
    plain = (
        ends.filter(F.col("last_iteration") == final).withColumn("__rn", F.row_number().over(recent))
        .filter(F.col("__rn") <= n).select(*by, F.lit(None).cast("long").alias("seed"), "segment", "final")
    )
    if seed is None:
        return plain.withColumn("source", F.lit("complete_segments"))
    known = df.filter(F.col(seed).isin(*seeds) & F.col(iteration).isNotNull())
    full = known.groupBy(*by).agg(F.count_distinct(seed).alias("__n")).filter(F.col("__n") >= len(seeds)).select(*by)
    keys = [*by, seed]
    each = run_ends(segment_runs(known, keys, order, iteration, cap), keys, iteration, value)
    w = Window.partitionBy(*keys).orderBy(F.desc(F.col("last_iteration") == final), F.desc("segment"))
    seeded = each.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select(
        *by, F.col(seed).cast("long").alias("seed"), "segment", "final"
    )
    return (
        join_on(seeded, full, by, "left_semi").withColumn("source", F.lit("seeded"))
        .unionByName(join_on(plain, full, by, "left_anti").withColumn("source", F.lit("complete_segments")))
    )


def repair_shift(df: DataFrame, iteration: str, best: str, weight: str, seed: str, spare: str, top: int = 30) -> DataFrame:
    """Undo rows written one column to the right under an older header."""
    it, b, w = (F.col(c).cast("double") for c in (iteration, best, weight))
    moved = F.coalesce(it.isNull() & b.between(1, top) & w.isNotNull(), F.lit(False))
    out = df.withColumns(
        {
            "__it": F.when(moved, b).otherwise(it), "__b": F.when(moved, w).otherwise(b),
            seed: F.when(moved, F.col(spare).cast("double")).otherwise(F.col(seed).cast("double")),
        }
    )
    out = out.withColumns({iteration: F.col("__it"), best: F.col("__b")}).drop("__it", "__b")
    return out.filter(F.col(iteration).isNotNull() & F.col(best).isNotNull())


def incumbent(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "best", cap: int | None = None) -> DataFrame:
    return ordered(df, by, order, cap).running(**{name: ("max", F.col(value))}).done()


def improvements(df: DataFrame, by: list[str], order: list[str], best: str, init: Column, cap: int | None = None) -> DataFrame:
    """Positive steps of a curve from an initial best, and their running sum."""
    o = ordered(df, by, order, cap).previous(__prev=F.col(best))
    step = F.greatest(F.col(best) - F.coalesce("__prev", init), F.lit(0.0))
    o = o._replace(o.df.withColumn("improvement", step)).running(cumulative=("sum", F.col("improvement")))
    return o.done().drop("__prev")


def improvement_counts(steps: DataFrame, by: list[str]) -> DataFrame:
    return steps.groupBy(*by).agg(
        F.count_if(F.col("improvement") > 0).alias("improvements"), F.sum("improvement").alias("total")
    )


def pad_curve(df: DataFrame, by: list[str], order: list[str], best: str, init: Column, n: int, cap: int | None = None) -> DataFrame:
    """Gain over the initial best at positions 1..n; short runs repeat their last value."""
    o = ordered(df, by, order, cap).index("__i").total(__n=("count", F.lit(1)))
    rows = o.done().filter(F.col("__i") <= n)
    last = F.col("__i") == F.least(F.col("__n"), F.lit(n))
    spots = F.when(last, F.sequence(F.col("__i"), F.lit(n).cast("long"))).otherwise(F.array("__i"))
    return rows.select(*by, F.explode(spots).alias("position"), F.greatest(F.col(best) - init, F.lit(0.0)).alias("gain"))


def bands(df: DataFrame, by: list[str], x: str, value: str, mode: str = "ci95") -> DataFrame:
    """Mean with standard error, 95 % interval or standard deviation around it."""
    n, sd = F.count(value), F.stddev_samp(value)
    se = sd / F.sqrt(n)
    # The critical values in use.
    crit = F.when(n == 10, 2.262).when(n >= 30, 1.96).otherwise(2.2)
    half = {"se": se, "ci95": crit * se, "sd": sd}[mode]
    out = df.groupBy(*by, x).agg(n.alias("n"), F.avg(value).alias("mean"), sd.alias("sd"), half.alias("half"))
    return out.withColumns({"low": F.col("mean") - F.col("half"), "high": F.col("mean") + F.col("half")})


def cumulative_bands(stats: DataFrame, by: list[str], x: str, cap: int | None = None) -> DataFrame:
    """Running sum of means, its deviation the root of the summed variances."""
    rows = stats.withColumn("__v", F.col("sd") * F.col("sd"))
    o = ordered(rows, by, [x], cap).running(cum_mean=("sum", F.col("mean")), __cv=("sum", F.col("__v")))
    return o.done().withColumn("cum_sd", F.sqrt("__cv")).drop("__v", "__cv")


def adaptive_weights(
    df: DataFrame, by: list[str], order: list[str], first: str, second: str, k: int, alpha: float = 0.0,
    rounding: str = "floor", start: float = 0.5, epsilon: float = 1e-9, cap: int | None = None,
) -> DataFrame:
    """Smoothed share of the first strategy and the points each strategy gets.

    w(t) = alpha * w(t-1) + (1 - alpha) * a(t). The recurrence is unrolled over blocks of positions so
    long that alpha**length vanishes in double precision: inside a block it is a scaled running sum, and
    only the end of the preceding block carries over. No run is gathered into one task.
    """
    a, b = F.col(first), F.col(second)
    share = F.when(a + b == 0, 0.5).otherwise(a / (a + b + epsilon))
    rows = ordered(df.withColumn("__a", share), by, order, cap).index("__t").done()
    if alpha <= 0:
        out = rows.withColumn("weight_first", F.col("__a"))
    elif alpha >= 1:
        out = rows.withColumn("weight_first", F.lit(start))
    else:
        length = max(1, int(150 / -math.log10(alpha)))
        pos = (F.col("__t") - 1) % length
        rows = rows.withColumns({"__blk": F.floor((F.col("__t") - 1) / length), "__pos": pos.cast("double")})
        w = Window.partitionBy(*by, "__blk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
        al = F.lit(alpha)
        local = F.sum((1 - alpha) * F.col("__a") * F.pow(al, -F.col("__pos"))).over(w) * F.pow(al, F.col("__pos"))
        rows = rows.withColumn("__s", local)
        ends = rows.groupBy(*by, (F.col("__blk") + 1).alias("__blk")).agg(F.max_by("__s", "__pos").alias("__end"))
        out = join_on(rows, ends, [*by, "__blk"], "left")
        before = F.when(F.col("__blk") == 0, F.lit(start)).otherwise(F.col("__end"))
        out = out.withColumn("weight_first", F.col("__s") + F.pow(al, F.col("__pos") + 1) * before)
        out = out.drop("__blk", "__pos", "__s", "__end")
    points = F.col("weight_first") * k
    # the tolerance keeps whole numbers whole whichever way the sum was formed
    whole = F.floor(points + 1e-12) if rounding == "floor" else F.bround(F.round(points, 10), 0)
    n_first = F.greatest(F.lit(1), whole.cast("int"))
    return out.withColumns(
        {"weight_second": 1.0 - F.col("weight_first"), "n_first": n_first, "n_second": F.lit(k) - n_first}
    ).drop("__a", "__t")


def batch_accuracy(df: DataFrame, by: list[str], batch: str, value: str, best_at: str = "post", cap: int | None = None) -> DataFrame:
    """Share of a batch's values reaching the best one, taken after (``post``) or before the batch."""
    tops = df.groupBy(*by, batch).agg(F.max(value).alias("__top"))
    run = ordered(tops, by, [batch], cap).running(exclusive=best_at == "pre", __best=("max", F.col("__top"))).done()
    rows = join_on(df.select(*by, batch, value), run, [*by, batch])
    hit = F.col(value) >= F.coalesce("__best", F.lit(float("-inf")))
    return rows.groupBy(*by, batch).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"))


def grid_gradient(df: DataFrame, by: list[str], axes: list[str], value: str, cap: int | None = None) -> DataFrame:
    """Central differences along each axis of a grid, one-sided at its edges."""
    for axis in axes:
        line = [*by, *[a for a in axes if a != axis]]
        o = ordered(df, line, [axis], cap)
        o = o.previous(__px=F.col(axis), __pv=F.col(value)).following(__nx=F.col(axis), __nv=F.col(value))
        x, v = F.col(axis), F.col(value)
        hs, hd = x - F.col("__px"), F.col("__nx") - x
        inner = (hs * hs * F.col("__nv") + (hd * hd - hs * hs) * v - hd * hd * F.col("__pv")) / (hs * hd * (hs + hd))
        slope = (
            F.when(F.col("__px").isNotNull() & F.col("__nx").isNotNull(), inner)
            .when(F.col("__nx").isNotNull(), (F.col("__nv") - v) / hd)
            .when(F.col("__px").isNotNull(), (v - F.col("__pv")) / hs)
        )
        df = o.done().withColumn(f"d_{axis}", slope).drop("__px", "__pv", "__nx", "__nv")
    return df


def gap_to_next(df: DataFrame, by: list[str], value: str, ident: str, cap: int | None = None) -> DataFrame:
    """Value minus the next lower one; null for the last."""
    o = ordered(df, by, [f"-{value}", ident], cap).following(__n=F.col(value))
    return o.done().withColumn("gap", F.col(value) - F.col("__n")).drop("__n")


def convergence_point(df: DataFrame, by: list[str], generation: str, value: str, frac: float = 0.99) -> DataFrame:
    """First generation whose value reaches the share ``frac`` of the run's final value."""
    ends = df.groupBy(*by).agg(F.max_by(value, generation).alias("final"), F.max(generation).alias("generations"))
    hit = F.when(F.col(value) >= frac * F.col("final"), F.col(generation))
    return join_on(df.select(*by, generation, value), ends, by).groupBy(*by).agg(
        F.first("final").alias("final"), F.first("generations").alias("generations"), F.min(hit).alias("reached_at")
    )


def stop_position(
    df: DataFrame, by: list[str], order: list[str], poe: str, threshold: float, ei: str | None = None, cap: int | None = None
) -> DataFrame:
    """Leading continues before the first stop; the whole length if there is none.

    A stop is a probability below the threshold, with ``ei`` given also a falling expected improvement.
    """
    o = ordered(df, by, order, cap).index("__i")
    stop = F.col(poe) < threshold
    if ei is not None:
        o = o.previous(__ei=F.col(ei))
        stop = stop & F.coalesce(F.col(ei) - F.col("__ei") < 0, F.lit(False))
    first = F.min(F.when(stop, F.col("__i")))
    return o.df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("planned"), F.coalesce(first - 1, F.count(F.lit(1))).alias("position"),
        first.isNotNull().alias("stopped"),
    )


def interp_at(curve: DataFrame, queries: DataFrame, by: list[str], x: str, y: str, ident: str, cap: int | None = None) -> DataFrame:
    """Piecewise-linear lookup, constant beyond the ends.

    Curve and query points are sorted together; the nearest curve point on either side is a running
    extreme, so no range join is needed.
    """
    both = curve.select(*by, x, F.col(y).alias("__y"), F.lit(0).alias("__q"), F.lit(None).cast("long").alias(ident)).unionByName(
        queries.select(*by, x, F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__q"), F.col(ident).cast("long").alias(ident))
    )
    point = F.when(F.col("__q") == 0, F.struct(F.col(x).alias("x"), F.col("__y").alias("y")))
    back = ordered(both, by, [x, "__q", ident], cap).running(__lo=("max", point)).done()
    rows = ordered(back, by, [f"-{x}", "__q", ident], cap).running(__hi=("min", point)).done()
    lo, hi, at = F.col("__lo"), F.col("__hi"), F.col(x)
    inside = lo["y"] + (hi["y"] - lo["y"]) * (at - lo["x"]) / (hi["x"] - lo["x"])
    value = F.when(lo.isNull(), hi["y"]).when(hi.isNull() | (hi["x"] == lo["x"]), lo["y"]).otherwise(inside)
    return rows.filter("__q = 1").select(*by, ident, x, value.alias(y))


def curve_from_points(
    df: DataFrame, by: list[str], x: str, y: str, min_points: int = 50, min_columns: int = 30, cap: int | None = None
) -> DataFrame:
    """Median height per pixel column, whole numbers, for curves with enough points and columns."""
    cols = percentiles(df, [*by, x], y, {"__m": 0.5}, cap)
    size = cols.groupBy(*by).agg(F.sum("n").alias("points"), F.count(F.lit(1)).alias("columns"))
    kept = size.filter((F.col("points") >= min_points) & (F.col("columns") >= min_columns)).select(*by)
    return join_on(cols, kept, by, "left_semi").select(*by, x, F.col("__m").cast("int").alias(y))


def affine(c: str, p0: float, p1: float, lo: float, hi: float) -> Column:
    """Pixel to data value."""
    return lo + (F.col(c) - p0) / (p1 - p0) * (hi - lo)


def wide_to_curve(df: DataFrame, ids: list[str], times: dict[str, float], value: str = "q_obs") -> DataFrame:
    """Release columns to long rows with hours, and the point (0, 0) of every run."""
    anchor = "__t0"
    wide = df.select(*ids, F.lit(0.0).alias(anchor), *[F.col(c).cast("double").alias(c) for c in times])
    hours = {anchor: 0.0, **times}
    tall = wide.unpivot(ids, list(hours), "__c", value)
    chain = F.create_map(*[F.lit(v) for pair in hours.items() for v in pair])
    return tall.select(*ids, chain[F.col("__c")].alias("time_h"), value)


def curve_to_wide(df: DataFrame, ids: list[str], time: str, value: str, times: dict[str, float]) -> DataFrame:
    return df.groupBy(*ids).agg(*[F.max(F.when(F.abs(F.col(time) - t) <= 1e-8, F.col(value))).alias(c) for c, t in times.items()])
