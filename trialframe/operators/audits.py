"""Residual intervals and audits of predicted curves over design grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, is_close
from ..plans.ordered import join_on, ordered
from ..plans.ranks import percentiles
from .series import grid_gradient


def residual_intervals(
    train: DataFrame, test: DataFrame, time: str, obs: str, pred: str, cap: int | None = None
) -> DataFrame:
    """Shift each prediction by the training residual's mean and percentiles at its time.

    Time zero has no residual; times unseen in training use all non-zero times together.
    """
    points = {"__lo": 0.025, "__mid": 0.5, "__hi": 0.975}
    res = train.filter(finite(obs) & finite(pred)).select(F.col(time).alias("__t"), (F.col(obs) - F.col(pred)).alias("__e"))
    later = res.filter(~is_close("__t", 0.0))

    mean, sd = F.avg("__e"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("__e")).otherwise(0.0)
    per = percentiles(later, ["__t"], "__e", points, cap, also=(mean.alias("__mean"), sd.alias("__sd"))).drop("n")
    pooled = later.agg(F.struct(mean.alias("__mean"), sd.alias("__sd"))).scalar()
    spread = percentiles(later, [], "__e", points, cap).agg(F.struct(*[F.first(n).alias(n) for n in points])).scalar()
    j = join_on(test.withColumn("__t", F.col(time)), per, ["__t"], "left").withColumns({"__all": pooled, "__pts": spread})
    zero = is_close(time, 0.0)

    def value(n: str) -> Column:
        return F.when(zero, 0.0).otherwise(F.coalesce(n, f"{'__pts' if n in points else '__all'}.{n}"))

    out = j.withColumns(
        {
            "residual_mean": value("__mean"), "residual_sd": value("__sd"), "low": F.col(pred) + value("__lo"),
            "mid": F.col(pred) + value("__mid"), "high": F.col(pred) + value("__hi"),
        }
    ).drop("__t", "__all", "__pts", "__mean", "__sd", *points)
    return out.withColumn("covered", F.col(obs).between(F.col("low"), F.col("high")))


def curve_flags(
    df: DataFrame, model: list[str], grid: str, time: str, value: str, axes: list[str], t_end: float, upper: float | str,
    bounds: dict[str, tuple[float, float]], cap: int | None = None,
) -> DataFrame:
    """One row per curve: points, negatives, failures, monotonicity, end value and boundary flag.

    ``upper`` is the largest plausible end value. The rows are sorted once; every audit aggregates this.
    """
    keys = [*model, grid]
    o = ordered(df, keys, [time], cap).previous(__prev=F.col(value))
    v, ok = F.col(value), finite(value)
    limit = F.lit(upper) if isinstance(upper, (int, float)) else F.col(upper)
    edge = F.lit(False)
    for a, (lo, hi) in bounds.items():
        edge = edge | is_close(a, float(lo)) | is_close(a, float(hi))
    end = F.max(F.when(is_close(time, t_end), v))
    end_there = F.max(is_close(time, t_end))
    flags = o.df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(ok & (v < -1e-12)).alias("negatives"), F.count_if(~ok).alias("failures"),
        F.count_if(v - F.col("__prev") < -1e-9).alias("__drops"), end.alias("end_value"), end_there.alias("has_end"),
        *[F.max(a).alias(a) for a in axes], F.max(edge).alias("is_boundary"), F.max(limit).alias("__upper"),
    )
    return flags.withColumns(
        {
            "non_monotonic": (F.col("failures") == 0) & (F.col("__drops") > 0),
            "extreme": F.coalesce(
                finite("end_value") & ((F.col("end_value") < 0) | (F.col("end_value") > F.col("__upper"))), F.lit(False)
            ),
        }
    ).drop("__drops", "__upper")


def _rate(c: Column) -> Column:
    return F.avg(c.cast("double"))


def plausibility_audit(flags: DataFrame, model: list[str], grid: str, axes: list[str]) -> DataFrame:
    """Rates of implausible predictions per model and its best predicted point."""
    top = F.when(finite("end_value"), F.struct(F.col("end_value"), (-F.col(grid)).alias("g")))
    pick = lambda c: F.max_by(c, top)
    return flags.groupBy(*model).agg(
        F.count(F.lit(1)).alias("curves"), F.sum("points").alias("points"),
        (F.sum("negatives") / F.sum("points")).alias("negative_rate"), _rate(F.col("non_monotonic")).alias("non_monotonic_rate"),
        (F.count_if("extreme") / F.count_if("has_end")).alias("extreme_rate"),
        (F.sum("failures") / F.sum("points")).alias("failure_rate"),
        pick(grid).alias("top_grid_id"), *[pick(a).alias(f"top_{a}") for a in axes], pick("end_value").alias("top_end"),
        F.coalesce(pick("is_boundary"), F.lit(False)).alias("top_is_boundary"),
    )


def optimum_safety(flags: DataFrame, model: list[str], grid: str, axes: list[str]) -> DataFrame:
    """Best grid point per model and seed with its own failure, negativity and monotonicity flags."""
    top = F.when(finite("end_value"), F.struct(F.col("end_value"), (-F.col(grid)).alias("g")))
    pick = lambda c: F.max_by(c, top)
    none = F.count(top) == 0
    return flags.groupBy(*model).agg(
        *[pick(a).alias(f"best_{a}") for a in axes], pick("end_value").alias("best_end"),
        F.coalesce(pick("is_boundary"), F.lit(False)).alias("best_is_boundary"),
        F.when(none, True).otherwise(pick(F.col("failures") > 0)).alias("best_has_failure"),
        F.coalesce(pick(F.col("negatives") > 0), F.lit(False)).alias("best_has_negative"),
        F.coalesce(pick("non_monotonic"), F.lit(False)).alias("best_non_monotonic"),
        _rate(F.col("failures") > 0).alias("failed_curve_rate"), _rate(F.col("extreme")).alias("extreme_rate"),
    )


def rhs_rates(df: DataFrame, by: list[str], rhs: str, slope: str) -> DataFrame:
    """Rates of negative right-hand sides and of positive slopes among finite values."""
    return df.groupBy(*by).agg(
        F.avg(F.when(finite(rhs), (F.col(rhs) < -1e-12).cast("double"))).alias("negative_rhs_rate"),
        F.avg(F.when(finite(slope), (F.col(slope) > 1e-12).cast("double"))).alias("positive_slope_rate"),
    )


def sensitivity_class(df: DataFrame, model: list[str], axes: list[str], value: str, cap: int | None = None) -> DataFrame:
    """Range, deviation and gradients of an outcome over a design grid, and the structural class."""
    grads = grid_gradient(df, model, axes, value, cap)
    ok = F.when(finite(value), F.col(value))
    aggs = [
        F.min(ok).alias("min"), F.max(ok).alias("max"), (F.max(ok) - F.min(ok)).alias("range"), F.stddev_pop(ok).alias("sd"),
    ]
    for a in axes:
        g = F.when(finite(f"d_{a}"), F.abs(f"d_{a}"))
        aggs += [F.avg(g).alias(f"mean_abs_{a}"), F.max(g).alias(f"max_abs_{a}")]
    out = grads.groupBy(*model).agg(*aggs)
    sizes = df.filter(finite(value)).select(*model, F.abs(F.col(value)).alias("__v"))
    out = join_on(out, percentiles(sizes, model, "__v", {"__med": 0.5}, cap).drop("n"), model, "left")
    active = [F.coalesce(F.col(f"mean_abs_{a}") > 1e-3 * F.greatest(F.lit(1.0), F.col("range")), F.lit(False)) for a in axes]
    count = sum((x.cast("int") for x in active), F.lit(0))
    varied = F.coalesce(F.col("range") > 1e-6 * F.greatest(F.lit(1.0), F.col("__med")), F.lit(False))
    return out.withColumns({"nontrivial": varied, "active_axes": count}).withColumn(
        "structural_class",
        F.when((F.col("active_axes") >= 2) & F.col("nontrivial"), "structurally_valid")
        .when(F.col("active_axes") == 1, "structurally_weak").otherwise("degenerate_for_optimisation"),
    ).drop("__med")
