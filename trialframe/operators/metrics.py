"""Regression, curve and rank metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, is_close
from ..functions.pvalues import f_tail, fair_coin_tail
from ..plans.concordance import concordance
from ..plans.ordered import join_on, ordered, settle
from ..plans.ranks import percentiles, with_ranks
from ..plans.stage import staged


def both_finite(df: DataFrame, obs: str, pred: str) -> DataFrame:
    return df.filter(finite(obs) & finite(pred))


def _error_aggs(obs: str, pred: str, scale: float | None) -> list[Column]:
    y, e = F.col(obs), F.col(obs) - F.col(pred)
    n = F.count(F.lit(1))
    mse = F.avg(e * e)
    spread = F.var_pop(y)
    residual = F.sum(e * e)
    r2 = F.when(spread == 0, F.when(residual == 0, F.lit(1.0)).otherwise(F.lit(float("nan")))).otherwise(
        1.0 - residual / (n * spread)
    )
    aggs = [
        n.alias("n"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), mse.alias("mse"), r2.alias("r2"),
    ]
    if scale is not None:
        aggs.append((mse / (float(scale) ** 2)).alias("mse_scaled"))
    return aggs


def regression_metrics(
    df: DataFrame, by: list[str], obs: str, pred: str, scale: float | None = None
) -> DataFrame:
    """RMSE, MAE, MSE, R2 and optionally scaled MSE in one map-side-combined pass.

    A constant observation gives R2 = 1 for perfect predictions and NaN otherwise.
    """
    return both_finite(df, obs, pred).groupBy(*by).agg(*_error_aggs(obs, pred, scale))


def extended_metrics(df: DataFrame, by: list[str], obs: str, pred: str) -> DataFrame:
    """Adds explained variance and mean absolute percentage error."""
    y, e = F.col(obs), F.col(obs) - F.col(pred)
    spread = F.var_pop(y)
    explained = F.when(spread == 0, F.when(F.var_pop(e) == 0, 1.0).otherwise(0.0)).otherwise(
        1.0 - F.var_pop(e) / spread
    )
    mape = F.avg(F.abs(F.try_divide(e, y))) * 100.0
    return both_finite(df, obs, pred).groupBy(*by).agg(
        *_error_aggs(obs, pred, None), explained.alias("explained_variance"), mape.alias("mape_pct")
    )


def curve_metrics(df: DataFrame, by: list[str], time: str, obs: str, pred: str, scale: float | None = None) -> DataFrame:
    """Metrics excluding time zero, including it, and at each time point.

    One aggregation per (key, time) keeps sufficient statistics; the three scopes are built from
    those few rows, so the table is read and shuffled once.
    """
    y, e = F.col(obs), F.col(obs) - F.col(pred)
    per_time = both_finite(df, obs, pred).groupBy(*by, F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(e * e).alias("s2"), F.sum(F.abs(e)).alias("s1"),
        F.avg(y).alias("m"), F.var_pop(y).alias("v"),
    )
    label = F.format_string("time_%s", F.col("time").cast("double").cast("string"))
    scopes = F.array_compact(
        F.array(F.lit("including_t0"), F.when(~is_close("time", 0.0), F.lit("excluding_t0")), label)
    )
    tall = per_time.withColumn("scope", F.explode(scopes))
    n = F.sum("c")
    # variance of the scope: within the times, plus the squared distances of the time means from the scope's mean
    means = tall.groupBy(*by, "scope").agg((F.sum(F.col("c") * F.col("m")) / n).alias("__grand"))
    off = F.col("m") - F.col("__grand")
    out = join_on(tall, means, [*by, "scope"]).groupBy(*by, "scope").agg(
        n.alias("n"), F.sum("s2").alias("ss_res"), F.sum("s1").alias("s1"), F.sum(F.col("c") * (F.col("v") + off * off)).alias("ss_tot"),
    )
    mse = F.col("ss_res") / F.col("n")
    r2 = F.when(
        F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, F.lit(1.0)).otherwise(F.lit(float("nan")))
    ).otherwise(1.0 - F.col("ss_res") / F.col("ss_tot"))
    cols = [F.sqrt(mse).alias("rmse"), (F.col("s1") / F.col("n")).alias("mae"), mse.alias("mse"), r2.alias("r2")]
    if scale is not None:
        cols.append((mse / float(scale) ** 2).alias("mse_scaled"))
    return out.select(*by, "scope", "n", *cols)


def auc_trapezoid(
    df: DataFrame, by: list[str], time: str, cols: list[str], tmax: float | None = None,
    anchor: bool = True, tie: list[str] | None = None, cap: int | None = None,
) -> DataFrame:
    """Area under each curve up to ``tmax``; a curve starting after zero is anchored at (0, 0)."""
    if tmax is not None:
        df = df.filter(F.col(time) <= F.lit(tmax))
    prev = {"__t": F.col(time), **{f"__p_{c}": F.col(c) for c in cols}}
    rows = ordered(df, by, [time, *(tie or [])], cap).previous(**prev).df
    areas = []
    for c in cols:
        strip = (F.col(time) - F.col("__t")) * (F.col(c) + F.col(f"__p_{c}")) / 2.0
        first = F.col(time) * F.col(c) / 2.0
        start = F.when(F.col(time) > 0, first).otherwise(0.0) if anchor else F.lit(0.0)
        areas.append(F.sum(F.when(F.col("__t").isNull(), start).otherwise(strip)).alias(f"auc_{c}"))
    return rows.groupBy(*by).agg(*areas)


def endpoint_from_curve(
    df: DataFrame, record: list[str], groups: list[str], time: str, cols: list[str], t_end: float,
    cap: int | None = None,
) -> DataFrame:
    """Value at ``t_end`` and area per record, each with its descending minimum rank in the group."""
    keys = [*groups, *record]
    at_end = is_close(time, t_end)
    ends = df.groupBy(*keys).agg(*[F.max(F.when(at_end, F.col(c))).alias(f"end_{c}") for c in cols])
    areas = auc_trapezoid(df, keys, time, cols, tmax=t_end, cap=cap)
    out = staged(ends.join(areas, keys), "endpoints")  # ranked four times
    cap = settle(out, groups, cap)
    for c in cols:
        for kind in ("end", "auc"):
            name = f"{kind}_{c}"
            out = with_ranks(out, groups, name, f"{name}_rank", desc=True, cap=cap)
            out = out.withColumn(f"{name}_rank", F.when(F.col(name).isNotNull(), F.col(f"{name}_rank_min"))).drop(
                *[f"{name}_rank_{k}" for k in ("min", "max", "avg", "dense")]
            )
    return out


def spearman(
    df: DataFrame, by: list[str], x: str, y: str, zero_var: float | None = float("nan"), cap: int | None = None
) -> DataFrame:
    """Pearson correlation of average ranks. ``zero_var`` is the value when one side is constant."""
    rows = both_finite(df.select(*by, x, y), x, y)
    cap = settle(rows, by, cap)
    ranked = with_ranks(with_ranks(rows, by, x, "__rx", cap=cap), by, y, "__ry", cap=cap)
    a, b = F.col("__rx_avg"), F.col("__ry_avg")
    flat = (F.var_pop(a) == 0) | (F.var_pop(b) == 0)
    rho = F.when(flat, F.lit(zero_var).cast("double")).otherwise(
        F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))
    )
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rho.alias("spearman"))


def tau_from_counts(variant: str = "tau_b") -> Column:
    """Kendall's tau from pair counts.

    ``custom`` adds pairs tied in both coordinates to both tie counts of the denominator and is 0
    where the denominator is; ``tau_b`` is the standard definition and NaN there.
    """
    c, d = F.col("concordant").cast("double"), F.col("discordant").cast("double")
    if variant == "custom":
        scale = F.sqrt((c + d + F.col("ties_x")) * (c + d + F.col("ties_y")))
        return F.when(scale == 0, F.lit(0.0)).otherwise((c - d) / scale)
    n0 = F.col("n_pairs").cast("double")
    scale = F.sqrt((n0 - F.col("ties_x")) * (n0 - F.col("ties_y")))
    return F.when(scale == 0, F.lit(float("nan"))).otherwise((c - d) / scale)


def kendall_tau(df: DataFrame, by: list[str], x: str, y: str, variant: str = "tau_b") -> DataFrame:
    pairs = concordance(both_finite(df.select(*by, x, y), x, y), by, x, y)
    return pairs.withColumn("kendall_tau", tau_from_counts(variant))


def pairwise_accuracy(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Share of untied pairs ordered alike, with counts and the fair-coin tail probability."""
    pairs = concordance(both_finite(df.select(*by, x, y), x, y), by, x, y)
    m = F.col("concordant") + F.col("discordant")
    return pairs.select(
        *by, "n_rows", m.alias("untied_pairs"), F.col("concordant").alias("correct_pairs"),
        F.when(m > 0, F.col("concordant").cast("double") / m.cast("double")).alias("pair_accuracy"),
        fair_coin_tail(F.col("concordant").cast("double"), m.cast("double")).alias("binomial_tail"),
    )


def interval_coverage(df: DataFrame, by: list[str], obs: str, mean: str, sd: str, k: float = 1.96) -> DataFrame:
    inside = F.abs(F.col(obs) - F.col(mean)) <= k * F.col(sd)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"))


def mean_by_key_baseline(train: DataFrame, target: DataFrame, key: list[str], value: str, name: str = "pred") -> DataFrame:
    """Predict each target row by its key's training mean, by the overall mean for unseen keys."""
    by_key = train.groupBy(*key).agg(F.avg(value).alias("__mean"))
    overall = train.agg(F.avg(value).alias("m")).scalar()
    joined = join_on(target, by_key, key, "left")
    return joined.withColumn("__all", overall).withColumn(name, F.coalesce("__mean", "__all")).drop("__mean", "__all")


def anova_levene(df: DataFrame, by: list[str], group: str, mu: str, sigma: str, cap: int | None = None) -> DataFrame:
    """One-way F and median-centred Levene W with p-values, and the method they choose.

    ``method1`` is chosen when the coefficients of variation spread by more than a tenth of their
    mean, or when either test has p < 0.05.
    """
    rows = df.filter(finite(mu))
    med = percentiles(rows, [*by, group], mu, {"__med": 0.5}, cap).select(*by, group, "__med")
    z = join_on(rows, med, [*by, group]).select(
        *by, group, F.col(mu).alias("__y"), F.col(sigma).alias("__s"), F.abs(F.col(mu) - F.col("__med")).alias("__z")
    )
    per = z.groupBy(*by, group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("__y").alias("m"), F.var_pop("__y").alias("v"),
        F.avg("__z").alias("zm"), F.var_pop("__z").alias("zv"), F.avg("__s").alias("s"),
    ).withColumn("cv", F.col("s") / F.col("m"))

    grand = per.groupBy(*by).agg(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"__grand_{c}") for c in ("m", "zm")])
    per = join_on(per, grand, by)

    def f_ratio(mean: str, var: str) -> Column:
        n, k = F.sum("n"), F.count(F.lit(1))
        off = F.col(mean) - F.col(f"__grand_{mean}")
        between, within = F.sum(F.col("n") * off * off), F.sum(F.col("n") * F.col(var))
        return F.try_divide(between / (k - 1), within / (n - k))

    out = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), f_ratio("m", "v").alias("anova_f"),
        f_ratio("zm", "zv").alias("levene_w"),
        ((F.max("cv") - F.min("cv")) > 0.1 * F.avg("cv")).alias("__cv_wide"),
    )
    d1, d2 = (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")
    out = out.withColumns({"anova_p": f_tail("anova_f", d1, d2), "levene_p": f_tail("levene_w", d1, d2)})
    unequal = F.col("__cv_wide") | (F.col("anova_p") < 0.05) | (F.col("levene_p") < 0.05)
    return out.withColumn("method", F.when(unequal, "method1").otherwise("method2")).drop("__cv_wide")


def ks_statistic(df: DataFrame, by: list[str], a: str, b: str, cap: int | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between the distributions of ``a`` and ``b``.

    Equal values are merged into counts first; the largest gap between the running shares is the distance.
    """
    side = lambda c, x, y: df.filter(finite(c)).select(*by, F.col(c).cast("double").alias("__v"), F.lit(x).alias("__a"), F.lit(y).alias("__b"))
    merged = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*by, "__v").agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    o = ordered(merged, by, ["__v"], cap).running(__ca=("sum", F.col("__a")), __cb=("sum", F.col("__b")))
    o = o.total(n_a=("sum", F.col("__a")), n_b=("sum", F.col("__b")))
    gap = F.abs(F.try_divide(F.col("__ca"), F.col("n_a")) - F.try_divide(F.col("__cb"), F.col("n_b")))
    return o.done().groupBy(*by).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max(gap).alias("ks"))
