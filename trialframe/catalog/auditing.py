"""Audits of predicted curves; parts are grid points, line numbers are times, return flags are models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as A
from ..plans.ordered import NO_SPLIT
from .base import DAY_CURVE, R, day_curve, grid, gridded, query, table

CURVES = f"""cv AS (SELECT l_returnflag, l_partkey, l_linenumber::DOUBLE AS time_h, p_size::DOUBLE AS c1, p_retailprice AS c2, CASE WHEN avg(l_quantity) < 49 THEN {R('avg(l_extendedprice)', 2)} - 5000 END AS q
   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag, l_partkey, l_linenumber, p_size, p_retailprice),
  pv AS (SELECT *, lag(q) OVER (PARTITION BY l_returnflag, l_partkey ORDER BY time_h) AS pq FROM cv),
  fl AS (SELECT l_returnflag, l_partkey, count(*) AS points, count(*) FILTER (WHERE q < -1e-12) AS neg, count(*) FILTER (WHERE q IS NULL) AS fails, count(*) FILTER (WHERE q - pq < -1e-9) AS drops, max(q) FILTER (WHERE time_h = 7) AS end_value,
    bool_or(time_h = 7) AS has_end, max(c1) AS c1, max(c2) AS c2, bool_or(abs(c1-1) <= 1e-8+1e-5 OR abs(c1-50) <= 1e-8+5e-4 OR abs(c2-900) <= 1e-8+9e-3 OR abs(c2-2100) <= 1e-8+2.1e-2) AS edge FROM pv GROUP BY 1, 2),
  f2 AS (SELECT *, fails = 0 AND drops > 0 AS nonmono, coalesce(end_value < 0 OR end_value > 80000, false) AS extreme FROM fl)"""


def _flags(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    cv = li.join(part, li.l_partkey == part.p_partkey).groupBy(
        "l_returnflag", "l_partkey", F.col("l_linenumber").cast("double").alias("time_h"), F.col("p_size").cast("double").alias("c1"), F.col("p_retailprice").alias("c2")
    ).agg(F.when(F.avg("l_quantity") < 49, grid(F.avg("l_extendedprice"), 2) - 5000).alias("q"))
    return A.curve_flags(cv, ["l_returnflag"], "l_partkey", "time_h", "q", ["c1", "c2"], 7.0, 80000.0, {"c1": (1, 50), "c2": (900, 2100)}, NO_SPLIT)  # a row per line number


@query(
    "curve_plausibility_flags",
    f"WITH {CURVES} SELECT l_returnflag, l_partkey, points, neg AS negatives, fails AS failures, {R('end_value', 2)} AS end_value, has_end, edge AS is_boundary, nonmono AS non_monotonic, extreme FROM f2",
)
def curve_plausibility_flags(spark, sf):
    return gridded(_flags(spark, sf), end_value=2).drop("c1", "c2")


@query(
    "plausibility_audit",
    f"""WITH {CURVES} SELECT l_returnflag, count(*) AS curves, sum(points)::BIGINT AS points, {R('sum(neg)/sum(points)')} AS negative_rate, {R('avg(nonmono::INT)')} AS non_monotonic_rate, {R('count(*) FILTER (WHERE extreme) / count(*) FILTER (WHERE has_end)::DOUBLE')} AS extreme_rate,
    {R('sum(fails)/sum(points)')} AS failure_rate, arg_max(l_partkey, (end_value, -l_partkey)) FILTER (WHERE end_value IS NOT NULL) AS top_grid_id, arg_max(c1, (end_value, -l_partkey)) FILTER (WHERE end_value IS NOT NULL) AS top_c1,
    arg_max(c2, (end_value, -l_partkey)) FILTER (WHERE end_value IS NOT NULL) AS top_c2, {R('max(end_value)', 2)} AS top_end, coalesce(arg_max(edge, (end_value, -l_partkey)) FILTER (WHERE end_value IS NOT NULL), false) AS top_is_boundary FROM f2 GROUP BY 1""",
)
def plausibility_audit(spark, sf):
    out = A.plausibility_audit(_flags(spark, sf), ["l_returnflag"], "l_partkey", ["c1", "c2"])
    return gridded(out, negative_rate=6, non_monotonic_rate=6, extreme_rate=6, failure_rate=6, top_end=2)


@query(
    "optimum_safety",
    f"""WITH {CURVES}, b AS (SELECT l_returnflag, arg_max(l_partkey, (end_value, -l_partkey)) FILTER (WHERE end_value IS NOT NULL) AS pk, {R('avg((fails > 0)::INT)')} AS failed_curve_rate, {R('avg(extreme::INT)')} AS extreme_rate FROM f2 GROUP BY 1)
    SELECT l_returnflag, c1 AS best_c1, c2 AS best_c2, {R('end_value', 2)} AS best_end, edge AS best_is_boundary, fails > 0 AS best_has_failure, neg > 0 AS best_has_negative, nonmono AS best_non_monotonic, failed_curve_rate, b.extreme_rate
    FROM b JOIN f2 USING (l_returnflag) WHERE l_partkey = pk""",
)
def optimum_safety(spark, sf):
    out = A.optimum_safety(_flags(spark, sf), ["l_returnflag"], "l_partkey", ["c1", "c2"])
    return gridded(out, best_end=2, failed_curve_rate=6, extreme_rate=6)


@query(
    "rhs_rates",
    f"SELECT event_type, {R('avg((value - 5 < -1e-12)::INT)')} AS negative_rhs_rate, {R('avg((value < 100 AND value - 30 > 1e-12)::INT) FILTER (WHERE value < 100)')} AS positive_slope_rate FROM events GROUP BY 1",
)
def rhs_rates(spark, sf):
    ev = table(spark, sf, "events").select("event_type", (F.col("value") - 5).alias("rhs"), F.when(F.col("value") < 100, F.col("value") - 30).alias("slope"))
    return gridded(A.rhs_rates(ev, ["event_type"], "rhs", "slope"), negative_rhs_rate=6, positive_slope_rate=6)


SENS = f"""g AS (SELECT l_returnflag, l_linenumber::DOUBLE AS c1, l_quantity AS c2, CASE min(l_returnflag) WHEN 'N' THEN 5 WHEN 'A' THEN min(l_quantity) / 4 ELSE {R('avg(l_extendedprice)/1000', 5)} END AS q FROM lineitem GROUP BY ALL),
  n AS (SELECT *, lag(c1) OVER a AS p1, lag(q) OVER a AS pq1, lead(c1) OVER a AS n1, lead(q) OVER a AS nq1, lag(c2) OVER b AS p2, lag(q) OVER b AS pq2, lead(c2) OVER b AS n2, lead(q) OVER b AS nq2 FROM g
    WINDOW a AS (PARTITION BY l_returnflag, c2 ORDER BY c1), b AS (PARTITION BY l_returnflag, c1 ORDER BY c2)),
  d AS (SELECT l_returnflag, q, abs(CASE WHEN p1 IS NULL THEN (nq1-q)/(n1-c1) WHEN n1 IS NULL THEN (q-pq1)/(c1-p1) ELSE ((c1-p1)*(c1-p1)*nq1 + ((n1-c1)*(n1-c1)-(c1-p1)*(c1-p1))*q - (n1-c1)*(n1-c1)*pq1)/((c1-p1)*(n1-c1)*(n1-p1)) END) AS g1,
    abs(CASE WHEN p2 IS NULL THEN (nq2-q)/(n2-c2) WHEN n2 IS NULL THEN (q-pq2)/(c2-p2) ELSE ((c2-p2)*(c2-p2)*nq2 + ((n2-c2)*(n2-c2)-(c2-p2)*(c2-p2))*q - (n2-c2)*(n2-c2)*pq2)/((c2-p2)*(n2-c2)*(n2-p2)) END) AS g2 FROM n)"""


@query(
    "sensitivity_classes",
    f"""WITH {SENS}, o AS (SELECT l_returnflag, min(q) AS min, max(q) AS max, {R('max(q)-min(q)', 5)} AS "range", {R('stddev_pop(q)', 5)} AS sd, {R('avg(g1)', 4)} AS mean_abs_c1, {R('max(g1)', 4)} AS max_abs_c1, {R('avg(g2)', 4)} AS mean_abs_c2, {R('max(g2)', 4)} AS max_abs_c2,
    max(q)-min(q) > 1e-6 * greatest(1, median(abs(q))) AS nontrivial, ((avg(g1) > 1e-3*greatest(1, max(q)-min(q)))::INT + (avg(g2) > 1e-3*greatest(1, max(q)-min(q)))::INT)::INT AS active_axes FROM d GROUP BY 1)
    SELECT *, CASE WHEN active_axes >= 2 AND nontrivial THEN 'structurally_valid' WHEN active_axes = 1 THEN 'structurally_weak' ELSE 'degenerate_for_optimisation' END AS structural_class FROM o""",
)
def sensitivity_classes(spark, sf):
    """One flag's outcome depends on both axes, one on the second only, one on none."""
    g = table(spark, sf, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").cast("double").alias("c1"), F.col("l_quantity").alias("c2")).agg(grid(F.avg("l_extendedprice") / 1000, 5).alias("q"))
    g = g.withColumn("q", F.when(F.col("l_returnflag") == "N", 5.0).when(F.col("l_returnflag") == "A", F.col("c2") / 4).otherwise(F.col("q")))
    out = A.sensitivity_class(g, ["l_returnflag"], ["c1", "c2"], "q", NO_SPLIT)
    return gridded(out, range=5, sd=5, mean_abs_c1=4, max_abs_c1=4, mean_abs_c2=4, max_abs_c2=4)


@query(
    "residual_intervals",
    f"""WITH {DAY_CURVE}, r AS (SELECT time_h, q_obs - q_pred AS e FROM curve WHERE time_h < 25 AND time_h > 0), s AS (SELECT time_h, avg(e) AS m, CASE WHEN count(*) > 1 THEN stddev_samp(e) ELSE 0 END AS sd, quantile_cont(e, 0.025) AS lo, quantile_cont(e, 0.5) AS mid, quantile_cont(e, 0.975) AS hi FROM r GROUP BY 1),
    p AS (SELECT avg(e) AS pm, stddev_samp(e) AS psd, quantile_cont(e, 0.025) AS plo, quantile_cont(e, 0.5) AS pmid, quantile_cont(e, 0.975) AS phi FROM r),
    j AS (SELECT user_id, c.time_h, q_obs, q_pred, CASE WHEN c.time_h = 0 THEN 0 ELSE coalesce(m, pm) END AS rm, CASE WHEN c.time_h = 0 THEN 0 ELSE coalesce(sd, psd) END AS rsd, q_pred + CASE WHEN c.time_h = 0 THEN 0 ELSE coalesce(lo, plo) END AS low,
      q_pred + CASE WHEN c.time_h = 0 THEN 0 ELSE coalesce(mid, pmid) END AS mid, q_pred + CASE WHEN c.time_h = 0 THEN 0 ELSE coalesce(hi, phi) END AS high FROM curve c LEFT JOIN s USING (time_h), p)
    SELECT user_id, time_h, {R('rm', 4)} AS residual_mean, {R('rsd', 4)} AS residual_sd, {R('low', 4)} AS low, {R('mid', 4)} AS mid, {R('high', 4)} AS high, q_obs BETWEEN low - 1e-6 AND high + 1e-6 AS covered FROM j""",
)
def residual_intervals(spark, sf):
    c = day_curve(spark, sf)
    out = A.residual_intervals(c.filter("time_h < 25"), c, "time_h", "q_obs", "q_pred")
    # extremes of a group are interval ends; the tolerance keeps their coverage the same in any engine
    out = out.withColumn("covered", F.col("q_obs").between(F.col("low") - 1e-6, F.col("high") + 1e-6))
    return gridded(out, residual_mean=4, residual_sd=4, low=4, mid=4, high=4).drop("q_obs", "q_pred")
