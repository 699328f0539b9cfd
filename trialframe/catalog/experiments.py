"""Run analytics and ordered-series queries; events play run logs, a user is a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as N
from ..operators import series as S
from ..plans.ordered import NO_SPLIT
from .base import DAY_CURVE, R, day_curve, grid, gridded, micros, query, table

ORDER = ["ts", "event_id"]
# the hour of day is the iteration: it restarts every day, and a null one is skipped
LOG = """lg AS (SELECT user_id, event_id, ts, value, event_type, CASE WHEN event_type <> 'view' THEN extract(hour FROM ts) END AS iteration FROM events)"""
SEG = LOG + """, s0 AS (SELECT *, lag(iteration) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pv FROM lg WHERE iteration IS NOT NULL),
  seg AS (SELECT *, sum(CASE WHEN iteration <= pv THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM s0)"""


def _log(spark, sf):
    ev = table(spark, sf, "events")
    hour = F.hour(F.col("ts").cast("timestamp")).cast("long")
    return ev.select("user_id", "event_id", "ts", "value", "event_type", F.when(F.col("event_type") != "view", hour).alias("iteration"))


@query("run_segments", f"WITH {SEG} SELECT user_id, event_id, iteration, segment FROM seg")
def run_segments(spark, sf):
    return S.segment_runs(_log(spark, sf), ["user_id"], ORDER, "iteration").select("user_id", "event_id", "iteration", "segment")


@query(
    "last_complete_runs",
    f"""WITH {SEG}, e AS (SELECT user_id, segment, max(iteration) AS li, arg_max(value, iteration) AS final FROM seg GROUP BY ALL)
    SELECT user_id, NULL::BIGINT AS seed, segment, final, 'complete_segments' AS source FROM e WHERE li = 23 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY segment DESC) <= 3""",
)
def last_complete_runs(spark, sf):
    return S.last_complete_runs(_log(spark, sf), ["user_id"], ORDER, "iteration", "value", final=23, n=3)


@query(
    "last_complete_runs_seeded",
    """WITH lg AS (SELECT event_type AS grp, user_id % 10 AS seed, event_id, ts, value, extract(hour FROM ts) AS it FROM events WHERE NOT (event_type IN ('click', 'view') AND user_id % 10 = 3)),
    fl AS (SELECT grp FROM lg GROUP BY grp HAVING count(DISTINCT seed) = 10),
    q0 AS (SELECT *, lag(it) OVER (PARTITION BY grp ORDER BY ts, event_id) AS pv FROM lg), q1 AS (SELECT *, sum((it <= pv)::INT) OVER (PARTITION BY grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sg FROM q0),
    qe AS (SELECT grp, coalesce(sg, 0)::BIGINT AS segment, max(it) AS li, arg_max(value, it) AS final FROM q1 GROUP BY ALL),
    s0 AS (SELECT *, lag(it) OVER (PARTITION BY grp, seed ORDER BY ts, event_id) AS pv FROM lg), s1 AS (SELECT *, sum((it <= pv)::INT) OVER (PARTITION BY grp, seed ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sg FROM s0),
    e AS (SELECT grp, seed, coalesce(sg, 0)::BIGINT AS segment, max(it) AS li, arg_max(value, it) AS final FROM s1 GROUP BY ALL)
    SELECT * FROM (SELECT grp, seed, segment, final, 'seeded' AS source FROM e WHERE grp IN (SELECT grp FROM fl) QUALIFY row_number() OVER (PARTITION BY grp, seed ORDER BY li = 23 DESC, segment DESC) = 1)
    UNION ALL SELECT * FROM (SELECT grp, NULL, segment, final, 'complete_segments' FROM qe WHERE li = 23 AND grp NOT IN (SELECT grp FROM fl) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY segment DESC) <= 10)""",
)
def last_complete_runs_seeded(spark, sf):
    """Two of the groups lack a seed, so the last complete runs of their log count."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("grp"), (F.col("user_id") % 10).alias("seed"), "event_id", "ts", "value", F.hour(F.col("ts").cast("timestamp")).alias("it"))
    ev = ev.filter(~(F.col("grp").isin("click", "view") & (F.col("seed") == 3)))
    return S.last_complete_runs(ev, ["grp"], ORDER, "it", "value", 23, 10, seed="seed", seeds=list(range(10)))


@query(
    "repaired_log_rows",
    """WITH w AS (SELECT event_id, CASE WHEN user_id % 4 > 0 THEN extract(hour FROM ts)::DOUBLE END AS it, CASE WHEN user_id % 4 > 0 THEN value ELSE (user_id % 40)::DOUBLE END AS best, CASE WHEN event_type <> 'view' THEN value / 2 END AS weight FROM events)
    SELECT event_id, CASE WHEN moved THEN best ELSE it END AS it, CASE WHEN moved THEN weight ELSE best END AS best, CASE WHEN moved THEN 7.0::DOUBLE ELSE 1.0::DOUBLE END AS seed
    FROM (SELECT *, coalesce(it IS NULL AND best BETWEEN 1 AND 30 AND weight IS NOT NULL, false) AS moved FROM w) WHERE it IS NOT NULL OR moved""",
)
def repaired_log_rows(spark, sf):
    ev = table(spark, sf, "events")
    ok = F.col("user_id") % 4 > 0
    rows = ev.select(
        "event_id", F.when(ok, F.hour(F.col("ts").cast("timestamp")).cast("double")).alias("it"), F.when(ok, F.col("value")).otherwise((F.col("user_id") % 40).cast("double")).alias("best"),
        F.when(F.col("event_type") != "view", F.col("value") / 2).alias("weight"), F.lit(1.0).alias("seed"), F.lit(7.0).alias("spare"),
    )
    return S.repair_shift(rows, "it", "best", "weight", "seed", "spare").select("event_id", "it", "best", "seed")


INC = """inc AS (SELECT user_id, event_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events)"""


@query("incumbents", f"WITH {INC} SELECT user_id, event_id, best FROM inc")
def incumbents(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return S.incumbent(ev, ["user_id"], ORDER, "value").select("user_id", "event_id", "best")


IMP = INC + """, im AS (SELECT *, greatest(best - coalesce(lag(best) OVER (PARTITION BY user_id ORDER BY ts, event_id), 10.0::DOUBLE), 0) AS improvement FROM inc)"""


@query(
    "improvement_steps",
    f"WITH {IMP} SELECT user_id, event_id, {R('improvement', 4)} AS improvement, {R('sum(improvement) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)', 4)} AS cumulative FROM im",
)
def improvement_steps(spark, sf):
    inc = S.incumbent(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ORDER, "value")
    out = S.improvements(inc, ["user_id"], ORDER, "best", F.lit(10.0))
    return gridded(out.select("user_id", "event_id", "improvement", "cumulative"), improvement=4, cumulative=4)


@query("improvement_counts", f"WITH {IMP} SELECT user_id, count(*) FILTER (WHERE improvement > 0) AS improvements, {R('sum(improvement)', 4)} AS total FROM im GROUP BY user_id")
def improvement_counts(spark, sf):
    inc = S.incumbent(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ORDER, "value")
    return gridded(N_counts(S.improvements(inc, ["user_id"], ORDER, "best", F.lit(10.0))), total=4)


def N_counts(steps):
    return S.improvement_counts(steps, ["user_id"])


@query(
    "padded_gain_curves",
    f"""WITH {INC}, r AS (SELECT user_id, best, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM inc),
    g AS (SELECT user_id, n, unnest(range(1, 81)) AS position FROM (SELECT DISTINCT user_id, n FROM r))
    SELECT g.user_id, position, {R('greatest(best - 10, 0)', 4)} AS gain FROM g JOIN r ON r.user_id = g.user_id AND r.i = least(position, g.n)""",
)
def padded_gain_curves(spark, sf):
    inc = S.incumbent(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ORDER, "value")
    return gridded(S.pad_curve(inc, ["user_id"], ORDER, "best", F.lit(10.0), 80), gain=4)


BAND = f"{DAY_CURVE}, bd AS (SELECT user_id % 3 AS grp, time_h, q_obs FROM curve)"


@query(
    "confidence_bands",
    f"""WITH {BAND}, a AS (SELECT grp, time_h, count(q_obs) AS n, avg(q_obs) AS mean, stddev_samp(q_obs) AS sd FROM bd GROUP BY ALL),
    h AS (SELECT *, CASE WHEN n = 10 THEN 2.262::DOUBLE WHEN n >= 30 THEN 1.96::DOUBLE ELSE 2.2::DOUBLE END * sd / sqrt(n) AS half FROM a)
    SELECT grp, time_h, n, {R('mean', 4)} AS mean, {R('sd', 4)} AS sd, {R('half', 4)} AS half, {R('mean - half', 4)} AS low, {R('mean + half', 4)} AS high FROM h""",
)
def confidence_bands(spark, sf):
    c = day_curve(spark, sf).withColumn("grp", F.col("user_id") % 3)
    return gridded(S.bands(c, ["grp"], "time_h", "q_obs"), mean=4, sd=4, half=4, low=4, high=4)


@query(
    "cumulative_bands",
    f"""WITH {BAND}, a AS (SELECT grp, time_h, avg(q_obs) AS mean, stddev_samp(q_obs) AS sd FROM bd GROUP BY ALL)
    SELECT grp, time_h, {R('sum(mean) OVER w', 3)} AS cum_mean, {R('sqrt(sum(sd*sd) OVER w)', 3)} AS cum_sd FROM a WINDOW w AS (PARTITION BY grp ORDER BY time_h ROWS UNBOUNDED PRECEDING)""",
)
def cumulative_bands(spark, sf):
    c = day_curve(spark, sf).withColumn("grp", F.col("user_id") % 3)
    out = S.cumulative_bands(S.bands(c, ["grp"], "time_h", "q_obs", "sd"), ["grp"], "time_h", NO_SPLIT)
    return gridded(out.select("grp", "time_h", "cum_mean", "cum_sd"), cum_mean=3, cum_sd=3)


ACC = f"{DAY_CURVE}, ac AS (SELECT user_id, time_h, q_obs/1000 AS a, q_pred/1000 AS b, row_number() OVER (PARTITION BY user_id ORDER BY time_h) AS t FROM curve), ns AS (SELECT *, CASE WHEN a + b = 0 THEN 0.5 ELSE a / (a + b + 1e-9) END AS s FROM ac)"


@query(
    "adaptive_weights",
    f"""WITH {ACC}, w AS (SELECT x.user_id, x.time_h, any_value(pow(0.3::DOUBLE, x.t)) * 0.5 + sum(pow(0.3::DOUBLE, x.t - y.t) * 0.7::DOUBLE * y.s) AS w FROM ns x JOIN ns y ON x.user_id = y.user_id AND y.t <= x.t GROUP BY 1, 2)
    SELECT user_id, time_h, {R('w')} AS weight_first, {R('1 - w')} AS weight_second, greatest(1, floor(w * 6 + 1e-12))::INT AS n_first, (6 - greatest(1, floor(w * 6 + 1e-12)))::INT AS n_second FROM w""",
)
def adaptive_weights(spark, sf):
    c = day_curve(spark, sf).select("user_id", "time_h", (F.col("q_obs") / 1000).alias("a"), (F.col("q_pred") / 1000).alias("b"))
    out = S.adaptive_weights(c, ["user_id"], ["time_h"], "a", "b", k=6, alpha=0.3, cap=NO_SPLIT)  # a row per user and day
    return gridded(out, weight_first=6, weight_second=6).drop("a", "b")


@query(
    "batch_accuracies",
    f"""WITH {DAY_CURVE}, tops AS (SELECT time_h, max(q_obs) AS top FROM curve GROUP BY 1), rb AS (SELECT time_h, max(top) OVER (ORDER BY time_h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM tops)
    SELECT time_h, count(*) AS n, {R('avg((q_obs >= coalesce(best, -1e300))::INT)')} AS accuracy FROM curve JOIN rb USING (time_h) GROUP BY time_h""",
)
def batch_accuracies(spark, sf):
    return gridded(S.batch_accuracy(day_curve(spark, sf), [], "time_h", "q_obs", best_at="pre"), accuracy=6)


GRID = "g AS (SELECT l_linenumber::DOUBLE AS c1, l_quantity AS c2, floor(avg(l_extendedprice) * 100 + 0.5003) / 100 AS q FROM lineitem GROUP BY ALL)"


def _price_grid(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_linenumber").cast("double").alias("c1"), F.col("l_quantity").alias("c2")).agg(grid(F.avg("l_extendedprice"), 2).alias("q"))


@query(
    "grid_gradients",
    f"""WITH {GRID}, n AS (SELECT *, lag(c1) OVER a AS p1, lag(q) OVER a AS pq1, lead(c1) OVER a AS n1, lead(q) OVER a AS nq1, lag(c2) OVER b AS p2, lag(q) OVER b AS pq2, lead(c2) OVER b AS n2, lead(q) OVER b AS nq2 FROM g
      WINDOW a AS (PARTITION BY c2 ORDER BY c1), b AS (PARTITION BY c1 ORDER BY c2))
    SELECT c1, c2, {R('CASE WHEN p1 IS NULL THEN (nq1-q)/(n1-c1) WHEN n1 IS NULL THEN (q-pq1)/(c1-p1) ELSE ((c1-p1)*(c1-p1)*nq1 + ((n1-c1)*(n1-c1)-(c1-p1)*(c1-p1))*q - (n1-c1)*(n1-c1)*pq1)/((c1-p1)*(n1-c1)*(n1-p1)) END', 3)} AS d_c1,
    {R('CASE WHEN p2 IS NULL THEN (nq2-q)/(n2-c2) WHEN n2 IS NULL THEN (q-pq2)/(c2-p2) ELSE ((c2-p2)*(c2-p2)*nq2 + ((n2-c2)*(n2-c2)-(c2-p2)*(c2-p2))*q - (n2-c2)*(n2-c2)*pq2)/((c2-p2)*(n2-c2)*(n2-p2)) END', 3)} AS d_c2 FROM n""",
)
def grid_gradients(spark, sf):
    return gridded(S.grid_gradient(_price_grid(spark, sf), [], ["c1", "c2"], "q", NO_SPLIT), d_c1=3, d_c2=3).drop("q")


@query("price_gaps", f"SELECT p_partkey, {R('p_retailprice - lead(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)', 4)} AS gap FROM part")
def price_gaps(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return gridded(S.gap_to_next(part, ["p_brand"], "p_retailprice", "p_partkey"), gap=4).select("p_partkey", "gap")


@query(
    "convergence_generations",
    f"""WITH {INC}, r AS (SELECT user_id, best, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gen FROM inc), f AS (SELECT user_id, arg_max(best, gen) AS final, max(gen) AS generations FROM r GROUP BY 1)
    SELECT user_id, final, generations, min(gen) FILTER (WHERE best >= 0.99 * final) AS reached_at FROM r JOIN f USING (user_id) GROUP BY ALL""",
)
def convergence_generations(spark, sf):
    from ..plans.ordered import ordered

    ev = table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    o = ordered(ev, ["user_id"], ORDER).running(best=("max", F.col("value"))).index("gen").done()
    return S.convergence_point(o, ["user_id"], "gen", "best", 0.99)


POE = "pe AS (SELECT user_id, ts, event_id, value / (value + 40) AS poe, value AS ei FROM events)"


@query(
    "stop_positions",
    f"""WITH {POE}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM pe)
    SELECT user_id, count(*) AS planned, coalesce(min(i) FILTER (WHERE poe < 0.05) - 1, count(*)) AS position, count(*) FILTER (WHERE poe < 0.05) > 0 AS stopped FROM i GROUP BY user_id""",
)
def stop_positions(spark, sf):
    return S.stop_position(_poe(spark, sf), ["user_id"], ORDER, "poe", 0.05)


def _poe(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("user_id", "ts", "event_id", (v / (v + 40)).alias("poe"), v.alias("ei"))


@query(
    "stop_positions_with_falling_ei",
    f"""WITH {POE}, i AS (SELECT *, row_number() OVER w AS i, ei - lag(ei) OVER w AS dei FROM pe WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, coalesce(poe < 0.2 AND dei < 0, false) AS st FROM i)
    SELECT user_id, count(*) AS planned, coalesce(min(i) FILTER (WHERE st) - 1, count(*)) AS position, count(*) FILTER (WHERE st) > 0 AS stopped FROM s GROUP BY user_id""",
)
def stop_positions_with_falling_ei(spark, sf):
    return S.stop_position(_poe(spark, sf), ["user_id"], ORDER, "poe", 0.2, ei="ei")


@query(
    "interpolated_curves",
    f"""WITH {DAY_CURVE}, qs AS (SELECT user_id, event_id, (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS time_h FROM events),
    lo AS (SELECT q.event_id, max(c.time_h) AS t0 FROM qs q JOIN curve c ON c.user_id = q.user_id AND c.time_h <= q.time_h GROUP BY 1), hi AS (SELECT q.event_id, min(c.time_h) AS t1 FROM qs q JOIN curve c ON c.user_id = q.user_id AND c.time_h >= q.time_h GROUP BY 1)
    SELECT q.user_id, q.event_id, {R('q.time_h', 5)} AS time_h, {R('CASE WHEN t0 IS NULL THEN b.q_obs WHEN t1 IS NULL OR t0 = t1 THEN a.q_obs ELSE a.q_obs + (b.q_obs - a.q_obs) * (q.time_h - t0) / (t1 - t0) END', 3)} AS q_obs
    FROM qs q LEFT JOIN lo USING (event_id) LEFT JOIN hi USING (event_id) LEFT JOIN curve a ON a.user_id = q.user_id AND a.time_h = t0 LEFT JOIN curve b ON b.user_id = q.user_id AND b.time_h = t1""",
)
def interpolated_curves(spark, sf):
    at = table(spark, sf, "events").select("user_id", "event_id", ((micros("ts") - 1704067200000000) / 86400000000.0).alias("time_h"))
    out = S.interp_at(day_curve(spark, sf), at, ["user_id"], "time_h", "q_obs", "event_id")
    return gridded(out, time_h=5, q_obs=3)


@query(
    "digitised_curves",
    """WITH px AS (SELECT l_suppkey, (l_quantity)::INT AS x, floor(l_extendedprice / 100) AS y FROM lineitem), m AS (SELECT l_suppkey, x, count(*) AS n, quantile_cont(y, 0.5) AS m FROM px GROUP BY 1, 2),
    k AS (SELECT l_suppkey FROM m GROUP BY 1 HAVING sum(n) >= 50 AND count(*) >= 30)
    SELECT l_suppkey, x, trunc(m)::INT AS y, floor((10.0::DOUBLE + (trunc(m) - 0.0) / 1000.0::DOUBLE * 50.0) * 10000 + 0.5003) / 10000 AS value FROM m JOIN k USING (l_suppkey)""",
)
def digitised_curves(spark, sf):
    px = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("int").alias("x"), F.floor(F.col("l_extendedprice") / 100).cast("double").alias("y"))
    out = S.curve_from_points(px, ["l_suppkey"], "x", "y")
    return out.withColumn("value", grid(S.affine("y", 0.0, 1000.0, 10.0, 60.0), 4))


WIDE = """wd AS (SELECT l_suppkey AS run_no, sum(l_quantity) FILTER (WHERE l_linenumber = 1) AS R_t1, sum(l_quantity) FILTER (WHERE l_linenumber = 2) AS R_t2, sum(l_quantity) FILTER (WHERE l_linenumber = 3) AS R_t3 FROM lineitem GROUP BY 1)"""


def _wide(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    return li.groupBy(F.col("l_suppkey").alias("run_no")).agg(*[F.sum(F.when(n == i, F.col("l_quantity"))).alias(f"R_t{i}") for i in (1, 2, 3)])


@query(
    "wide_releases_to_curves",
    f"WITH {WIDE} SELECT run_no, 0.0::DOUBLE AS time_h, 0.0::DOUBLE AS q_obs FROM wd UNION ALL SELECT run_no, 0.5, R_t1 FROM wd UNION ALL SELECT run_no, 1, R_t2 FROM wd UNION ALL SELECT run_no, 2, R_t3 FROM wd",
)
def wide_releases_to_curves(spark, sf):
    return S.wide_to_curve(_wide(spark, sf), ["run_no"], {"R_t1": 0.5, "R_t2": 1.0, "R_t3": 2.0})


@query("curves_to_wide_releases", f"WITH {WIDE} SELECT run_no, R_t1, R_t2, R_t3 FROM wd")
def curves_to_wide_releases(spark, sf):
    times = {"R_t1": 0.5, "R_t2": 1.0, "R_t3": 2.0}
    return S.curve_to_wide(S.wide_to_curve(_wide(spark, sf), ["run_no"], times), ["run_no"], "time_h", "q_obs", times)


# ---- sweeps: parts are runs, size / price step are parameters -----------------------------------
SWEEP = """sw AS (SELECT p_partkey, (p_size % 5)::DOUBLE AS pop, (length(p_type))::DOUBLE AS depth, p_retailprice AS mse, p_size::DOUBLE AS sec FROM part),
  tall AS (SELECT p_partkey, param, level, metric, value FROM (SELECT p_partkey, 'pop' AS param, pop AS level, mse, sec FROM sw UNION ALL SELECT p_partkey, 'depth', depth, mse, sec FROM sw) UNPIVOT (value FOR metric IN (mse, sec))),
  lv AS (SELECT param, level, metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS cnt, median(value) AS med FROM tall GROUP BY ALL),
  lc AS (SELECT param, level, count(*) AS n, coalesce(param = 'pop' AND level = 3, false) AS preferred FROM tall WHERE metric = 'mse' GROUP BY ALL),
  bl AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY param ORDER BY preferred DESC, n DESC, level) = 1)"""


def _sweep(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", (F.col("p_size") % 5).cast("double").alias("pop"), F.length("p_type").cast("double").alias("depth"), F.col("p_retailprice").alias("mse"), F.col("p_size").cast("double").alias("sec"))


@query("baseline_levels", f"WITH {SWEEP} SELECT param, level, n, preferred FROM bl")
def baseline_levels(spark, sf):
    return N.baseline_level(_sweep(spark, sf), {"pop": 3.0, "depth": None})


@query(
    "level_summaries",
    f"""WITH {SWEEP}, b AS (SELECT l.param, l.metric, l.med AS base FROM lv l JOIN bl USING (param, level))
    SELECT param, level, metric, {R('mean', 4)} AS mean, {R('std', 4)} AS std, cnt AS "count", {R('med', 4)} AS median, {R('(med - base) / greatest(abs(base), 1e-12)')} AS rel_delta FROM lv JOIN b USING (param, metric)""",
)
def level_summaries(spark, sf):
    sw = _sweep(spark, sf)
    out = N.level_summary(sw, ["pop", "depth"], ["mse", "sec"], N.baseline_level(sw, {"pop": 3.0, "depth": None}))
    return gridded(out, mean=4, std=4, median=4, rel_delta=6)


@query(
    "best_levels",
    f"""WITH {SWEEP}, w AS (SELECT a.param, a.level, a.med AS m, b.med AS t, a.std AS s FROM lv a JOIN lv b ON a.param = b.param AND a.level = b.level WHERE a.metric = 'mse' AND b.metric = 'sec')
    SELECT param, level, {R('m', 4)} AS median FROM w QUALIFY row_number() OVER (PARTITION BY param ORDER BY m NULLS LAST, t NULLS LAST, s NULLS LAST, level) = 1""",
)
def best_levels(spark, sf):
    out = N.level_summary(_sweep(spark, sf), ["pop", "depth"], ["mse", "sec"])
    wide = out.groupBy("param", "level").agg(
        F.max(F.when(F.col("metric") == "mse", F.col("median"))).alias("median"), F.max(F.when(F.col("metric") == "sec", F.col("median"))).alias("time_median"),
        F.max(F.when(F.col("metric") == "mse", F.col("std"))).alias("std"),
    )
    best = N.best_level(wide, ["param"], ["median", "time_median", "std"], "level")
    return gridded(best.select("param", "level", "median"), median=4)


EMB = "em AS (SELECT label, vec_id // 60 AS iteration, vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def _batches(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("label", F.floor(F.col("vec_id") / 60).cast("long").alias("iteration"), "vec_id", F.col("embedding").cast("array<double>").alias("x"))


@query("incomplete_batches", f"""WITH {EMB}, c AS (SELECT label, iteration, count(*) AS points FROM em GROUP BY ALL), g AS (SELECT label, iteration FROM (SELECT DISTINCT label FROM em), (SELECT DISTINCT iteration FROM em))
    SELECT label, iteration, coalesce(points, 0) AS points FROM g LEFT JOIN c USING (label, iteration) WHERE coalesce(points, 0) <> 6""")
def incomplete_batches(spark, sf):
    b = _batches(spark, sf)
    b = b.withColumns({"label": F.col("label").cast("int"), "iteration": F.col("iteration").cast("long")})
    labels = b.agg(F.collect_set("label").alias("l")).scalar()
    iterations = F.sequence(F.lit(0).cast("long"), b.agg(F.max("iteration").alias("i")).scalar())
    combos = N.expected_batches(spark, {"label": labels, "iteration": iterations})
    return N.incomplete_batches(b, ["label", "iteration"], 6, combos)


DIV = EMB + """, bb AS (SELECT label, list(lo ORDER BY d) AS lo, list(hi ORDER BY d) AS hi FROM (SELECT label, d, min(x[d]) AS lo, max(x[d]) AS hi FROM em, range(1, 65) r(d) GROUP BY ALL) GROUP BY label),
  sc AS (SELECT em.label, iteration, vec_id, list_transform(range(1, 65), lambda d: (x[d] - lo[d]) / (hi[d] - lo[d])) AS z FROM em JOIN bb USING (label) QUALIFY count(*) OVER (PARTITION BY em.label, iteration) = 6),
  dv AS (SELECT a.label, a.iteration, avg(sqrt(list_sum(list_transform(range(1, 65), lambda d: (a.z[d]-b.z[d])*(a.z[d]-b.z[d]))))) AS diversity FROM sc a JOIN sc b ON a.label = b.label AND a.iteration = b.iteration AND a.vec_id < b.vec_id GROUP BY ALL)"""


def _diversity(spark, sf):
    b = _batches(spark, sf)
    axes = b.select("label", F.posexplode("x").alias("d", "v")).groupBy("label", "d").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    # one entry per axis: as many as the points have dimensions
    axis = F.array_sort(F.collect_list(F.struct("d", "lo", "hi")))
    bounds = axes.groupBy("label").agg(axis.alias("a")).select("label", F.transform("a", lambda s: s["lo"]).alias("lo"), F.transform("a", lambda s: s["hi"]).alias("hi"))
    return N.batch_diversity(b, ["label", "iteration"], "x", 6, bounds, ["label"])


@query("batch_diversities", f"WITH {DIV} SELECT label, iteration, {R('diversity')} AS diversity FROM dv")
def batch_diversities(spark, sf):
    return gridded(_diversity(spark, sf), diversity=6)


@query(
    "seed_means_by_flag",
    f"""WITH s AS (SELECT l_returnflag, l_linestatus, l_linenumber, avg(l_discount) AS m FROM lineitem GROUP BY ALL), g AS (SELECT l_returnflag, l_linestatus, avg(m) AS mean, stddev_samp(m) AS sd, count(*) AS n FROM s GROUP BY ALL)
    SELECT l_returnflag, {R("max(mean) FILTER (WHERE l_linestatus = 'F')", 7)} AS "F_mean", {R("max(sd) FILTER (WHERE l_linestatus = 'F')", 7)} AS "F_sd", {R("max(mean) FILTER (WHERE l_linestatus = 'O')", 7)} AS "O_mean", {R("max(sd) FILTER (WHERE l_linestatus = 'O')", 7)} AS "O_sd" FROM g GROUP BY 1""",
)
def seed_means_by_flag(spark, sf):
    stats = N.seed_then_group(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_linenumber", "l_discount")
    return gridded(N.pivot_methods(stats, ["l_returnflag"], "l_linestatus", ["F", "O"], ["mean", "sd"]), F_mean=7, F_sd=7, O_mean=7, O_sd=7)


@query(
    "winning_methods",
    f"""WITH s AS (SELECT p_brand, p_type, max(p_size)::DOUBLE AS mean FROM part GROUP BY ALL), b AS (SELECT p_brand, max(mean) AS best_mean FROM s GROUP BY 1)
    SELECT p_brand, best_mean, string_agg(p_type, ', ' ORDER BY p_type) AS winner, CASE WHEN bool_or(p_type = 'SMALL') THEN 'best' ELSE 'worse' END AS status FROM s JOIN b USING (p_brand) WHERE abs(mean - best_mean) <= 1e-8 + 1e-5 * abs(best_mean) GROUP BY ALL""",
)
def winning_methods(spark, sf):
    stats = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.max("p_size").cast("double").alias("mean"))
    return N.winners(stats, ["p_brand"], "p_type", "mean", own="SMALL")


@query(
    "pivoted_medians",
    f"""SELECT l_linenumber, l_linestatus, {R("median(l_extendedprice) FILTER (WHERE l_returnflag = 'A')", 3)} AS "m_A", {R("median(l_extendedprice) FILTER (WHERE l_returnflag = 'N')", 3)} AS "m_N", {R("median(l_extendedprice) FILTER (WHERE l_returnflag = 'R')", 3)} AS "m_R" FROM lineitem GROUP BY 1, 2""",
)
def pivoted_medians(spark, sf):
    out = N.pivot_median(table(spark, sf, "lineitem"), ["l_linenumber", "l_linestatus"], "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    return gridded(out, m_A=3, m_N=3, m_R=3)


@query(
    "best_configuration_history",
    """WITH m AS (SELECT l_linenumber, l_returnflag, median(l_extendedprice) AS md FROM lineitem GROUP BY ALL), b AS (SELECT l_linenumber, l_returnflag FROM m ORDER BY md DESC, l_linenumber, l_returnflag LIMIT 1)
    SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem JOIN b USING (l_linenumber, l_returnflag)""",
)
def best_configuration_history(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return N.best_config_history(li, ["l_linenumber", "l_returnflag"], "l_extendedprice")


@query(
    "model_summaries",
    f"""SELECT p_brand, count(*) AS runs, count(*) FILTER (WHERE p_size < 45) AS valid, {R('avg(p_retailprice) FILTER (WHERE p_size < 45)', 4)} AS mean, {R('stddev_samp(p_retailprice) FILTER (WHERE p_size < 45)', 4)} AS sd,
    min(p_retailprice) FILTER (WHERE p_size < 45) AS best, arg_min(p_partkey, (p_retailprice, p_partkey)) FILTER (WHERE p_size < 45) AS best_p_partkey, 'sweep' AS family FROM part GROUP BY p_brand
    UNION ALL SELECT p_type, count(*), count(*), {R('avg(p_retailprice)', 4)}, {R('stddev_samp(p_retailprice)', 4)}, min(p_retailprice), arg_min(p_partkey, (p_retailprice, p_partkey)), 'static' FROM part GROUP BY p_type""",
)
def model_summaries(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey", "p_retailprice", F.when(F.col("p_size") < 45, F.col("p_retailprice")).alias("m"))
    a = N.model_summary(part, ["p_brand"], "m", ["p_partkey"], "p_partkey")
    b = N.model_summary(part.drop("p_brand").withColumnRenamed("p_type", "p_brand"), ["p_brand"], "p_retailprice", ["p_partkey"], "p_partkey")
    return gridded(N.unify_groups({"sweep": a, "static": b}), mean=4, sd=4)


@query(
    "replicate_profiles",
    f"SELECT l_returnflag, l_linenumber, count(*) AS n, {R('avg(l_extendedprice)', 3)} AS mean, {R('sqrt(sum(l_quantity*l_quantity)) / count(*)', 6)} AS sd_mean FROM lineitem GROUP BY 1, 2",
)
def replicate_profiles(spark, sf):
    out = N.replicate_profile(table(spark, sf, "lineitem"), ["l_returnflag"], "l_linenumber", "l_extendedprice", "l_quantity")
    return gridded(out, mean=3, sd_mean=6)


@query(
    "described_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", {R(f'avg({c})', 4)} AS mean, {R(f'stddev_samp({c})', 4)} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, {R(f'quantile_cont({c}, 0.25)', 4)} AS p25, {R(f'quantile_cont({c}, 0.5)', 4)} AS p50, {R(f'quantile_cont({c}, 0.75)', 4)} AS p75 FROM lineitem"
        for c in ("l_quantity", "l_discount")
    ),
)
def described_columns(spark, sf):
    return gridded(N.describe_cols(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]), mean=4, std=4, p25=4, p50=4, p75=4)


@query(
    "axis_profiles_of_best_parts",
    f"""WITH b AS (SELECT p_brand, arg_max(p_size, (p_retailprice, p_partkey))::DOUBLE AS c1, max(p_retailprice) AS c2 FROM part GROUP BY 1), u AS (SELECT unnest(range(0, 11)) / 10.0::DOUBLE AS u)
    SELECT p_brand, 'c1' AS axis, {R('1 + u * 49', 4)} AS c1, c2, {R('(1 + u * 49) * c2 / 1000', 4)} AS score FROM b, u UNION ALL SELECT p_brand, 'c2', c1, {R('900 + u * 1200', 4)}, {R('c1 * (900 + u * 1200) / 1000', 4)} FROM b, u""",
)
def axis_profiles_of_best_parts(spark, sf):
    best = table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_size", F.struct("p_retailprice", "p_partkey")).cast("double").alias("c1"), F.max("p_retailprice").alias("c2"))
    out = N.axis_profile(best, {"c1": (1, 50), "c2": (900, 2100)}, 11).withColumn("score", F.col("c1") * F.col("c2") / 1000)
    return gridded(out, score=4, c1=4).withColumn("c2", F.when(F.col("axis") == "c2", grid("c2", 4)).otherwise(F.col("c2")))
