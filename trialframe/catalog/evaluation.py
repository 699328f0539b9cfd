"""Regression, curve and rank evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ranking as K
from ..plans.ordered import NO_SPLIT, ordered
from ..plans.ranks import percentiles, with_ranks
from .base import DAY_CURVE, PART_SCORES, SALES_PREDS, R, day_curve, grid, gridded, part_scores, query, sales_preds, table

R2 = "CASE WHEN var_pop(obs) = 0 THEN NULL ELSE 1 - sum((obs-pred)*(obs-pred)) / (count(*) * var_pop(obs)) END"
ERR = f"""count(*) AS n, {R('sqrt(avg((obs-pred)*(obs-pred)))', 2)} AS rmse, {R('avg(abs(obs-pred))', 2)} AS mae,
  {R('avg((obs-pred)*(obs-pred))/1e6', 4)} AS mse, {R(R2, 6)} AS r2"""


def _errors(df):
    return df.withColumn("mse", F.col("mse") / 1e6).transform(lambda d: gridded(d, rmse=2, mae=2, mse=4, r2=6))


@query(
    "regression_metrics_by_brand",
    f"WITH {SALES_PREDS} SELECT p_brand, {ERR}, {R('avg((obs-pred)*(obs-pred))/(40000.0*40000.0)', 6)} AS mse_scaled FROM preds GROUP BY p_brand",
)
def regression_metrics_by_brand(spark, sf):
    out = M.regression_metrics(sales_preds(spark, sf), ["p_brand"], "obs", "pred", scale=40000.0)
    return gridded(_errors(out), mse_scaled=6)


@query(
    "extended_metrics_by_flag",
    f"""WITH {SALES_PREDS} SELECT l_returnflag, {ERR}, {R('1 - var_pop(obs-pred)/var_pop(obs)', 6)} AS explained_variance,
    {R('avg(abs((obs-pred)/nullif(obs,0)))*100', 5)} AS mape_pct FROM preds GROUP BY l_returnflag""",
)
def extended_metrics_by_flag(spark, sf):
    out = M.extended_metrics(sales_preds(spark, sf), ["l_returnflag"], "obs", "pred")
    return gridded(_errors(out), explained_variance=6, mape_pct=5)


@query(
    "curve_metrics_by_scope",
    f"""WITH {DAY_CURVE}, c AS (SELECT time_h, q_obs AS obs, q_pred AS pred FROM curve),
    tall AS (SELECT 'including_t0' AS scope, obs, pred FROM c UNION ALL SELECT 'excluding_t0', obs, pred FROM c WHERE abs(time_h) > 1e-8
    UNION ALL SELECT 'time_' || CAST(time_h AS VARCHAR), obs, pred FROM c)
    SELECT scope, count(*) AS n, {R('sqrt(avg((obs-pred)*(obs-pred)))', 5)} AS rmse, {R('avg(abs(obs-pred))', 5)} AS mae,
    {R('avg((obs-pred)*(obs-pred))', 3)} AS mse, {R(R2, 6)} AS r2 FROM tall GROUP BY scope""",
)
def curve_metrics_by_scope(spark, sf):
    out = M.curve_metrics(day_curve(spark, sf), [], "time_h", "q_obs", "q_pred")
    return gridded(out, rmse=5, mae=5, mse=3, r2=6)


AUC_SQL = """, p AS (SELECT *, lag(time_h) OVER w AS pt, lag(q_obs) OVER w AS po, lag(q_pred) OVER w AS pp FROM curve WHERE time_h <= 6
    WINDOW w AS (PARTITION BY user_id ORDER BY time_h)),
  auc AS (SELECT user_id, sum(CASE WHEN pt IS NULL THEN CASE WHEN time_h > 0 THEN time_h*q_obs/2 ELSE 0 END ELSE (time_h-pt)*(q_obs+po)/2 END) AS auc_obs,
    sum(CASE WHEN pt IS NULL THEN CASE WHEN time_h > 0 THEN time_h*q_pred/2 ELSE 0 END ELSE (time_h-pt)*(q_pred+pp)/2 END) AS auc_pred
    FROM p GROUP BY user_id)"""


@query("curve_auc", f"WITH {DAY_CURVE}{AUC_SQL} SELECT user_id, {R('auc_obs', 3)} AS auc_q_obs, {R('auc_pred', 3)} AS auc_q_pred FROM auc")
def curve_auc(spark, sf):
    out = M.auc_trapezoid(day_curve(spark, sf), ["user_id"], "time_h", ["q_obs", "q_pred"], tmax=6.0, cap=NO_SPLIT)  # a row per user and day
    return gridded(out, auc_q_obs=3, auc_q_pred=3)


@query(
    "endpoints_from_curves",
    f"""WITH {DAY_CURVE.replace('curve AS', 'fine AS', 1)}, curve AS (SELECT user_id, time_h, floor(q_obs) AS q_obs, q_pred FROM fine){AUC_SQL}, e AS (SELECT user_id, max(CASE WHEN time_h = 6 THEN q_obs END) AS eo, max(CASE WHEN time_h = 6 THEN q_pred END) AS ep
      FROM curve GROUP BY user_id),
    j AS (SELECT user_id % 3 AS dataset, user_id, eo AS end_q_obs, ep AS end_q_pred, {R('auc_obs', 3)} AS auc_q_obs, {R('auc_pred', 3)} AS auc_q_pred FROM e JOIN auc USING (user_id))
    SELECT *, CASE WHEN end_q_obs IS NOT NULL THEN rank() OVER (PARTITION BY dataset ORDER BY end_q_obs DESC NULLS LAST) END AS end_q_obs_rank,
    CASE WHEN end_q_pred IS NOT NULL THEN rank() OVER (PARTITION BY dataset ORDER BY end_q_pred DESC NULLS LAST) END AS end_q_pred_rank,
    rank() OVER (PARTITION BY dataset ORDER BY auc_q_obs DESC) AS auc_q_obs_rank, rank() OVER (PARTITION BY dataset ORDER BY auc_q_pred DESC) AS auc_q_pred_rank FROM j""",
)
def endpoints_from_curves(spark, sf):
    # whole values on whole days keep the areas exact, so equal ones tie in any engine
    curve = day_curve(spark, sf).withColumns({"dataset": F.col("user_id") % 3, "q_obs": F.floor("q_obs").cast("double")})
    out = M.endpoint_from_curve(curve, ["user_id"], ["dataset"], "time_h", ["q_obs", "q_pred"], 6.0)
    return gridded(out, auc_q_obs=3, auc_q_pred=3)


RANKS = """, rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY obs) + (count(*) OVER (PARTITION BY {by}, obs) - 1) / 2.0 AS rx,
   rank() OVER (PARTITION BY {by} ORDER BY pred) + (count(*) OVER (PARTITION BY {by}, pred) - 1) / 2.0 AS ry FROM {src})"""
RHO = "CASE WHEN var_pop(rx) = 0 OR var_pop(ry) = 0 THEN {zero} ELSE covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END"
PAIRS = """, pc AS (SELECT a.{by}, count(*) AS n_pairs, sum((sign(a.obs-b.obs)*sign(a.pred-b.pred) > 0)::BIGINT)::BIGINT AS c,
    sum((sign(a.obs-b.obs)*sign(a.pred-b.pred) < 0)::BIGINT)::BIGINT AS d, sum((a.obs = b.obs)::BIGINT)::BIGINT AS tx, sum((a.pred = b.pred)::BIGINT)::BIGINT AS ty
    FROM {src} a JOIN {src} b ON a.{by} = b.{by} AND a.{id} < b.{id} GROUP BY a.{by})"""


@query(
    "spearman_by_brand",
    f"WITH {PART_SCORES}{RANKS.format(by='p_brand', src='scores')} SELECT p_brand, count(*) AS n, {R(RHO.format(zero='NULL'))} AS spearman FROM rk GROUP BY p_brand",
)
def spearman_by_brand(spark, sf):
    return gridded(M.spearman(part_scores(spark, sf), ["p_brand"], "obs", "pred", zero_var=None), spearman=6)


@query(
    "kendall_tau_by_brand",
    f"""WITH {PART_SCORES}{PAIRS.format(by='p_brand', src='scores', id='l_partkey')}, nr AS (SELECT p_brand, count(*) AS n_rows FROM scores GROUP BY 1)
    SELECT p_brand, n_rows, n_pairs, c AS concordant, d AS discordant, {R('(c-d)/sqrt((c+d+tx)*(c+d+ty)::DOUBLE)')} AS tau_custom,
    {R('(c-d)/sqrt((n_pairs-tx)*(n_pairs-ty)::DOUBLE)')} AS tau_b FROM pc JOIN nr USING (p_brand)""",
)
def kendall_tau_by_brand(spark, sf):
    pairs = M.kendall_tau(part_scores(spark, sf), ["p_brand"], "obs", "pred", "custom")
    pairs = pairs.withColumnRenamed("kendall_tau", "tau_custom").withColumn("tau_b", M.tau_from_counts("tau_b"))
    return gridded(pairs, tau_custom=6, tau_b=6).drop("ties_x", "ties_y", "ties_both")


@query(
    "pairwise_accuracy_by_type",
    f"""WITH {PART_SCORES}{PAIRS.format(by='p_type', src='scores', id='l_partkey')}, nr AS (SELECT p_type, count(*) AS n_rows FROM scores GROUP BY 1)
    SELECT p_type, n_rows, c + d AS untied_pairs, c AS correct_pairs, {R('c/(c+d)::DOUBLE')} AS pair_accuracy FROM pc JOIN nr USING (p_type)""",
)
def pairwise_accuracy_by_type(spark, sf):
    out = M.pairwise_accuracy(part_scores(spark, sf), ["p_type"], "obs", "pred")
    return gridded(out, pair_accuracy=6).drop("binomial_tail")


@query(
    "pairwise_binomial_tail",
    f"""WITH {DAY_CURVE}, cv AS (SELECT time_h, user_id, q_obs AS obs, q_pred AS pred FROM curve){PAIRS.format(by='time_h', src='cv', id='user_id')},
    t AS (SELECT time_h, c, c + d AS m, unnest(range(c::BIGINT, (c + d + 1)::BIGINT)) AS k FROM pc)
    SELECT time_h, m AS untied_pairs, c AS correct_pairs, {R('least(1, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) - m * ln(2))))')} AS binomial_tail FROM t GROUP BY ALL""",
)
def pairwise_binomial_tail(spark, sf):
    out = M.pairwise_accuracy(day_curve(spark, sf), ["time_h"], "q_obs", "q_pred")
    return gridded(out.select("time_h", "untied_pairs", "correct_pairs", "binomial_tail"), binomial_tail=6)


@query(
    "interval_coverage_by_brand",
    f"""WITH {SALES_PREDS}, s AS (SELECT p_brand, avg(pred) AS m, stddev_samp(pred) AS sd FROM preds GROUP BY 1)
    SELECT p_brand, count(*) AS n, {R('avg((abs(obs - m) <= 1.96 * sd)::INT)')} AS coverage FROM preds JOIN s USING (p_brand) GROUP BY p_brand""",
)
def interval_coverage_by_brand(spark, sf):
    preds = sales_preds(spark, sf)
    stats = preds.groupBy("p_brand").agg(F.avg("pred").alias("m"), F.stddev_samp("pred").alias("sd"))
    return gridded(M.interval_coverage(preds.join(stats, "p_brand"), ["p_brand"], "obs", "m", "sd"), coverage=6)


@query(
    "mean_by_time_baseline",
    f"""WITH {DAY_CURVE}, m AS (SELECT time_h, avg(q_obs) AS m FROM curve WHERE time_h < 25 GROUP BY 1)
    SELECT user_id, time_h, q_obs, {R('coalesce(m, (SELECT avg(q_obs) FROM curve WHERE time_h < 25))', 5)} AS pred
    FROM curve LEFT JOIN m USING (time_h)""",
)
def mean_by_time_baseline(spark, sf):
    curve = day_curve(spark, sf)
    train = curve.filter(F.col("time_h") < 25)
    test = curve.select("user_id", "time_h", "q_obs")
    return gridded(M.mean_by_key_baseline(train, test, ["time_h"], "q_obs"), pred=5)


@query(
    "anova_levene_by_user_third",
    f"""WITH {DAY_CURVE}, g AS (SELECT user_id % 4 AS part, time_h AS grp, q_obs AS y, q_pred AS s FROM curve),
    md AS (SELECT part, grp, median(y) AS md FROM g GROUP BY 1, 2),
    z AS (SELECT part, grp, y, s, abs(y - md) AS z FROM g JOIN md USING (part, grp)),
    p AS (SELECT part, grp, count(*) AS n, avg(y) AS m, var_pop(y) AS v, avg(z) AS zm, var_pop(z) AS zv FROM z GROUP BY 1, 2)
    SELECT part, count(*) AS groups, sum(n)::BIGINT AS n,
    {R('((sum(n*m*m) - sum(n*m)*sum(n*m)/sum(n))/(count(*)-1)) / (sum(n*v)/(sum(n)-count(*)))', 5)} AS anova_f,
    {R('((sum(n*zm*zm) - sum(n*zm)*sum(n*zm)/sum(n))/(count(*)-1)) / (sum(n*zv)/(sum(n)-count(*)))', 5)} AS levene_w FROM p GROUP BY part""",
)
def anova_levene_by_user_third(spark, sf):
    curve = day_curve(spark, sf).withColumn("part", F.col("user_id") % 4)
    out = M.anova_levene(curve, ["part"], "time_h", "q_obs", "q_pred")
    return gridded(out, anova_f=5, levene_w=5).drop("anova_p", "levene_p", "method")


def sql_variance_tests(key: str, cells: str) -> str:
    """CTEs from ``cells`` (key, grp, y, s) to ``chosen`` (key, anova_p, levene_p, method); starts a recursive WITH.

    Tail probabilities by DuckDB's own log-gamma and 400 terms of the continued fraction, row by row.
    """
    moved = lambda num, src: (
        f"SELECT {key}, test, p, q, t, m, 1 / (1 + ({num}) * d) AS d, 1 + ({num}) / c AS c, h * (1 / (1 + ({num}) * d)) * (1 + ({num}) / c) AS h FROM {src}")
    odd = moved("m * (q - m) * t / ((p + 2*m - 1) * (p + 2*m))", "(SELECT * REPLACE (m + 1 AS m) FROM lentz WHERE m < 400)")
    even = moved("-(p + m) * (p + q + m) * t / ((p + 2*m) * (p + 2*m + 1))", f"({odd})")
    return f"""md AS (SELECT {key}, grp, median(y) AS md FROM {cells} GROUP BY 1, 2),
    zs AS (SELECT {key}, grp, y, s, abs(y - md) AS z FROM {cells} JOIN md USING ({key}, grp)),
    pg AS (SELECT {key}, grp, count(*)::DOUBLE AS n, avg(y) AS m, var_pop(y) AS v, avg(z) AS zm, var_pop(z) AS zv, avg(s) / avg(y) AS cv FROM zs GROUP BY 1, 2),
    st AS (SELECT {key}, count(*)::DOUBLE - 1 AS d1, sum(n) - count(*) AS d2, max(cv) - min(cv) > 0.1::DOUBLE * avg(cv) AS wide,
      ((sum(n*m*m) - sum(n*m)*sum(n*m)/sum(n))/nullif(count(*)-1, 0)) / nullif(sum(n*v)/nullif(sum(n)-count(*), 0), 0) AS f,
      ((sum(n*zm*zm) - sum(n*zm)*sum(n*zm)/sum(n))/nullif(count(*)-1, 0)) / nullif(sum(n*zv)/nullif(sum(n)-count(*), 0), 0) AS w FROM pg GROUP BY 1),
    fs AS (SELECT {key}, 'f' AS test, d2/2 AS a, d1/2 AS b, d2/(d2 + d1*greatest(f, 0)) AS x FROM st WHERE f IS NOT NULL UNION ALL SELECT {key}, 'w', d2/2, d1/2, d2/(d2 + d1*greatest(w, 0)) FROM st WHERE w IS NOT NULL),
    sides AS (SELECT *, x < (a + 1) / (a + b + 2) AS low FROM fs WHERE x > 0 AND x < 1), pq AS (SELECT *, CASE WHEN low THEN a ELSE b END AS p, CASE WHEN low THEN b ELSE a END AS q, CASE WHEN low THEN x ELSE 1 - x END AS t FROM sides),
    lentz AS (SELECT {key}, test, p, q, t, 0::DOUBLE AS m, 1 / (1 - (p + q) * t / (p + 1)) AS d, 1::DOUBLE AS c, 1 / (1 - (p + q) * t / (p + 1)) AS h FROM pq UNION ALL {even}),
    tails AS (SELECT pq.{key}, test, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * h / p AS tail, low FROM pq JOIN (SELECT {key}, test, h FROM lentz WHERE m = 400) USING ({key}, test)),
    ps AS (SELECT {key}, test, CASE WHEN low THEN tail ELSE 1 - tail END AS p FROM tails UNION ALL SELECT {key}, test, CASE WHEN x <= 0 THEN 0 ELSE 1 END FROM fs WHERE x <= 0 OR x >= 1),
    chosen AS (SELECT {key}, f.p AS anova_p, w.p AS levene_p, CASE WHEN coalesce(wide, false) OR coalesce(f.p < 0.05, false) OR coalesce(w.p < 0.05, false) THEN 'method1' ELSE 'method2' END AS method
      FROM st LEFT JOIN (SELECT {key}, p FROM ps WHERE test = 'f') f USING ({key}) LEFT JOIN (SELECT {key}, p FROM ps WHERE test = 'w') w USING ({key}))"""


@query(
    "anova_levene_method_choice",
    f"""WITH RECURSIVE {DAY_CURVE}, g AS (SELECT user_id % 4 AS part, time_h AS grp, q_obs AS y, q_pred AS s FROM curve), {sql_variance_tests('part', 'g')}
    SELECT part, {R('anova_p')} AS anova_p, {R('levene_p')} AS levene_p, method FROM chosen""",
)
def anova_levene_method_choice(spark, sf):
    curve = day_curve(spark, sf).withColumn("part", F.col("user_id") % 4)
    out = M.anova_levene(curve, ["part"], "time_h", "q_obs", "q_pred")
    return out.select("part", grid("anova_p").alias("anova_p"), grid("levene_p").alias("levene_p"), "method")


@query(
    "variance_tests_by_brand",
    f"""WITH RECURSIVE g AS (SELECT p_brand, l_returnflag AS grp, l_discount AS y, l_tax AS s FROM lineitem JOIN part ON l_partkey = p_partkey), {sql_variance_tests('p_brand', 'g')}
    SELECT p_brand, {R('anova_p', 5)} AS anova_p, {R('levene_p', 5)} AS levene_p, method FROM chosen""",
)
def variance_tests_by_brand(spark, sf):
    """Whether the discount depends on the return flag, brand by brand: p-values all over their range, many degrees of freedom."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_discount", "l_tax")
    rows = li.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return gridded(M.anova_levene(rows, ["p_brand"], "l_returnflag", "l_discount", "l_tax").select("p_brand", "anova_p", "levene_p", "method"), anova_p=5, levene_p=5)


@query(
    "rank_columns_by_brand",
    """SELECT p_brand, p_partkey, p_size, rank() OVER w AS size_min, rank() OVER w + count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS size_max,
    rank() OVER w + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS size_avg, dense_rank() OVER w AS size_dense,
    row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS size_first
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)""",
)
def rank_columns_by_brand(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    ranked = with_ranks(part, ["p_brand"], "p_size", "size", desc=True)
    return ordered(ranked, ["p_brand"], ["-p_size", "p_partkey"]).index("size_first").done()


@query(
    "global_rank_of_prices",
    """SELECT o_orderkey, rank() OVER w AS price_min, rank() OVER w + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::DOUBLE AS price_avg,
    dense_rank() OVER w AS price_dense FROM orders WINDOW w AS (ORDER BY o_totalprice)""",
)
def global_rank_of_prices(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return with_ranks(orders, [], "o_totalprice", "price").select("o_orderkey", "price_min", "price_avg", "price_dense")


@query(
    "global_running_totals",
    """SELECT event_id, count(*) OVER w AS seen, max(value) OVER w AS best, sum(user_id) OVER w::BIGINT AS users
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def global_running_totals(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "value", "user_id")
    o = ordered(ev, [], ["ts", "event_id"]).running(
        seen=("count", F.lit(1)), best=("max", F.col("value")), users=("sum", F.col("user_id"))
    )
    return o.done().select("event_id", "seen", "best", "users")


TOPS = """, tt AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY obs DESC, {id}) AS rt,
    row_number() OVER (PARTITION BY {by} ORDER BY pred DESC, {id}) AS rp, count(*) OVER (PARTITION BY {by}) AS n FROM {src})"""


@query(
    "topk_quality_by_brand",
    f"""WITH {PART_SCORES}{TOPS.format(by='p_brand', src='scores', id='l_partkey')}, ks AS (SELECT unnest(range(1, 7)) AS k)
    SELECT p_brand, k::INT AS k, n, {R('sum((rt<=k AND rp<=k)::INT)/k')} AS precision, {R('sum((rt<=k AND rp<=k)::INT)/k')} AS recall,
    max((rt=1 AND rp<=k)::INT)::INT AS hit, {R('k/n')} AS baseline FROM tt, ks WHERE k <= n GROUP BY p_brand, k, n""",
)
def topk_quality_by_brand(spark, sf):
    out = K.topk_quality(part_scores(spark, sf), ["p_brand"], "obs", "pred", "l_partkey", 6)
    return gridded(out, precision=6, recall=6, baseline=6)


GAINS = """, gn AS (SELECT *, greatest(1, ceil(0.25::DOUBLE * n))::BIGINT AS m FROM tt),
   gc AS (SELECT p_type, l_partkey, rp AS k, n, m, sum((rt <= m)::INT) OVER (PARTITION BY p_type ORDER BY rp ROWS UNBOUNDED PRECEDING) / m::DOUBLE AS recall FROM gn)"""


@query(
    "gains_curve_by_type",
    f"""WITH {PART_SCORES}{TOPS.format(by='p_type', src='scores', id='l_partkey')}{GAINS}
    SELECT p_type, l_partkey, k, n, m, {R('k/n::DOUBLE')} AS fraction, {R('recall')} AS recall FROM gc""",
)
def gains_curve_by_type(spark, sf):
    out = K.gains_curve(part_scores(spark, sf), ["p_type"], "obs", "pred", "l_partkey")
    return gridded(out, fraction=6, recall=6)


@query(
    "gains_points_by_type",
    f"""WITH {PART_SCORES}{TOPS.format(by='p_type', src='scores', id='l_partkey')}{GAINS}
    SELECT p_type, max(n) AS n, max(m) AS m, min(CASE WHEN recall >= 2.0::DOUBLE/3 THEN k END) AS k_at_1, min(CASE WHEN recall >= 1 THEN k END) AS k_at_2
    FROM gc GROUP BY p_type""",
)
def gains_points_by_type(spark, sf):
    return K.gains_points(K.gains_curve(part_scores(spark, sf), ["p_type"], "obs", "pred", "l_partkey"), ["p_type"])


@query(
    "top_hit_sets_by_brand",
    f"""WITH {PART_SCORES}{TOPS.format(by='p_brand', src='scores', id='l_partkey')},
    h AS (SELECT p_brand, max(CASE WHEN rt=1 THEN l_partkey END) AS t1, max(CASE WHEN rp=1 THEN l_partkey END) AS p1,
    max(CASE WHEN rt=2 THEN l_partkey END) AS t2, max(CASE WHEN rp=2 THEN l_partkey END) AS p2 FROM tt GROUP BY 1)
    SELECT p_brand, (t1=p1)::INT AS top1_hit, (t1 IN (p1,p2) OR t2 IN (p1,p2))::INT AS top2_hit, concat_ws(',', t1, t2) AS true_top2, concat_ws(',', p1, p2) AS pred_top2 FROM h""",
)
def top_hit_sets_by_brand(spark, sf):
    out = K.top_hit_sets(part_scores(spark, sf), ["p_brand"], "obs", "pred", "l_partkey")
    text = {c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",") for c in ("true_top2", "pred_top2")}
    return out.withColumns(text).drop("true_top1", "pred_top1")


def _rank_sql(by: str, src: str, ident: str, min_n: int) -> str:
    return f"""{RANKS.format(by=by, src=src)}{PAIRS.format(by=by, src=src, id=ident)}{TOPS.format(by=by, src=src, id=ident)},
    rho AS (SELECT {by}, count(*) AS n, {R(RHO.format(zero='0'))} AS spearman FROM rk GROUP BY {by} HAVING count(*) >= {min_n}),
    tk AS (SELECT {by}, {R('sum((rt<=least(2,n) AND rp<=least(2,n))::INT)/least(2,max(n))')} AS precision_at_k, max((rt=1 AND rp<=2)::INT)::INT AS hit_at_k FROM tt GROUP BY {by})
    SELECT {by}, n, spearman, {R('CASE WHEN (c+d+tx)*(c+d+ty) = 0 THEN 0 ELSE (c-d)/sqrt((c+d+tx)*(c+d+ty)::DOUBLE) END')} AS kendall_tau, c + d AS untied_pairs, c AS correct_pairs,
    {R('c/nullif(c+d,0)::DOUBLE')} AS pair_accuracy, precision_at_k, hit_at_k FROM rho JOIN pc USING ({by}) JOIN tk USING ({by})"""


@query(
    "rank_metrics_by_time",
    f"WITH {DAY_CURVE}, cv AS (SELECT user_id, time_h, q_obs AS obs, q_pred AS pred FROM curve){_rank_sql('time_h', 'cv', 'user_id', 3)}",
)
def rank_metrics_by_time(spark, sf):
    out = K.metrics_by_key(day_curve(spark, sf), "time_h", "q_obs", "q_pred", "user_id")
    return gridded(out, spearman=6, kendall_tau=6, pair_accuracy=6, precision_at_k=6).drop("binomial_tail")


@query(
    "region_out_metrics",
    f"""WITH {PART_SCORES}, b AS (SELECT min(p_size) AS l1, max(p_size) AS h1, min(p_retailprice) AS l2, max(p_retailprice) AS h2, min(sales) AS l3, max(sales) AS h3 FROM scores),
    rg AS (SELECT l_partkey, obs, pred, ((p_size-l1)/(h1-l1+1e-12) >= 0.5)::INT::VARCHAR || ((p_retailprice-l2)/(h2-l2+1e-12) >= 0.5)::INT::VARCHAR || ((sales-l3)/(h3-l3+1e-12) >= 0.5)::INT::VARCHAR AS cube
    FROM scores, b){_rank_sql('cube', 'rg', 'l_partkey', 4)}""",
)
def region_out_metrics(spark, sf):
    out = K.region_out(part_scores(spark, sf), ["p_size", "p_retailprice", "sales"], "obs", "pred", "l_partkey")
    return gridded(out, spearman=6, kendall_tau=6, pair_accuracy=6, precision_at_k=6).drop("binomial_tail")


def _consensus(spark, sf):
    parts = part_scores(spark, sf)
    bounds = parts.agg(
        F.struct(*[f(c).cast("double").alias(f"{s}_{c}") for c in ("p_size", "p_retailprice") for s, f in (("lo", F.min), ("hi", F.max))])
    ).scalar()
    scaled = parts.withColumn("b", bounds).select(
        "l_partkey", "obs", "pred",
        *[((F.col(c) - F.col(f"b.lo_{c}")) / (F.col(f"b.hi_{c}") - F.col(f"b.lo_{c}"))).alias(a) for a, c in (("c1", "p_size"), ("c2", "p_retailprice"))],
    )
    return K.consensus_rank(scaled, "l_partkey", "pred", "obs", ["c1", "c2"])


CONSENSUS = PART_SCORES + """, b AS (SELECT min(p_size)::DOUBLE AS l1, max(p_size)::DOUBLE AS h1, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM scores),
  s0 AS (SELECT l_partkey, obs, pred, (p_size-l1)/(h1-l1) AS c1, (p_retailprice-l2)/(h2-l2) AS c2, rank() OVER (ORDER BY pred DESC) AS rank_first,
    rank() OVER (ORDER BY obs DESC) AS rank_second, pred - lead(pred) OVER (ORDER BY pred DESC, l_partkey) AS gap_next FROM scores, b),
  s1 AS (SELECT *, 0.6::DOUBLE*rank_first + 0.4::DOUBLE*rank_second AS rank_raw, abs(rank_first-rank_second) AS rank_gap, (least(c1,1-c1)+least(c2,1-c2))/2 AS edge_score FROM s0),
  s2 AS (SELECT *, rank() OVER (ORDER BY rank_raw) AS rank_consensus, min(gap_next) OVER () AS g0, max(gap_next) OVER () AS g1, min(edge_score) OVER () AS e0, max(edge_score) OVER () AS e1,
    min(rank_gap) OVER () AS a0, max(rank_gap) OVER () AS a1 FROM s1),
  s3 AS (SELECT *, 0.5*coalesce((gap_next-g0)/(g1-g0),0) + 0.3*(1-(rank_gap-a0)/(a1-a0)::DOUBLE) + 0.2*(edge_score-e0)/(e1-e0) AS score_overall FROM s2)"""


@query(
    "consensus_ranking",
    f"""WITH {CONSENSUS} SELECT l_partkey, rank_first, rank_second, {R('rank_raw', 3)} AS rank_raw, rank_gap, rank_consensus, {R('gap_next', 2)} AS gap_next,
    {R('edge_score')} AS edge_score, {R('score_overall')} AS score_overall FROM s3""",
)
def consensus_ranking(spark, sf):
    out = gridded(_consensus(spark, sf), rank_raw=3, gap_next=2, edge_score=6, score_overall=6)
    return out.select("l_partkey", "rank_first", "rank_second", "rank_raw", "rank_gap", "rank_consensus", "gap_next", "edge_score", "score_overall")


@query(
    "diverse_subset_of_leaders",
    f"""WITH {CONSENSUS}, pool AS (SELECT *, row_number() OVER (ORDER BY rank_consensus, score_overall DESC, l_partkey) AS pos FROM s3 QUALIFY pos <= 4),
    tri AS (SELECT a.l_partkey AS k1, b.l_partkey AS k2, c.l_partkey AS k3,
      (sqrt((a.c1-b.c1)*(a.c1-b.c1)+(a.c2-b.c2)*(a.c2-b.c2)) + sqrt((a.c1-c.c1)*(a.c1-c.c1)+(a.c2-c.c2)*(a.c2-c.c2)) + sqrt((b.c1-c.c1)*(b.c1-c.c1)+(b.c2-c.c2)*(b.c2-c.c2)))/3
      + 0.1*(a.score_overall+b.score_overall+c.score_overall)/3 - 0.01*(a.rank_consensus+b.rank_consensus+c.rank_consensus)/3 AS objective, a.pos AS p1, b.pos AS p2, c.pos AS p3
      FROM pool a JOIN pool b ON a.pos < b.pos JOIN pool c ON b.pos < c.pos)
    SELECT concat_ws(',', k1, k2, k3) AS members, {R('objective')} AS objective FROM tri ORDER BY tri.objective DESC, p1, p2, p3 LIMIT 1""",
)
def diverse_subset_of_leaders(spark, sf):
    out = K.diverse_subset(_consensus(spark, sf), "l_partkey", ["c1", "c2"], pick=3)
    return out.select(F.array_join(F.transform("members", lambda v: v.cast("string")), ",").alias("members"), grid("objective").alias("objective"))


@query(
    "exact_percentiles_by_brand",
    f"""WITH {SALES_PREDS} SELECT p_brand, count(*) AS n, {R('quantile_cont(obs, 0.025)', 3)} AS p2_5, {R('quantile_cont(obs, 0.5)', 3)} AS p50,
    {R('quantile_cont(obs, 0.975)', 3)} AS p97_5 FROM preds GROUP BY p_brand""",
)
def exact_percentiles_by_brand(spark, sf):
    out = percentiles(sales_preds(spark, sf), ["p_brand"], "obs", {"p2_5": 0.025, "p50": 0.5, "p97_5": 0.975})
    return gridded(out, p2_5=3, p50=3, p97_5=3)


@query(
    "ks_distance_by_brand",
    f"""WITH {SALES_PREDS}, v AS (SELECT p_brand, obs AS v, 1 AS a, 0 AS b FROM preds UNION ALL SELECT p_brand, pred, 0, 1 FROM preds),
    m AS (SELECT p_brand, v, sum(a) AS a, sum(b) AS b FROM v GROUP BY ALL),
    c AS (SELECT p_brand, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER g AS na, sum(b) OVER g AS nb FROM m WINDOW w AS (PARTITION BY p_brand ORDER BY v), g AS (PARTITION BY p_brand))
    SELECT p_brand, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, {R('max(abs(ca::DOUBLE / na - cb::DOUBLE / nb))')} AS ks FROM c GROUP BY p_brand""",
)
def ks_distance_by_brand(spark, sf):
    return gridded(M.ks_statistic(sales_preds(spark, sf), ["p_brand"], "obs", "pred"), ks=6)
