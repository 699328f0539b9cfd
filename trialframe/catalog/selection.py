"""Candidate scoring, fronts, batch selection and design queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import numeric as Q
from ..functions.arrays import objective
from ..operators import candidates as C
from ..operators import design as D
from .base import DAY_CURVE, PART_SCORES, R, day_curve, grid, gridded, micros, part_scores, query, table
from .evaluation import sql_variance_tests


# ---- SQL text of the normal distribution ---------------------------------------------------------
def _horner(z: str, coefs) -> str:
    out = f"{coefs[0]!r}::DOUBLE"
    for c in coefs[1:]:
        out = f"({out} * {z} + {c!r}::DOUBLE)"
    return out


def sql_cdf(z: str) -> str:
    x = f"abs({z})"
    near = f"exp(-{x}*{x}/2) * {_horner(x, Q.CDF_TOP)} / {_horner(x, Q.CDF_BOTTOM)}"
    chain = f"({x} + 0.65::DOUBLE)"
    for c in (4, 3, 2, 1):
        chain = f"({x} + {c}.0::DOUBLE / {chain})"
    low = f"(CASE WHEN {x} > 37 THEN 0::DOUBLE WHEN {x} < {Q.CDF_SPLIT}::DOUBLE THEN {near} ELSE exp(-{x}*{x}/2) / {chain} / {Q.CDF_TAIL_SCALE}::DOUBLE END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {low} ELSE {low} END)"


def sql_pdf(z: str) -> str:
    return f"(exp(-{z}*{z}/2.0) / {math.sqrt(2 * math.pi)}::DOUBLE)"


CAND = f"""cand AS (SELECT o_custkey, {R('avg(o_totalprice)/1000', 4)} AS mu, {R('stddev_pop(o_totalprice)/1000', 4)} AS sd, {R('max(o_totalprice)/1000', 4)} AS top FROM orders GROUP BY 1)"""


def _candidates(spark, sf):
    o = table(spark, sf, "orders")
    p = F.col("o_totalprice")
    return o.groupBy("o_custkey").agg(grid(F.avg(p) / 1000, 4).alias("mu"), grid(F.stddev_pop(p) / 1000, 4).alias("sd"), grid(F.max(p) / 1000, 4).alias("top"))


@query(
    "candidate_scores",
    f"""WITH {CAND}, z AS (SELECT *, sqrt(greatest(sd*sd, 0)) + 1e-9 AS s, mu - 300 - 0.1::DOUBLE AS u FROM cand), y AS (SELECT *, u / s AS z, u / nullif(sd, 0) AS z0, u / greatest(sd, 1e-9) AS zp, (300 - mu) / nullif(sd, 0) AS ze FROM z)
    SELECT o_custkey, {R(f"s * {sql_pdf('z')} + u * {sql_cdf('z')}", 5)} AS ei, {R(f"CASE WHEN sd > 0 THEN sd * {sql_pdf('z0')} + u * {sql_cdf('z0')} ELSE 0 END", 5)} AS ei_certain_zero, {R(sql_cdf('zp'))} AS poi,
    {R('mu + 2.576::DOUBLE * sd', 4)} AS ucb, {R(f"CASE WHEN sd > 0 THEN (1 - {sql_cdf('ze')}) * sd END", 5)} AS exceedance FROM y""",
)
def candidate_scores(spark, sf):
    out = C.score_candidates(_candidates(spark, sf), "mu", "sd", 300.0)
    out = out.withColumn("exceedance", F.when(F.col("sd") > 0, F.col("exceedance")))
    return gridded(out, ei=5, ei_certain_zero=5, poi=6, ucb=4, exceedance=5).drop("mu", "sd", "top")


@query(
    "normal_distribution_values",
    f"WITH z AS (SELECT event_id, (value - 20) / 10 AS z FROM events) SELECT event_id, {R(sql_cdf('z'), 9)} AS cdf, {R(sql_pdf('z'), 9)} AS pdf FROM z",
)
def normal_distribution_values(spark, sf):
    z = (F.col("value") - 20) / 10
    return table(spark, sf, "events").select("event_id", grid(Q.norm_cdf(z), 9).alias("cdf"), grid(Q.norm_pdf(z), 9).alias("pdf"))


NOISY = """em AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), ns AS (SELECT vec_id, x, list_sum(list_transform(x, lambda v: v*v)) AS mu, 0.5::DOUBLE + label * 0.1::DOUBLE AS var FROM em),
  nb AS (SELECT x AS xb, mu AS mb, var AS vb FROM ns ORDER BY mu DESC, vec_id LIMIT 1),
  k AS (SELECT vec_id, mu, var, mb, vb, 0.5::DOUBLE * exp(-list_sum(list_transform(range(1, 65), lambda d: (x[d]-xb[d])*(x[d]-xb[d])*0.3::DOUBLE))) + 0.01::DOUBLE + 0.02::DOUBLE * list_sum(list_transform(range(1, 65), lambda d: x[d]*xb[d])) AS cov FROM ns, nb),
  s AS (SELECT *, sqrt(greatest(var + vb - 2*cov, 0)) + 1e-9 AS s FROM k)"""


@query("noisy_improvement", f"WITH {NOISY} SELECT vec_id, {R(f'''s * {sql_pdf('((mu-mb)/s)')} + (mu - mb) * {sql_cdf('((mu-mb)/s)')}''')} AS nei FROM s")
def noisy_improvement(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (0.5 + F.col("label") * 0.1).alias("var"))
    e = e.withColumn("mu", -objective("sphere", F.col("x")))
    best = e.agg(F.max_by(F.struct("x", "mu", "var"), F.struct(F.col("mu"), -F.col("vec_id"))).alias("b")).scalar()
    w = F.array_repeat(F.lit(0.3), F.size("x"))
    out = e.withColumn("b", best)
    return out.select("vec_id", grid(C.noisy_ei("x", "mu", "var", "b.x", "b.mu", "b.var", w, 0.5, 0.01, 0.02)).alias("nei"))


POE_BASE = "cells AS (SELECT l_suppkey AS unit, l_linenumber AS rowno, l_extendedprice/1000 AS mu, l_quantity AS sigma FROM lineitem), bb AS (SELECT max(m) * 0.9::DOUBLE AS best FROM (SELECT avg(mu) AS m FROM cells GROUP BY unit, rowno))"
P1 = f"""r1 AS (SELECT unit, rowno, avg(mu) AS m, avg(sigma) AS s FROM cells GROUP BY ALL), z1 AS (SELECT unit, m, s, best, (best - m)/s AS z FROM r1, bb),
  p1 AS (SELECT unit, avg(floor((1 - {sql_cdf('z')}) * 10000 + 0.5) / 10000) AS poe, avg(s * {sql_pdf('z')} + (m - best) * {sql_cdf('(-z)')}) AS ei FROM z1 GROUP BY unit)"""
P2 = f"""r2 AS (SELECT unit, avg(mu) AS m, sqrt(sum(sigma*sigma)/count(*)) AS s FROM cells GROUP BY unit), z2 AS (SELECT unit, m, s, best, (best - m)/s AS z FROM r2, bb),
  p2 AS (SELECT unit, 1 - {sql_cdf('z')} AS poe, s * {sql_pdf('z')} + (m - best) * {sql_cdf('(-z)')} AS ei FROM z2)"""


def _cells(spark, sf):
    li = table(spark, sf, "lineitem")
    cells = li.select(F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("rowno"), (F.col("l_extendedprice") / 1000).alias("mu"), F.col("l_quantity").alias("sigma"))
    return cells.withColumn("best", C.current_best(cells, ["unit", "rowno"], "mu", 0.1))


@query("exceedance_by_replicate_rows", f"WITH {POE_BASE}, {P1} SELECT unit, {R('poe', 4)} AS poe, {R('ei', 5)} AS ei, poe >= 0.35 AS go_on FROM p1")
def exceedance_by_replicate_rows(spark, sf):
    return gridded(C.poe(_cells(spark, sf), ["unit"], "rowno", "mu", "sigma", "best", 0.35, 1).drop("best"), poe=4, ei=5)


@query("exceedance_pooled", f"WITH {POE_BASE}, {P2} SELECT unit, {R('poe', 6)} AS poe, {R('ei', 5)} AS ei, poe >= 0.35 AS go_on FROM p2")
def exceedance_pooled(spark, sf):
    return gridded(C.poe(_cells(spark, sf), ["unit"], "rowno", "mu", "sigma", "best", 0.35, 2).drop("best"), poe=6, ei=5)


@query(
    "exceedance_by_chosen_method",
    f"""WITH RECURSIVE {POE_BASE}, {P1}, {P2}, g AS (SELECT unit, rowno AS grp, mu AS y, sigma AS s FROM cells), {sql_variance_tests('unit', 'g')},
    own AS (SELECT unit, method, CASE WHEN method = 'method1' THEN p1.poe ELSE p2.poe END AS poe FROM p1 JOIN p2 USING (unit) JOIN chosen USING (unit))
    SELECT unit, method, {R('poe', 4)} AS poe, poe >= 0.35 AS go_on FROM own""",
)
def exceedance_by_chosen_method(spark, sf):
    return C.auto_poe(_cells(spark, sf), ["unit"], "rowno", "mu", "sigma", "best", 0.35).select("unit", "method", grid("poe", 4).alias("poe"), "go_on")


FRONT = """SELECT p.* FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_type = p.p_type AND q.p_retailprice >= p.p_retailprice AND q.p_size <= p.p_size AND (q.p_retailprice > p.p_retailprice OR q.p_size < p.p_size))"""


@query("pareto_parts_by_type", f"SELECT p_partkey, p_type, p_size, p_retailprice FROM ({FRONT})")
def pareto_parts_by_type(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return C.pareto_front(part, ["p_type"], "p_retailprice", "p_size", (True, False))


@query(
    "pareto_orders_overall",
    """WITH o AS (SELECT o_orderkey, o_totalprice, epoch_us(o_orderdate) AS d FROM orders), r AS (SELECT *, max(d) OVER (ORDER BY o_totalprice DESC GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, max(d) OVER (PARTITION BY o_totalprice) AS own FROM o)
    SELECT o_orderkey, o_totalprice FROM r WHERE d = own AND (above IS NULL OR d > above)""",
)
def pareto_orders_overall(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", micros("o_orderdate").alias("d"))
    return C.pareto_front(o, [], "o_totalprice", "d").drop("d")


def dominated(rows: str, group: str, goals: list[str]) -> str:
    """SQL for rows of ``rows`` that another row of the group matches in all goals (larger is better) and beats in one."""
    same = f"q.{group} = p.{group} AND " if group else ""
    return f"EXISTS (SELECT 1 FROM {rows} q WHERE {same}{' AND '.join(f'q.{g} >= p.{g}' for g in goals)} AND ({' OR '.join(f'q.{g} > p.{g}' for g in goals)}))"


@query(
    "pareto_parts_3d",
    f"""WITH {PART_SCORES}, goals AS (SELECT l_partkey, p_brand, obs, pred, sales, -p_size AS small FROM scores)
    SELECT p_brand, l_partkey, obs, pred, sales FROM goals p WHERE NOT {dominated('goals', 'p_brand', ['obs', 'sales', 'small'])}""",
)
def pareto_parts_3d(spark, sf):
    """Parts of a brand that sell high, often and small."""
    front = C.pareto_front_nd(part_scores(spark, sf), ["p_brand"], ["obs", "sales", "p_size"], [True, True, False])
    return front.select("p_brand", "l_partkey", "obs", "pred", "sales")


@query(
    "pareto_customers_4d",
    f"""WITH goals AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS orders, max(o_totalprice) AS largest, max(epoch_us(o_orderdate)) AS latest FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT c_custkey, c_acctbal, orders, largest FROM goals p WHERE NOT {dominated('goals', '', ['c_acctbal', 'orders', 'largest', 'latest'])}""",
)
def pareto_customers_4d(spark, sf):
    """Customers no other one equals or beats in balance, number of orders, largest and latest order."""
    orders = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("orders"), F.max("o_totalprice").alias("largest"), F.max(micros("o_orderdate")).alias("latest"))
    goals = table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(orders, F.col("c_custkey") == F.col("o_custkey"))
    return C.pareto_front_nd(goals, [], ["c_acctbal", "orders", "largest", "latest"]).select("c_custkey", "c_acctbal", "orders", "largest")


HV = """hv AS (SELECT o_custkey, mu, sd, greatest((coalesce(lag(mu) OVER w, min(mu) OVER () - 1) - mu) * (coalesce(lead(sd) OVER w, min(sd) OVER () - 1) - sd), 0) AS hv_contribution FROM cand WINDOW w AS (ORDER BY mu DESC, o_custkey))"""


@query("hypervolume_contributions", f"WITH {CAND}, {HV} SELECT o_custkey, {R('hv_contribution', 5)} AS hv_contribution FROM hv")
def hypervolume_contributions(spark, sf):
    out = C.hv_contribution(_candidates(spark, sf), [], "mu", "sd", "o_custkey")
    return gridded(out.select("o_custkey", "hv_contribution"), hv_contribution=5)


@query(
    "hypervolume_by_generation",
    f"""WITH e AS (SELECT DISTINCT event_type, floor((epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE)::BIGINT AS gen, value AS x, (props->>'k')::DOUBLE AS y FROM events),
    rf AS (SELECT event_type, max(x) + 0.05::DOUBLE * (max(x) - min(x)) AS rx, max(y) + 0.05::DOUBLE * (max(y) - min(y)) AS ry FROM e GROUP BY 1),
    f AS (SELECT * FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE a.event_type = b.event_type AND a.gen = b.gen AND b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y))),
    s AS (SELECT event_type, gen, (coalesce(lead(x) OVER (PARTITION BY event_type, gen ORDER BY x), rx) - x) * (ry - y) AS a FROM f JOIN rf USING (event_type))
    SELECT event_type, gen, {R('sum(a)', 3)} AS hypervolume, count(*) AS front_size FROM s GROUP BY ALL""",
)
def hypervolume_by_generation(spark, sf):
    e = table(spark, sf, "events")
    day = F.floor((micros("ts") - 1704067200000000) / 86400000000.0)
    pts = e.select("event_type", day.alias("gen"), F.col("value").alias("x"), F.from_json("props", "k double")["k"].alias("y"))
    return gridded(C.hypervolume_2d(pts, ["event_type"], "gen", "x", "y"), hypervolume=3)


OBJ = {
    "sphere": "list_sum(list_transform(x, lambda v: v*v))",
    "ackley": f"-20 * exp(-0.2::DOUBLE * sqrt(list_sum(list_transform(x, lambda v: v*v)) / 64)) - exp(list_sum(list_transform(x, lambda v: cos({2 * math.pi!r}::DOUBLE * v))) / 64) + 20 + {math.e!r}::DOUBLE",
    "rastrigin": f"640 + list_sum(list_transform(x, lambda v: v*v - 10 * cos({2 * math.pi!r}::DOUBLE * v)))",
    "griewank": "list_sum(list_transform(x, lambda v: v*v)) / 4000 - list_product(list_transform(x, lambda v, i: cos(v / sqrt(i)))) + 1",
    "zakharov": "list_sum(list_transform(x, lambda v: v*v)) + pow(list_sum(list_transform(x, lambda v, i: 0.5::DOUBLE * i * v)), 2) + pow(list_sum(list_transform(x, lambda v, i: 0.5::DOUBLE * i * v)), 4)",
}
OBJ_DIGITS = {"sphere": 6, "ackley": 6, "rastrigin": 5, "griewank": 6, "zakharov": 1}


@query(
    "benchmark_objectives",
    "WITH em AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings) SELECT vec_id, " + ", ".join(f"{R('-(' + sql + ')', OBJ_DIGITS[n])} AS {n}" for n, sql in OBJ.items()) + " FROM em",
)
def benchmark_objectives(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return gridded(C.score_points(e, "x", list(OBJ)), **OBJ_DIGITS).drop("x")


EI_SQL = f"sc AS (SELECT o_custkey, mu, s * {sql_pdf('z')} + u * {sql_cdf('z')} AS ei FROM (SELECT *, u / s AS z FROM (SELECT *, sd + 1e-9 AS s, mu - 300 - 0.1::DOUBLE AS u FROM cand)))"


def _scored(spark, sf):
    cand = C.score_candidates(_candidates(spark, sf), "mu", "sd", 300.0)
    return C.hv_contribution(cand, [], "mu", "sd", "o_custkey")


def _picked(df):
    return df.select("o_custkey", "position", "list")


@query("batch_by_improvement", f"WITH {CAND}, {EI_SQL} SELECT o_custkey, row_number() OVER (ORDER BY ei DESC, o_custkey)::INT AS position, 'EI' AS list FROM sc QUALIFY position <= 6")
def batch_by_improvement(spark, sf):
    return _picked(C.select_batch(_scored(spark, sf), "EI", 6, "o_custkey", mean="mu"))


@query("batch_by_hypervolume", f"WITH {CAND}, {HV} SELECT o_custkey, row_number() OVER (ORDER BY hv_contribution DESC, o_custkey)::INT AS position, 'HV' AS list FROM hv QUALIFY position <= 6")
def batch_by_hypervolume(spark, sf):
    return _picked(C.select_batch(_scored(spark, sf), "HV", 6, "o_custkey"))


@query(
    "batch_hybrid",
    f"WITH {CAND}, {EI_SQL}, {HV} SELECT * FROM (SELECT o_custkey, row_number() OVER (ORDER BY ei DESC, o_custkey)::INT AS position, 'EI' AS list FROM sc QUALIFY position <= 4) UNION ALL SELECT * FROM (SELECT o_custkey, row_number() OVER (ORDER BY hv_contribution DESC, o_custkey)::INT AS position, 'HV' AS list FROM hv QUALIFY position <= 2)",
)
def batch_hybrid(spark, sf):
    return _picked(C.select_batch(_scored(spark, sf), "hybrid", 6, "o_custkey", mean="mu", k=4))


@query("batch_random", f"WITH {CAND} SELECT o_custkey, row_number() OVER (ORDER BY md5('15|' || o_custkey), o_custkey)::INT AS position, 'random' AS list FROM cand QUALIFY position <= 6")
def batch_random(spark, sf):
    return _picked(C.select_batch(_scored(spark, sf), "random", 6, "o_custkey", seed=15))


@query("candidate_shortlist", "SELECT p_partkey, p_retailprice AS score FROM part WHERE p_size <= 45 ORDER BY p_retailprice, p_partkey LIMIT 20")
def candidate_shortlist(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") <= 45, F.col("p_retailprice")).alias("mse"))
    return C.candidate_shortlist(part, "mse", 20, "p_partkey").select("p_partkey", "score")


@query(
    "constrained_splits",
    """WITH r AS (SELECT split, a, c_custkey, c_acctbal, md5('7|' || CASE a WHEN 0 THEN split::VARCHAR ELSE split || '/' || a END || '|' || c_custkey) AS h FROM customer, range(0, 10) t(split), range(0, 64) u(a)),
    n AS (SELECT *, row_number() OVER (PARTITION BY split, a ORDER BY h, c_custkey) AS rn FROM r),
    tp AS (SELECT split, a, max(c_acctbal) AS top FROM n WHERE rn <= 12 GROUP BY ALL), te AS (SELECT n.*, CASE WHEN c_acctbal < top THEN 'below' ELSE 'above' END AS side FROM n JOIN tp USING (split, a) WHERE rn > 12),
    pk AS (SELECT * FROM te QUALIFY row_number() OVER (PARTITION BY split, a, side ORDER BY h, c_custkey) <= 4),
    ok AS (SELECT split, min(a) AS a FROM (SELECT split, a FROM pk GROUP BY ALL HAVING count(*) = 8) GROUP BY 1)
    SELECT split::INT AS split, c_custkey, c_acctbal, part FROM (SELECT split, a, c_custkey, c_acctbal, 'train' AS part FROM n WHERE rn <= 12 UNION ALL SELECT split, a, c_custkey, c_acctbal, 'test_' || side FROM pk) JOIN ok USING (split, a)""",
)
def constrained_splits(spark, sf):
    """Twelve rows to train and four on either side of their largest value to test, ten times."""
    return D.constrained_splits(table(spark, sf, "customer"), "c_custkey", "c_acctbal", 10, 12, 4, seed=7, max_attempts=64)


def _lhs_axis(i: int, lo: float, hi: float) -> str:
    k = f"('0x' || substring(md5('3|{i}|' || p_partkey), 1, 13))::BIGINT"
    u = f"('0x' || substring(reverse(md5('3|{i}|' || p_partkey)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    return R(f"{lo}::DOUBLE + (row_number() OVER (ORDER BY {k}, p_partkey) - 1 + {u}) / count(*) OVER () * {hi - lo}::DOUBLE")


@query("latin_hypercube_points", f"SELECT p_partkey, {_lhs_axis(0, 20.0, 30.0)} AS c1, {_lhs_axis(1, 10.0, 20.0)} AS c2 FROM part")
def latin_hypercube_points(spark, sf):
    out = D.latin_hypercube(table(spark, sf, "part"), "p_partkey", {"c1": (20.0, 30.0), "c2": (10.0, 20.0)}, seed=3)
    return gridded(out, c1=6, c2=6)


@query(
    "design_grids_by_brand",
    f"""WITH b AS (SELECT p_brand, min(p_size)::DOUBLE AS l1, max(p_size)::DOUBLE AS h1, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM part GROUP BY 1), i AS (SELECT unnest(range(0, 5)) AS i), t AS (SELECT unnest([0.0, 1.0, 6.0])::DOUBLE AS time_h)
    SELECT p_brand, {R('a.i/4.0::DOUBLE')} AS c1_scaled, {R('c.i/4.0::DOUBLE')} AS c2_scaled, {R('l1 + a.i/4.0::DOUBLE*(h1-l1)', 4)} AS c1, {R('l2 + c.i/4.0::DOUBLE*(h2-l2)', 4)} AS c2, a.i IN (0,4) OR c.i IN (0,4) AS is_boundary, (a.i*5 + c.i)::INT AS grid_id, time_h FROM b, i a, i c, t""",
)
def design_grids_by_brand(spark, sf):
    b = table(spark, sf, "part").groupBy("p_brand").agg(
        F.min("p_size").cast("double").alias("lo_c1"), F.max("p_size").cast("double").alias("hi_c1"), F.min("p_retailprice").alias("lo_c2"), F.max("p_retailprice").alias("hi_c2"))
    return gridded(D.design_grid(b, ["c1", "c2"], 5, [0.0, 1.0, 6.0]), c1=4, c2=4)


OAT = "VALUES ('baseline', NULL, NULL), ('pop', 100, NULL), ('pop', 300, NULL), ('depth', NULL, 4), ('depth', NULL, 6)"


@query(
    "one_factor_plans",
    f"""WITH base AS (SELECT p_brand, min(p_size)::DOUBLE AS pop, max(p_size)::DOUBLE AS depth FROM part GROUP BY 1), v AS (SELECT * FROM ({OAT}) t(factor, a, b)),
    pl AS (SELECT p_brand, coalesce(a::DOUBLE, pop) AS pop, coalesce(b::DOUBLE, depth) AS depth, factor, s AS seed FROM base, v, range(5, 8) r(s)), fin AS (SELECT 100.0::DOUBLE AS pop, max(depth) AS depth, 6 AS seed FROM base)
    SELECT p_brand, pop, depth, factor, seed::INT AS seed FROM pl WHERE NOT EXISTS (SELECT 1 FROM fin WHERE fin.pop = pl.pop AND fin.depth = pl.depth AND fin.seed = pl.seed)""",
)
def one_factor_plans(spark, sf):
    base = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_size").cast("double").alias("pop"), F.max("p_size").cast("double").alias("depth"))
    done = base.agg(F.lit(100.0).alias("pop"), F.max("depth").alias("depth"), F.lit(6).alias("seed"))
    return D.oat_plan(base, {"pop": [100, 300], "depth": [4, 6]}, 3, seed=5, finished=done)


SWEEP_SQL = """s AS (SELECT event_type AS split, user_id AS item, value, value / (value + 40) AS poe, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS i FROM events),
  p AS (SELECT split, item, t AS threshold, count(*) AS n, max(value) > 60 AS good, min(i) FILTER (WHERE poe < t) AS st FROM s, (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS t) GROUP BY ALL),
  e AS (SELECT split, threshold, avg(((st IS NOT NULL) <> good)::INT) AS accuracy, avg((st IS NOT NULL AND good)::INT) AS type1, avg((st IS NULL AND NOT good)::INT) AS type2, avg((n - st + 1) / n::DOUBLE) FILTER (WHERE st IS NOT NULL AND NOT good) AS lead_rate FROM p GROUP BY ALL),
  w AS (SELECT threshold, avg(accuracy) AS accuracy, avg(type1) AS type1, avg(type2) AS type2, avg(lead_rate) AS lead_rate, count(*) AS splits FROM e GROUP BY 1)"""
SWEEP_COLS = f"threshold, {R('accuracy')} AS accuracy, {R('type1')} AS type1, {R('type2')} AS type2, {R('lead_rate')} AS lead_rate, splits"


def _sweep(spark, sf):
    v = F.col("value")
    ev = table(spark, sf, "events").select(F.col("event_type").alias("split"), F.col("user_id").alias("item"), "event_id", (v / (v + 40)).alias("poe"), v.alias("outcome"), F.lit(60.0).alias("best"))
    return D.threshold_sweep(ev, "split", "item", "event_id", "poe", "outcome", "best", [0.05, 0.1, 0.2])


@query("threshold_sweep", f"WITH {SWEEP_SQL} SELECT {SWEEP_COLS} FROM w")
def threshold_sweep(spark, sf):
    return gridded(_sweep(spark, sf), accuracy=6, type1=6, type2=6, lead_rate=6)


@query("chosen_threshold", f"WITH {SWEEP_SQL} SELECT {SWEEP_COLS} FROM w ORDER BY w.accuracy DESC, w.type1, w.type2, w.lead_rate DESC NULLS LAST, threshold LIMIT 1")
def chosen_threshold(spark, sf):
    return gridded(D.choose_threshold(_sweep(spark, sf)), accuracy=6, type1=6, type2=6, lead_rate=6)


def _u(i: int) -> str:
    return f"(('0x' || substring(md5('{i}|' || p_partkey), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


SOBOL = f"""x AS (SELECT p_size/50.0::DOUBLE AS a1, (p_retailprice-900)/1200 AS a2, {_u(0)} AS a3, {_u(1)} AS b1, {_u(2)} AS b2, {_u(3)} AS b3 FROM part)"""


def _f(x1: str, x2: str, x3: str) -> str:
    return f"({x1} + 2.0::DOUBLE*{x2}*{x2} + {x1}*{x3})"


_AB = [_f(*[("b" if i == k else "a") + str(i + 1) for i in range(3)]) for k in range(3)]
_BA = [_f(*[("a" if i == k else "b") + str(i + 1) for i in range(3)]) for k in range(3)]
SOBOL += f""", y AS (SELECT {_f('a1', 'a2', 'a3')} AS a, {_f('b1', 'b2', 'b3')} AS b, {', '.join(f'{e} AS ab{i + 1}' for i, e in enumerate(_AB))}, {', '.join(f'{e} AS ba{i + 1}' for i, e in enumerate(_BA))} FROM x),
  m AS (SELECT (avg(a)+avg(b)+avg(ab1)+avg(ab2)+avg(ab3)+avg(ba1)+avg(ba2)+avg(ba3))/8 AS m FROM y), c AS (SELECT a-m AS a, b-m AS b, ab1-m AS ab1, ab2-m AS ab2, ab3-m AS ab3, ba1-m AS ba1, ba2-m AS ba2, ba3-m AS ba3 FROM y, m),
  g AS (SELECT (avg(a*a)+avg(b*b))/2 - pow((avg(a)+avg(b))/2, 2) AS v, {', '.join(f'avg(b*(ab{i}-a)) AS s{i}, avg((a-ab{i})*(a-ab{i}))/2 AS t{i}' for i in (1, 2, 3))}, {', '.join(f'avg(ba{i}*ab{j} - a*b) AS p{i}{j}' for i, j in ((1, 2), (1, 3), (2, 3)))} FROM c)"""


@query(
    "sobol_indices",
    f"WITH {SOBOL} " + " UNION ALL ".join(
        [f"SELECT 'first' AS \"order\", '{i}' AS term, {R(f's{i}/v')} AS value FROM g UNION ALL SELECT 'total', '{i}', {R(f't{i}/v')} FROM g" for i in (1, 2, 3)]
        + [f"SELECT 'second', '{i},{j}', {R(f'(p{i}{j} - s{i} - s{j})/v')} FROM g" for i, j in ((1, 2), (1, 3), (2, 3))]
    ),
)
def sobol_indices(spark, sf):
    part = table(spark, sf, "part")
    u = lambda i: C.hash_number(C.hash_text(i, F.col("p_partkey")), 8) / F.lit(16.0**8)
    x = part.select((F.col("p_size") / 50).alias("a1"), ((F.col("p_retailprice") - 900) / 1200).alias("a2"), u(0).alias("a3"), u(1).alias("b1"), u(2).alias("b2"), u(3).alias("b3"))
    f = lambda names: F.col(names[0]) + 2.0 * F.col(names[1]) * F.col(names[1]) + F.col(names[0]) * F.col(names[2])
    mix = lambda k, own, other: [(other if i == k else own) + str(i + 1) for i in range(3)]
    y = x.select(
        f(["a1", "a2", "a3"]).alias("ya"), f(["b1", "b2", "b3"]).alias("yb"),
        *[f(mix(k, "a", "b")).alias(f"ab{k + 1}") for k in range(3)], *[f(mix(k, "b", "a")).alias(f"ba{k + 1}") for k in range(3)],
    )
    return gridded(D.sobol_indices(y, "ya", "yb", ["ab1", "ab2", "ab3"], ["ba1", "ba2", "ba3"]), value=6)


@query(
    "main_effects",
    f"""WITH t AS (SELECT 'l_quantity' AS axis, l_quantity AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM lineitem), b AS (SELECT axis, min(x) AS lo, max(x) AS hi FROM t GROUP BY 1),
    r AS (SELECT axis, y, lo, (hi-lo)/20 AS w, floor((x-lo)/((hi-lo)/20))::BIGINT AS bin FROM t JOIN b USING (axis) WHERE x < hi)
    SELECT axis, bin, {R('lo + (bin + 0.5)*w', 5)} AS center, count(*) AS n, {R('avg(y)', 3)} AS effect FROM r GROUP BY axis, bin, lo, w""",
)
def main_effects(spark, sf):
    return gridded(D.main_effects(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice"), center=5, effect=3)


def sql_drawn(seed: int, parts: list[str], below: str) -> str:
    """The SQL of the two-step draws, one mixing step after the other."""

    def mixed(start: int) -> str:
        h = f"({start}::BIGINT)"
        for factor, part in zip(D.MIX_FACTORS, parts, strict=False):
            h = f"(({h} * {factor} + {part} % {D.MIX_PRIME}) % {D.MIX_PRIME})"
        for factor in D.MIX_FACTORS:
            h = f"(list_transform([{h}], lambda h{factor}: xor(h{factor}, h{factor} >> 15) * {factor} % {D.MIX_PRIME})[1])"
        return h

    return f"(({mixed(2 * seed)} * 2147483648 + {mixed(2 * seed + 1)}) % {below})"


BOOT_BLOCK = 64
BOOT = f"""{DAY_CURVE}, st AS (SELECT user_id, count(*) AS c, sum((q_obs-q_pred)*(q_obs-q_pred)) AS s2, sum(abs(q_obs-q_pred)) AS s1, sum(q_obs) AS sy, sum(q_obs*q_obs) AS syy, row_number() OVER (ORDER BY user_id) - 1 AS u FROM curve GROUP BY 1),
  n AS (SELECT count(*) AS n FROM st), bl AS (SELECT u // {BOOT_BLOCK} AS block, count(*) AS m FROM st GROUP BY 1),
  d1 AS (SELECT r AS replicate, CASE WHEN n <= {BOOT_BLOCK} THEN 0 ELSE {sql_drawn(11, ['r', 'i'], 'n')} // {BOOT_BLOCK} END AS block FROM n, range(0, 500) t(r), range(0, n) k(i)),
  d2 AS (SELECT replicate, block, row_number() OVER (PARTITION BY replicate, block) - 1 AS j FROM d1),
  dr AS (SELECT replicate, block * {BOOT_BLOCK} + {sql_drawn(12, ['replicate', 'block', 'j'], 'm')} AS u FROM d2 JOIN bl USING (block)),
  rp AS (SELECT replicate::INT AS replicate, count(DISTINCT u) AS unique_units, sum(c) AS c, sum(s2) AS s2, sum(s1) AS s1, sum(sy) AS sy, sum(syy) AS syy FROM dr JOIN st USING (u) GROUP BY 1)"""


def _boot(spark, sf):
    return D.bootstrap_metrics(day_curve(spark, sf), ["user_id"], "q_obs", "q_pred", 500, seed=11, block=BOOT_BLOCK)


@query("bootstrap_replicates", f"WITH {BOOT} SELECT replicate, unique_units, {R('sqrt(s2/c)', 4)} AS rmse, {R('s1/c', 4)} AS mae, {R('1 - s2/(syy - sy*sy/c)')} AS r2 FROM rp")
def bootstrap_replicates(spark, sf):
    return gridded(_boot(spark, sf), rmse=4, mae=4, r2=6)


@query(
    "bootstrap_summary",
    f"""WITH {BOOT}, t AS (SELECT 'rmse' AS metric, sqrt(s2/c) AS v FROM rp UNION ALL SELECT 'mae', s1/c FROM rp)
    SELECT metric, {R('avg(v)', 4)} AS mean, {R('stddev_samp(v)', 5)} AS sd, count(*) AS n, {R('quantile_cont(v, 0.025)', 4)} AS p2_5, {R('quantile_cont(v, 0.5)', 4)} AS p50, {R('quantile_cont(v, 0.975)', 4)} AS p97_5 FROM t GROUP BY metric""",
)
def bootstrap_summary(spark, sf):
    return gridded(D.bootstrap_summary(_boot(spark, sf), ["rmse", "mae"]), mean=4, sd=5, p2_5=4, p50=4, p97_5=4)
