"""Baseline model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..plans.stage import staged
from .base import R, grid, query, table


@query(
    "ridge_predictions",
    f"""WITH s AS (SELECT count(*) AS n, avg(p_size) AS mx, stddev_pop(p_size) AS sx, avg(p_retailprice) AS my, covar_pop(p_size, p_retailprice) AS c FROM part)
    SELECT p_partkey, {R('my + (c / sx * n / (n + 1)) * (p_size - mx) / sx', 4)} AS pred FROM part, s""",
)
def ridge_predictions(spark, sf):
    part = table(spark, sf, "part")
    out = M.linear_predict(part, M.ridge_fit(part, ["p_size"], "p_retailprice", alpha=1.0))
    return out.select("p_partkey", grid("pred", 4).alias("pred"))


def _part_targets(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_extendedprice").alias("price"), F.avg("l_quantity").alias("qty"))
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type", "p_brand")
    return part.join(li, li.l_partkey == part.p_partkey).drop("l_partkey")


@query(
    "response_surface_of_size",
    f"""WITH s AS (SELECT count(*) AS n, avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_size * p_size) AS m2, stddev_pop(p_size * p_size) AS s2, avg(p_retailprice) AS my FROM part),
    z AS (SELECT p_partkey, (p_size - m1) / s1 AS a, (p_size * p_size - m2) / s2 AS b, p_retailprice - my AS y, my FROM part, s),
    k AS (SELECT sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM z)
    SELECT p_partkey, {R('my + a * (bb * ay - ab * by_) / (aa * bb - ab * ab) + b * (aa * by_ - ab * ay) / (aa * bb - ab * ab)', 4)} AS pred FROM z, k""",
)
def response_surface_of_size(spark, sf):
    part = table(spark, sf, "part")
    out = M.linear_predict(part, M.rsm2_fit(part, ["p_size"], "p_retailprice", alpha=1.0))
    return out.select("p_partkey", grid("pred", 4).alias("pred"))


@query("response_surface_predictions")
def response_surface_predictions(spark, sf):
    rows = _part_targets(spark, sf)
    return M.linear_predict(rows, M.rsm2_fit(rows, ["p_size", "p_retailprice", "qty"], "price")).select("p_partkey", "price", "pred")


@query(
    "pls_predictions",
    f"""WITH m AS (SELECT avg(p_size) AS m1, stddev_samp(p_size) AS s1, avg(p_retailprice) AS m2, stddev_samp(p_retailprice) AS s2, avg(l_quantity) AS my FROM part JOIN lineitem ON p_partkey = l_partkey),
    z AS (SELECT p_partkey, (p_size - m1) / s1 AS a, (p_retailprice - m2) / s2 AS b, my FROM part, m),
    k AS (SELECT sum(a * (l_quantity - my)) AS ca, sum(b * (l_quantity - my)) AS cb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM z JOIN lineitem ON p_partkey = l_partkey),
    w AS (SELECT ca, cb, ca / sqrt(ca * ca + cb * cb) AS wa, cb / sqrt(ca * ca + cb * cb) AS wb, aa, ab, bb FROM k),
    q AS (SELECT wa, wb, (wa * ca + wb * cb) / (wa * wa * aa + 2 * wa * wb * ab + wb * wb * bb) AS g FROM w)
    SELECT p_partkey, {R('my + g * (wa * a + wb * b)', 4)} AS pred FROM z, q""",
)
def pls_predictions(spark, sf):
    li, part = table(spark, sf, "lineitem").select("l_partkey", "l_quantity"), table(spark, sf, "part")
    sold = part.select("p_partkey", "p_size", "p_retailprice").join(li, F.col("p_partkey") == F.col("l_partkey"))
    out = M.linear_predict(part, M.pls_fit(sold, ["p_size", "p_retailprice"], "l_quantity", components=1))
    return out.select("p_partkey", grid("pred", 4).alias("pred"))


@query("forest_predictions")
def forest_predictions(spark, sf):
    rows = staged(_part_targets(spark, sf), "targets")  # read by every pass of the fit
    preds = M.forest_fit_predict(rows, rows, ["p_size", "p_retailprice", "qty"], "price", held=True)
    return preds.select("p_partkey", "price", "pred")


@query("baseline_report")
def baseline_report(spark, sf):
    rows = _part_targets(spark, sf)
    train, test = rows.filter("p_size <= 35"), rows.filter("p_size > 35")
    preds = M.baseline_compare(train, test, ["p_size", "p_retailprice"], ["price", "qty"], "p_partkey", ["p_type"])
    return M.baseline_report(preds, "p_partkey")


@query("gaussian_process_scores")
def gaussian_process_scores(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    # one training row per label: the centroid and the mean squared length
    mean = e.select("label", F.posexplode("x").alias("d", "v")).groupBy("label", "d").agg(F.avg("v").alias("v"), F.avg(F.col("v") * F.col("v")).alias("s"))
    train = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda p: p["v"]).alias("x"), F.sum("s").alias("y"))
    return M.gp_score(e.select("vec_id", "x"), train.select("x", "y"), "x", "y", 1.0, [64.0] * 64, 0.1, 0.01, 0.05)
