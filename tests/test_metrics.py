"""Published values, edge cases and properties of the evaluation operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe.functions import pvalues
from trialframe.functions.pvalues import beta_cdf
from trialframe.operators import metrics as M
from trialframe.operators import ranking as K
from trialframe.operators import runs as N

# Observed and predicted release at six hours, and the release curve of the first run.
OBSERVED = (
    3239.848711, 2871.562143, 3058.493411, 3234.401436, 3305.135581, 3092.064125, 2963.245181, 1968.508276, 2983.096187,
    3008.198195, 1962.317567, 2158.756075,
)
PREDICTED = (
    2185.36073, 2185.35889, 2185.361472, 2185.358068, 2185.366704, 2185.455759, 2184.718655, 2069.985271, 2158.730621,
    2191.061042, 2097.807365, 2095.452962,
)
HOURS = (0, 0.5, 1, 2, 3, 4, 5, 6)
CURVE = (0, 202.3297076, 464.5757792, 1193.333104, 1674.243018, 2277.658231, 2689.335112, 3239.848711)
CURVE_AREA = 9904.0905087
# Mean diversity per seed of one method.
SEED_MEANS = (
    0.32385652900331835, 0.3216595598144834, 0.3348315423865663, 0.3452456352652831, 0.2921383026660892,
    0.3022546009572774, 0.2620328578732706, 0.32956249746800914, 0.31969102740188876, 0.31028968079368885,
)


@pytest.fixture(scope="module")
def ends(spark):
    rows = [(i, o, p) for i, (o, p) in enumerate(zip(OBSERVED, PREDICTED))]
    return spark.createDataFrame(rows, "id long, obs double, pred double")


def test_published_rank_summary(ends):
    r = K.rank_metrics(ends, [], "obs", "pred", "id", k=2).first()
    assert (r.n, r.untied_pairs, r.correct_pairs, r.hit_at_k, r.precision_at_k) == (12, 66, 50, 0, 0.0)
    assert math.isclose(r.spearman, 0.7272727272727275, abs_tol=1e-12)
    assert math.isclose(r.kendall_tau, 0.5151515151515151, abs_tol=1e-12)
    assert math.isclose(r.binomial_tail, 1.664117508516031e-05, rel_tol=1e-9)


def test_published_topk(ends):
    top = {r.k: (r.precision, r.hit, r.baseline) for r in K.topk_quality(ends, [], "obs", "pred", "id").collect()}
    assert top[1] == (0.0, 0, 1 / 12) and top[2] == (0.0, 0, 2 / 12)
    assert top[3] == (1 / 3, 1, 0.25) and len(top) == 6


def test_published_area(spark):
    c = spark.createDataFrame([(0, float(t), float(q)) for t, q in zip(HOURS, CURVE)], "r int, t double, q double")
    assert math.isclose(M.auc_trapezoid(c, ["r"], "t", ["q"], 6.0).first().auc_q, CURVE_AREA, rel_tol=1e-9)
    late = c.filter("t > 0")  # the anchor replaces the missing origin
    assert math.isclose(M.auc_trapezoid(late, ["r"], "t", ["q"], 6.0).first().auc_q, CURVE_AREA, rel_tol=1e-9)
    assert M.auc_trapezoid(late, ["r"], "t", ["q"], 6.0, anchor=False).first().auc_q < CURVE_AREA


def test_published_diversity_summary(spark):
    df = spark.createDataFrame([("EI", 30 + i, v) for i, v in enumerate(SEED_MEANS)], "method string, seed int, v double")
    r = N.seed_then_group(df, ["method"], "seed", "v").first()
    assert (f"{r['mean']:.3g}", f"{r['sd']:.2g}", r["n"]) == ("0.314", "0.024", 10)


def test_regression_edges(spark):
    rows = [
        ("flat_hit", 1.0, 1.0), ("flat_hit", 1.0, 1.0), ("flat_miss", 1.0, 2.0), ("flat_miss", 1.0, 1.0), ("one", 3.0, 4.0),
        ("bad", float("nan"), 1.0), ("bad", 2.0, float("inf")), ("bad", None, 1.0), ("bad", 5.0, 4.0), ("bad", 7.0, 7.0),
    ]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = {r.g: r for r in M.regression_metrics(df, ["g"], "y", "p").collect()}
    assert got["flat_hit"].r2 == 1.0 and math.isnan(got["flat_miss"].r2)
    assert got["bad"].n == 2 and got["bad"].mae == 0.5 and got["one"].rmse == 1.0
    assert M.regression_metrics(df.filter("g = 'none'"), ["g"], "y", "p").count() == 0


def test_zero_variance_policies(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(4)], "g string, x double, y double")
    assert math.isnan(M.spearman(df, ["g"], "x", "y").first().spearman)
    assert M.spearman(df, ["g"], "x", "y", zero_var=0.0).first().spearman == 0.0
    assert M.spearman(df, ["g"], "x", "y", zero_var=None).first().spearman is None
    assert M.kendall_tau(df, ["g"], "x", "y", "custom").first().kendall_tau == 0.0
    assert math.isnan(M.kendall_tau(df, ["g"], "x", "y").first().kendall_tau)
    assert M.pairwise_accuracy(df, ["g"], "x", "y").first().pair_accuracy is None


def test_tau_changes_sign(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(60)], "x int, y int")
    a = M.kendall_tau(df, [], "x", "y").first().kendall_tau
    b = M.kendall_tau(df.withColumn("y", -F.col("y")), [], "x", "y").first().kendall_tau
    assert math.isclose(a, -b)


def test_tail_probabilities():
    exact = sum(math.comb(66, k) for k in range(50, 67)) / 2**66
    assert math.isclose(beta_cdf(50, 17, 0.5), exact, rel_tol=1e-12)
    assert math.isclose(beta_cdf(2.5, 1.5, 0.3) + beta_cdf(1.5, 2.5, 0.7), 1.0, rel_tol=1e-12)


@pytest.mark.parametrize("cap", [5, None])
def test_hot_groups_give_the_same_metrics(spark, cap):
    rng = random.Random(9)
    rows = [("hot" if i % 4 else "cold", i, float(rng.randint(0, 20)), float(rng.randint(0, 20))) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, id long, a double, b double")
    rho = {r.g: round(r.spearman, 12) for r in M.spearman(df, ["g"], "a", "b", cap=cap).collect()}
    pdf = df.toPandas()
    want = {g: round(d.a.rank().corr(d.b.rank()), 12) for g, d in pdf.groupby("g")}
    assert rho == pytest.approx(want)
    gains = K.gains_curve(df, ["g"], "a", "b", "id", cap=cap)
    last = gains.groupBy("g").agg(F.max("recall").alias("r"), F.max("k").alias("k"), F.max("n").alias("n")).collect()
    assert all(r.r == 1.0 and r.k == r.n for r in last)


def test_anova_levene_against_direct_formulas(spark):
    groups = {"a": [1.0, 2.0, 4.0], "b": [2.0, 5.0, 9.0, 4.0], "c": [3.0, 3.5, 8.0]}
    df = spark.createDataFrame([("u", g, v, 1.0) for g, vs in groups.items() for v in vs], "u string, g string, m double, s double")

    def f_stat(gs):
        n, k = sum(map(len, gs)), len(gs)
        grand = sum(map(sum, gs)) / n
        between = sum(len(g) * (sum(g) / len(g) - grand) ** 2 for g in gs) / (k - 1)
        within = sum((v - sum(g) / len(g)) ** 2 for g in gs for v in g) / (n - k)
        return between / within

    med = lambda g: sorted(g)[len(g) // 2] if len(g) % 2 else sum(sorted(g)[len(g) // 2 - 1:len(g) // 2 + 1]) / 2
    r = M.anova_levene(df, ["u"], "g", "m", "s").first()
    assert math.isclose(r.anova_f, f_stat(list(groups.values())), rel_tol=1e-9)
    assert math.isclose(r.levene_w, f_stat([[abs(v - med(g)) for v in g] for g in groups.values()]), rel_tol=1e-9)
    assert 0 < r.anova_p < 1 and r.method == "method1"


def test_curve_r2_keeps_its_digits_far_from_zero(spark):
    rng = random.Random(2)
    rows = [(float(t), 1e8 + rng.random() * 1e-2, 1e8 + rng.random() * 1e-2) for t in range(1, 4) for _ in range(40)]
    df = spark.createDataFrame(rows, "t double, y double, p double").withColumn("g", F.lit(1))
    got = {r.scope: r.r2 for r in M.curve_metrics(df, ["g"], "t", "y", "p").collect()}
    want = M.regression_metrics(df, ["g"], "y", "p").first().r2
    assert got["including_t0"] == pytest.approx(want, rel=1e-4)


def test_ks_statistic_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randint(0, 20)), None if rng.random() < 0.2 else float(rng.randint(3, 25))) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, a double, b double")
    for cap in (20, 10**6):
        for r in M.ks_statistic(df, ["g"], "a", "b", cap).collect():
            a, b = [x for g, x, _ in rows if g == r.g], [y for g, _, y in rows if g == r.g and y is not None]
            share = lambda s, v: sum(x <= v for x in s) / len(s)
            assert (r.n_a, r.n_b) == (len(a), len(b)) and r.ks == pytest.approx(max(abs(share(a, v) - share(b, v)) for v in range(30)))


def test_tail_that_does_not_settle_is_not_a_number(monkeypatch):
    monkeypatch.setattr(pvalues, "STEPS", 3)
    assert math.isnan(pvalues.beta_cdf(5000.0, 5000.0, 0.5))


def test_tail_probabilities_as_expressions(spark):
    """Against the vectorised form and closed values, over small and large freedoms and both ends."""
    rng = np.random.default_rng(2)
    rows = [(float(a) / 2, float(b) / 2, float(x)) for a, b, x in zip(rng.integers(1, 400, 200), rng.integers(1, 60, 200), rng.random(200), strict=True)]
    rows += [(0.5, 0.5, 0.5), (1.0, 1.0, 0.25), (5e4, 2.0, 0.9999), (3.0, 2.0, 0.0), (3.0, 2.0, 1.0), (2e5, 2e5, 0.5)]
    got = [r.p for r in spark.createDataFrame(rows, "a double, b double, x double").select(pvalues.beta_cdf_column(F.col("a"), F.col("b"), F.col("x")).alias("p")).collect()]
    want = pvalues.beta_cdfs(*np.array(rows).T)
    assert np.allclose(got, want, rtol=1e-9, atol=1e-12) and got[-6:-4] == pytest.approx([0.5, 0.25]) and got[-3:-1] == [0.0, 1.0]
    odd = spark.createDataFrame([(None, 1.0, 1.0), (2.0, 0.0, 5.0), (1.0, 1.0, 1.0), (0.0, 2.0, 9.0)], "f double, d1 double, d2 double")
    p = [r.p for r in odd.select(pvalues.f_tail("f", F.col("d1"), F.col("d2")).alias("p")).collect()]
    assert p[0] is None and math.isnan(p[1]) and p[2] == pytest.approx(0.5) and p[3] == 1.0
