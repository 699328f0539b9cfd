"""Oversized-group plans must give what plain windows and brute force give."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trialframe.plans.concordance import concordance, rising_weights
from trialframe.plans.ordered import ordered
from trialframe.plans.ranks import percentiles, with_ranks


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows and one value fills a third of it; some keys and values are null."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        g = "hot" if i % 3 else rng.choice(["a", "b", None])
        v = None if i % 41 == 0 else (5.0 if rng.random() < 0.35 else float(rng.randint(0, 90)))
        rows.append((g, i, v, float(rng.randint(0, 30))))
    return spark.createDataFrame(rows, "g string, id long, v double, y double").cache()


def _same(a, b, keys):
    left = sorted(map(str, a.select(*keys).collect()))
    right = sorted(map(str, b.select(*keys).collect()))
    assert left == right


@pytest.mark.parametrize("cap", [20, 75, 10**6])
def test_running_shift_index_total(skewed, cap):
    w = Window.partitionBy("g").orderBy(F.asc("v"), F.desc("id"))
    run, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.select(
        "*",
        F.sum("y").over(run).alias("s"), F.max("y").over(past).alias("m"), F.count("v").over(past).alias("c"),
        F.lag("y").over(w).alias("p"), F.lead("id").over(w).alias("nx"),
        F.row_number().over(w).cast("long").alias("i"), F.sum("y").over(Window.partitionBy("g")).alias("t"),
    )
    got = (
        ordered(skewed, ["g"], ["v", "-id"], cap)
        .running(s=("sum", F.col("y")))
        .running(exclusive=True, m=("max", F.col("y")), c=("count", F.col("v")))
        .previous(p=F.col("y")).following(nx=F.col("id")).index("i").total(t=("sum", F.col("y")))
        .done()
    )
    assert got.columns == want.columns
    _same(got, want, want.columns)


def test_helper_columns_may_be_taken(spark):
    rows = spark.createDataFrame([(i, i % 7, i % 5) for i in range(60)], "__c long, __r long, __edge long")
    w = Window.orderBy("__c")
    want = rows.select("*", F.row_number().over(w).cast("long").alias("i"), F.lag("__r").over(w).alias("p"))
    _same(ordered(rows, [], ["__c"], 9).index("i").previous(p=F.col("__r")).done(), want, want.columns)


@pytest.mark.parametrize("cap", [15, 10**6])
@pytest.mark.parametrize("desc", [True, False])
def test_ranks(skewed, cap, desc):
    w = Window.partitionBy("g").orderBy(F.desc("v") if desc else F.asc("v"))
    n = F.count(F.lit(1)).over(Window.partitionBy("g", "v"))
    want = skewed.select(
        "g", "id", F.rank().over(w).alias("r_min"), (F.rank().over(w) + n - 1).alias("r_max"),
        F.dense_rank().over(w).alias("r_dense"), (F.rank().over(w) + (n - 1) / 2.0).alias("r_avg"),
    )
    got = with_ranks(skewed, ["g"], "v", "r", desc, cap)
    _same(got, want, want.columns)


def test_ranks_of_whole_numbers_beyond_double_precision(spark):
    big = 2**60
    rows = [("g", i, big + i % 3 if i % 2 else 7) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, id long, v long")
    w = Window.partitionBy("g").orderBy("v")
    want = df.select("id", F.rank().over(w).alias("r_min"), F.dense_rank().over(w).alias("r_dense"))
    _same(with_ranks(df, ["g"], "v", "r", cap=20), want, want.columns)
    o = ordered(df, ["g"], ["v", "id"], 20)
    assert o.parts
    first = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")).cast("long").alias("i"))
    _same(o.index("i").done(), first, ["id", "i"])


def test_global_ranks_and_percentiles(skewed):
    got = with_ranks(skewed, [], "y", "r", cap=50).agg(F.sum("r_avg")).first()[0]
    assert got == 600 * 601 / 2
    for cap in (10, 10**6):
        row = percentiles(skewed, [], "y", {"lo": 0.025, "mid": 0.5}, cap).first()
        ys = [r.y for r in skewed.collect()]
        assert np.allclose([row.lo, row.mid], np.percentile(ys, [2.5, 50]))


def test_rising_weights_brute_force():
    rng = np.random.default_rng(1)
    g = np.sort(rng.integers(0, 3, 80))
    x, y, w = rng.integers(0, 9, 80), rng.integers(0, 9, 80), rng.integers(1, 4, 80)
    got = rising_weights(g, x.astype(float), y.astype(float), w.astype(float)).sum()
    want = sum(
        w[i] * w[j] for i, j in itertools.permutations(range(80), 2) if g[i] == g[j] and x[i] < x[j] and y[i] < y[j]
    )
    assert got == want


@pytest.mark.parametrize("cap", [12, 60, 10**6])
def test_concordance(skewed, cap):
    got = {r.g: r for r in concordance(skewed, ["g"], "v", "y", cap).collect()}
    groups = {}
    for r in skewed.filter("v is not null").collect():
        groups.setdefault(r.g, []).append((r.v, r.y))
    assert set(got) == set(groups)
    for g, pts in groups.items():
        c = d = tx = ty = tb = 0
        for (a, b), (e, f) in itertools.combinations(pts, 2):
            s = (a - e) * (b - f)
            c, d = c + (s > 0), d + (s < 0)
            tx, ty, tb = tx + (a == e), ty + (b == f), tb + (a == e and b == f)
        r = got[g]
        assert (r.n_rows, r.concordant, r.discordant, r.ties_x, r.ties_y, r.ties_both) == (len(pts), c, d, tx, ty, tb)


@pytest.mark.parametrize("cap", [25, 10**6])
def test_order_of_every_type_and_direction(spark, cap):
    """Shuffled rows, nulls, shared prefixes and big numbers: ranges order them as a window does."""
    rng = random.Random(cap)
    data = []
    for i in range(400):
        data.append((
            "hot" if i % 8 else "cold", i, rng.choice([None, "https://doi.org/10.10", "other-"]) and f"https://doi.org/10.10{rng.randint(0, 99):02d}/{i % 7}",
            None if i % 11 == 0 else f"other-{rng.randint(0, 400):04d}", None if i % 7 == 0 else rng.randint(0, 5), 2**60 + rng.randint(0, 9), str(rng.randint(0, 50)),
        ))
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, id long, u string, n string, y int, b long, d string").withColumns(
        {"d": F.col("d").cast("decimal(20,3)"), "t": F.timestamp_seconds(F.col("b") % 1000)}).repartition(7)
    for order in (["-n", "id"], ["u", "-n", "id"], ["b", "-y", "id"], ["-b", "id"], ["d", "-id"], ["-t", "u", "id"], ["-y", "-d", "-id"]):
        spec = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]
        w = Window.partitionBy("g").orderBy(*spec)
        want = df.select("g", "id", F.lead("n").over(w).alias("nx"), F.lag("id").over(w).alias("p"), F.row_number().over(w).cast("long").alias("i"),
                         F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
        got = ordered(df, ["g"], order, cap).following(nx=F.col("n")).previous(p=F.col("id")).index("i").running(s=("sum", F.col("id"))).done()
        _same(got, want, ["g", "id", "nx", "p", "i", "s"])


def test_ranges_of_one_giant_and_many_small_oversized_groups(spark):
    df = spark.range(8000).select(F.when(F.col("id") < 4000, F.lit(0)).otherwise(1 + F.col("id") % 50).alias("g"), "id", (F.col("id") * 7919 % 8009).alias("v"))
    o = ordered(df, ["g"], ["v", "id"], 60)
    ranges = o.df.filter(F.col(o.parts[0]).isNotNull()).groupBy(*o.keys).count()
    assert ranges.count() <= 3 * 8000 / 60 + 1
    w = Window.partitionBy("g").orderBy("v", "id")
    _same(o.index("i").done(), df.withColumn("i", F.row_number().over(w).cast("long")), ["g", "id", "i"])


def test_pair_counts_beyond_double_precision(spark):
    big = 3_000_000_001
    from trialframe.plans.concordance import _pairs

    row = spark.createDataFrame([(big,), (big + 1,), (1,), (0,)], "n long").select("n", _pairs(F.col("n")).alias("p")).collect()
    assert [int(r.p) for r in row] == [r.n * (r.n - 1) // 2 for r in row]


def test_percentiles_and_moments_take_one_exchange(skewed):
    out = percentiles(skewed, ["g"], "y", {"mid": 0.5}, also=(F.avg("y").alias("m"),))
    plan = out._jdf.queryExecution().sparkPlan().toString() + out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
