"""Run analytics, selection, audits, models and streams against brute force."""

import datetime
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialframe.functions.numeric import norm_cdf
from trialframe.operators import audits as A
from trialframe.operators import candidates as C
from trialframe.operators import design as D
from trialframe.operators import models as M
from trialframe.operators import runs as N
from trialframe.operators import series as S
from trialframe.plans.ordered import ordered
from trialframe.session import scratch_path
from trialframe.streaming import jobs as J


def test_segments_and_shifted_rows(spark):
    its = [1, 2, None, 3, 1, 2, 2, 1]
    df = spark.createDataFrame([("a", i, v, float(i)) for i, v in enumerate(its)], "g string, row int, it int, v double")
    for cap in (3, None):
        got = {r.row: r.segment for r in S.segment_runs(df, ["g"], ["row"], "it", cap).collect()}
        assert got == {0: 0, 1: 0, 3: 0, 4: 1, 5: 1, 6: 2, 7: 3}
    ends = S.last_complete_runs(df, ["g"], ["row"], "it", "v", final=2, n=5).collect()
    assert sorted((r.segment, r.final) for r in ends) == [(1, 5.0), (2, 6.0)]


@pytest.mark.parametrize("alpha", [0.0, 0.3, 0.9, 1.0])
def test_adaptive_weights_follow_the_recurrence(spark, alpha):
    rng = random.Random(2)
    rows = [("r", t, rng.random(), rng.random() if t % 7 else 0.0) for t in range(1, 90)]
    rows[3] = ("r", 4, 0.0, 0.0)
    df = spark.createDataFrame(rows, "r string, t int, a double, b double")
    for mode in ("floor", "round"):
        got = {x.t: x for x in S.adaptive_weights(df, ["r"], ["t"], "a", "b", 6, alpha, mode, cap=20).collect()}
        w = 0.5
        for _, t, a, b in rows:
            s = 0.5 if a + b == 0 else a / (a + b + 1e-9)
            w = alpha * w + (1 - alpha) * s
            assert math.isclose(got[t].weight_first, w, abs_tol=1e-12)
            n = max(1, int(w * 6)) if mode == "floor" else max(1, round(w * 6))
            assert got[t].n_first == n and got[t].n_second == 6 - n


def test_padding_and_stops(spark):
    df = spark.createDataFrame([("a", 1, 12.0), ("a", 2, 15.0), ("b", 1, 9.0), ("b", 2, 11.0), ("b", 3, 20.0), ("b", 4, 30.0)], "r string, i int, v double")
    got = {(x.r, x.position): x.gain for x in S.pad_curve(df, ["r"], ["i"], "v", F.lit(10.0), 3).collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 5.0, ("a", 3): 5.0, ("b", 1): 0.0, ("b", 2): 1.0, ("b", 3): 10.0}
    poe = spark.createDataFrame([("x", i, p) for i, p in enumerate([0.9, 0.5, 0.1, 0.9])] + [("y", i, 0.9) for i in range(3)], "r string, i int, p double")
    stops = {x.r: (x.position, x.stopped) for x in S.stop_position(poe, ["r"], ["i"], "p", 0.2, cap=2).collect()}
    assert stops == {"x": (2, True), "y": (3, False)}


@pytest.mark.parametrize("cap", [4, None])
def test_interpolation_matches_numpy(spark, cap):
    rng = np.random.default_rng(4)
    xs, ys, qs = np.sort(rng.random(20)) * 10, rng.random(20), rng.random(30) * 14 - 2
    curve = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(xs, ys)], "g string, x double, y double")
    at = spark.createDataFrame([("g", i, float(q)) for i, q in enumerate(np.r_[qs, xs[3]])], "g string, id long, x double")
    got = {r.id: r.y for r in S.interp_at(curve, at, ["g"], "x", "y", "id", cap).collect()}
    assert np.allclose([got[i] for i in range(31)], np.interp(np.r_[qs, xs[3]], xs, ys))


def test_gradient_matches_numpy(spark):
    c1, c2 = np.array([0.0, 1.0, 3.0]), np.array([0.0, 0.5, 1.0, 2.0])
    v = np.random.default_rng(1).random((3, 4))
    df = spark.createDataFrame([(float(a), float(b), float(v[i, j])) for i, a in enumerate(c1) for j, b in enumerate(c2)], "c1 double, c2 double, q double")
    got = {(r.c1, r.c2): (r.d_c1, r.d_c2) for r in S.grid_gradient(df, [], ["c1", "c2"], "q").collect()}
    g1, g2 = np.gradient(v, c1, c2, edge_order=1)
    for i, a in enumerate(c1):
        for j, b in enumerate(c2):
            assert np.allclose(got[(a, b)], (g1[i, j], g2[i, j]))


@pytest.mark.parametrize("d, kind, cap", [(1, "ties", None), (3, "ties", 6), (3, "all on the front", 6), (4, "all on the front", None), (4, "random", 6)])
def test_front_of_many_objectives(spark, d, kind, cap):
    rng = random.Random(d)
    draw = {"ties": lambda: float(rng.randint(0, 3)), "random": rng.random, "all on the front": rng.random}[kind]
    pts = [("a" if i % 5 else "b", i, *(draw() for _ in range(d))) for i in range(70)]
    if kind == "all on the front":  # a fixed sum: whoever is better in one objective is worse in another
        pts = [(*p[:-1], float(d) - sum(p[2:-1])) if d > 1 else (*p[:-1], 1.0) for p in pts]
    pts += [("b", 900, *[float("nan")] * d), ("a", 901, *[0.0] * (d - 1), None)]
    signs = [i % 2 == 0 for i in range(d)]
    pts = [(g, i, *[v if v is None or s else -v for v, s in zip(vs, signs, strict=True)]) for g, i, *vs in pts]
    goals = {i: (g, [v if s else -v for v, s in zip(vs, signs, strict=True)]) for g, i, *vs in pts if i < 900}
    beaten = lambda g, v: any(h == g and w != v and all(x >= y for x, y in zip(w, v, strict=True)) for h, w in goals.values())
    df = spark.createDataFrame(pts, "g string, id long, " + ", ".join(f"x{i} double" for i in range(d))).repartition(3)
    front = C.pareto_front_nd(df, ["g"], [f"x{i}" for i in range(d)], signs, cap)
    assert front.columns == df.columns and {r.id for r in front.collect()} == {i for i, (g, v) in goals.items() if not beaten(g, v)}
    assert C.pareto_front_nd(df.limit(0), [], [f"x{i}" for i in range(d)]).count() == 0


@pytest.mark.parametrize("cap", [8, None])
def test_front_and_contributions(spark, cap):
    rng = random.Random(7)
    pts = [("a" if i % 5 else "b", i, float(rng.randint(0, 15)), float(rng.randint(0, 15))) for i in range(80)]
    df = spark.createDataFrame(pts, "g string, id long, x double, y double")

    def dominated(p):
        return any(q[0] == p[0] and q[2] >= p[2] and q[3] >= p[3] and (q[2] > p[2] or q[3] > p[3]) for q in pts)

    front = {r.id for r in C.pareto_front(df, ["g"], "x", "y", cap=cap).collect()}
    assert front == {p[1] for p in pts if not dominated(p)}
    got = {r.id: r.hv_contribution for r in C.hv_contribution(df, ["g"], "x", "y", "id", cap).collect()}

    def strips(items, ref):
        total, prev = 0.0, ref[0]
        for p in sorted(items, key=lambda p: (-p[2], p[1])):
            total += (prev - p[2]) * (ref[1] - p[3])
            prev = p[2]
        return total

    for g in "ab":
        mine = [p for p in pts if p[0] == g]
        ref = (min(p[2] for p in mine) - 1, min(p[3] for p in mine) - 1)
        whole = strips(mine, ref)
        for p in mine:
            assert math.isclose(got[p[1]], max(0.0, whole - strips([q for q in mine if q is not p], ref)), abs_tol=1e-9)


def test_hypervolume_of_known_front(spark):
    df = spark.createDataFrame([("r", 1, 1.0, 3.0), ("r", 1, 2.0, 2.0), ("r", 1, 3.0, 3.0), ("r", 2, 0.0, 0.0)], "r string, gen int, x double, y double")
    got = {x.gen: x.hypervolume for x in C.hypervolume_2d(df, ["r"], "gen", "x", "y").collect()}
    rx, ry = 3.0 + 0.15, 3.0 + 0.15
    assert math.isclose(got[1], (2 - 1) * (ry - 3) + (rx - 2) * (ry - 2)) and math.isclose(got[2], rx * ry)


def test_batches_fall_back_to_the_mean(spark):
    df = spark.createDataFrame([(1, -1.0, 5.0, 0.0), (2, -2.0, 9.0, 3.0), (3, 0.0, 7.0, 2.0)], "id int, ei double, mean double, hv_contribution double")
    assert [r.id for r in C.select_batch(df, "EI", 2, "id").orderBy("position").collect()] == [2, 3]
    both = C.select_batch(df, "hybrid", 2, "id", k=1)
    assert [(r.list, r.id) for r in both.orderBy("list").collect()] == [("EI", 2), ("HV", 2)]


def test_latin_hypercube_has_one_point_per_stratum(spark):
    df = D.latin_hypercube(spark.range(50), "id", {"a": (0.0, 1.0), "b": (10.0, 20.0)}, seed=1, cap=9).toPandas()
    assert sorted((df.a * 50).astype(int)) == list(range(50)) and sorted(((df.b - 10) * 5).astype(int)) == list(range(50))
    assert abs(np.corrcoef(df.a, df.b)[0, 1]) < 0.5


def test_splits_respect_their_condition(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 41)) for i in range(40)], "id int, v double")
    got = D.constrained_splits(df, "id", "v", 30, 12, 3).toPandas()
    assert got.split.nunique() == 30
    with pytest.raises(ValueError):
        D.constrained_splits(df.limit(12), "id", "v", 3, 12, 3)
    for _, s in got.groupby("split"):
        top = s[s.part == "train"].v.max()
        assert (s[s.part == "test_below"].v < top).all() and (s[s.part == "test_above"].v >= top).all()
        assert s.part.value_counts().to_dict() == {"train": 12, "test_below": 3, "test_above": 3} and s.id.is_unique


def test_diversity_ignores_order_and_odd_batches(spark):
    pts = [("a", [0.0, 0.0]), ("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("b", [1.0, 1.0])]
    for rows in (pts, pts[::-1]):
        got = N.batch_diversity(spark.createDataFrame(rows, "b string, x array<double>"), ["b"], "x", 3).collect()
        assert len(got) == 1 and math.isclose(got[0].diversity, (1 + 2 + math.sqrt(5)) / 3)


def _mixed_number(seed, parts, below):
    def mix(h):
        for k, x in zip(D.MIX_FACTORS, parts, strict=False):
            h = (h * k + x) % D.MIX_PRIME
        for k in D.MIX_FACTORS:
            h = (h ^ (h >> 15)) * k % D.MIX_PRIME
        return h

    return (mix(2 * seed) * 2**31 + mix(2 * seed + 1)) % below


@pytest.mark.parametrize("block", [3, 4096])
def test_bootstrap_equals_explicit_resampling(spark, block):
    rng = np.random.default_rng(3)
    data = [(u, float(a), float(b)) for u in range(11) for a, b in rng.random((u % 3 + 1, 2))]
    df = spark.createDataFrame([*data, (0, None, 1.0), (99, 1.0, None)], "u int, y double, p double")
    got = {r.replicate: r for r in D.bootstrap_metrics(df, ["u"], "y", "p", 6, seed=5, cap=3, block=block).collect()}
    assert sorted(got) == list(range(6))
    for b in range(6):
        blocks = [_mixed_number(5, [b, i], 11) // block if block < 11 else 0 for i in range(11)]
        picks = [k * block + _mixed_number(6, [b, k, blocks[:i].count(k)], min(block, 11 - k * block)) for i, k in enumerate(blocks)]
        rows = [r for u in picks for r in data if r[0] == u]
        e = np.array([r[1] - r[2] for r in rows])
        assert math.isclose(got[b].rmse, math.sqrt((e**2).mean())) and got[b].unique_units == len(set(picks))
    assert D.bootstrap_metrics(df.limit(0), ["u"], "y", "p", 6).count() == 0


def test_draws_are_even(spark):
    """Counts of units over many replicates follow the binomial law of independent even draws."""
    n, reps = 10, 4000
    at = D._of_columns(3, [F.col("id") % reps, F.floor(F.col("id") / reps)], n)
    counts = spark.range(n * reps).select((F.col("id") % reps).alias("r"), at.alias("u")).groupBy("r", "u").count().collect()
    per_unit = np.bincount([c.u for c in counts], [c["count"] for c in counts], n)
    assert abs(per_unit - reps).max() < 5 * math.sqrt(reps)
    unseen = 1 - len(counts) / (n * reps)
    assert abs(unseen - 0.9**n) < 0.01


def test_intervals_at_zero_and_unseen_times(spark):
    train = spark.createDataFrame([(0.0, 9.0, 1.0), (1.0, 3.0, 1.0), (1.0, 5.0, 1.0), (2.0, 1.0, 1.0)], "t double, y double, p double")
    test = spark.createDataFrame([(0.0, 1.0, 1.0), (1.0, 4.0, 1.0), (2.0, 1.0, 1.0), (7.0, 2.0, 1.0)], "t double, y double, p double")
    got = {r.t: r for r in A.residual_intervals(train, test, "t", "y", "p").collect()}
    assert (got[0.0].low, got[0.0].high, got[0.0].residual_sd) == (1.0, 1.0, 0.0)
    assert math.isclose(got[1.0].mid, 4.0) and got[2.0].residual_sd == 0.0 and math.isclose(got[7.0].residual_mean, 2.0)


def test_normal_distribution(spark):
    zs = [-40.0, -8.0, -1.5, 0.0, 0.3, 7.2, 9.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(norm_cdf("z")).collect()]
    assert np.allclose(got, [0.5 * math.erfc(-z / math.sqrt(2)) for z in zs], atol=1e-15)


def test_gp_matches_direct_solution(spark):
    rng = np.random.default_rng(6)
    xs, ys, q = rng.random((8, 2)), rng.random(8), rng.random((5, 2))
    train = spark.createDataFrame([(x.tolist(), float(y)) for x, y in zip(xs, ys)], "x array<double>, y double")
    cand = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "id int, x array<double>")
    got = sorted(M.gp_score(cand, train, "x", "y", 1.2, [0.7, 0.9], 0.1, 0.05, 0.01).collect())
    z, zq, t = (xs - xs.mean(0)) / xs.std(0), (q - xs.mean(0)) / xs.std(0), (ys - ys.mean()) / ys.std()

    def k(a, b):
        d = ((a[:, None] - b[None]) ** 2 / np.array([0.7, 0.9])).sum(2)
        return 1.2 * np.exp(-0.5 * d) + 0.1 + 0.05 * a @ b.T

    big = k(z, z) + 0.01 * np.eye(8)
    mean = k(zq, z) @ np.linalg.solve(big, t) * ys.std() + ys.mean()
    var = np.diag(k(zq, zq)) + 0.01 - np.einsum("ij,ji->i", k(zq, z), np.linalg.solve(big, k(z, zq)))
    assert np.allclose([r.gp_mean for r in got], mean) and np.allclose([r.gp_sd for r in got], np.sqrt(var) * ys.std())


def test_ridge_and_surface_match_normal_equations(spark):
    rng = np.random.default_rng(8)
    x = rng.random((40, 2))
    y = 3 + x @ [2.0, -1.0] + 0.5 * x[:, 0] * x[:, 1] + rng.normal(0, 0.1, 40)
    df = spark.createDataFrame([(float(a), float(b), float(t)) for (a, b), t in zip(x, y)], "a double, b double, y double")

    def direct(f):
        z = (f - f.mean(0)) / f.std(0)
        w = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ (y - y.mean()))
        return np.sort(y.mean() + z @ w)

    got = M.linear_predict(df, M.ridge_fit(df, ["a", "b"], "y")).toPandas().pred
    assert np.allclose(np.sort(got), direct(x))
    surface = np.c_[x, x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2]
    assert np.allclose(np.sort(M.linear_predict(df, M.rsm2_fit(df, ["a", "b"], "y")).toPandas().pred), direct(surface))


def test_sobol_of_additive_model(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((4000, 2)), rng.random((4000, 2))
    f = lambda x: 3 * x[:, 0] + x[:, 1]
    mix = lambda p, q, i: np.where(np.arange(2) == i, q, p)
    cols = np.c_[f(a), f(b), f(mix(a, b, 0)), f(mix(a, b, 1)), f(mix(b, a, 0)), f(mix(b, a, 1))]
    df = spark.createDataFrame(cols.tolist(), "ya double, yb double, ab1 double, ab2 double, ba1 double, ba2 double")
    got = {(r.order, r.term): r.value for r in D.sobol_indices(df, "ya", "yb", ["ab1", "ab2"], ["ba1", "ba2"]).collect()}
    assert abs(got["first", "1"] - 0.9) < 0.05 and abs(got["total", "2"] - 0.1) < 0.05 and abs(got["second", "1,2"]) < 0.05


# ---- streams: shuffled replay over several files equals the batch operators --------------------------
def test_streams_equal_batch(spark):
    J.use_rocksdb(spark)
    rng = random.Random(11)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(f"e{i % 6}", t0 + datetime.timedelta(minutes=10 * i), i, rng.random(), rng.random() * 50) for i in range(240)]
    path = scratch_path(spark, "replay")
    schema = "k string, ts timestamp, seq long, poe double, value double"
    for part in range(4):  # in each file the rows are out of order
        chunk = rows[part * 60:(part + 1) * 60]
        rng.shuffle(chunk)
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.schema(schema).parquet(path)
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.key: (r.seq, r.position) for r in J.run_available(J.early_stop_stream(source(), "k", "ts", "seq", "poe", 0.1, "12 hours"), "stop").collect()}
    want = {}
    for k, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1])), key=lambda r: r[0]):
        horizon = max(r[1] for r in rows) - datetime.timedelta(hours=12)
        # only the part of the series behind the watermark is decided
        hit = next(((r[2], i) for i, r in enumerate(group) if r[3] < 0.1), None)
        if hit and t0 + datetime.timedelta(minutes=10 * hit[0]) < horizon:
            want[k] = hit
    assert len(want) == 6 and got == want
    inc = J.run_available(J.incumbent_stream(source(), "k", "ts", "seq", "value"), "inc", "update")
    last = {r.key: r.best for r in inc.groupBy("key").agg(F.max_by("best", "batch_id").alias("best")).collect()}
    run = ordered(batch, ["k"], ["ts"]).running(best=("max", F.col("value"))).done()
    assert last == {r.k: r.m for r in run.groupBy("k").agg(F.max("best").alias("m")).collect()}
    keys = J.run_available(J.pending_stream(source(), {"key": F.upper("k")}, "ts", F.col("value") > 5, "9 days"), "pend")
    assert sorted(r.key for r in keys.collect()) == sorted({r[0].upper() for r in rows if r[4] > 5})


def _arriving(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_incumbents_of_rows_out_of_order(spark):
    """Rows dealt over five files at random, ties in time and value, missing values: as if they had come in order."""
    J.use_rocksdb(spark)
    rng = random.Random(8)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(f"k{rng.randrange(3)}", t0 + datetime.timedelta(minutes=rng.randrange(60)), i, float(rng.randrange(30)) if rng.random() < 0.9 else None) for i in range(150)]
    rows.append(("empty", t0, 999, None))
    path, schema = scratch_path(spark, "arriving"), "k string, ts timestamp, seq long, value double"
    dealt = rng.sample(rows, len(rows))
    for i in range(5):
        _arriving(spark, path, dealt[i::5], schema)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = J.run_available(J.incumbent_stream(source, "k", "ts", "seq", "value"), "inc", "update")
    got = {r.key: tuple(r.s) for r in out.groupBy("key").agg(F.max_by(F.struct("best", "improvements", "rows"), "batch_id").alias("s")).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        best, n, seen = None, 0, 0
        for _, _, _, v in sorted((r for r in rows if r[0] == k and r[3] is not None), key=lambda r: (r[1], r[2])):
            seen += 1
            if best is None or v > best:
                best, n = v, n + 1
        want[k] = (best, n, seen)
    assert got == want


def test_a_stopped_job_takes_up_where_it_ended(spark):
    J.use_rocksdb(spark)
    t0 = datetime.datetime(2024, 1, 1)
    path, at, schema = scratch_path(spark, "arriving"), scratch_path(spark, "resumed"), "k string, ts timestamp"
    run = lambda: J.run_counted(J.pending_stream(spark.readStream.schema(schema).parquet(path), {"key": F.col("k")}, "ts", F.lit(True), "9 days"), "once", at=at)
    _arriving(spark, path, [(f"k{i}", t0) for i in (1, 2, 2, 3)], schema)
    assert sorted(r.key for r in run()[0].collect()) == ["k1", "k2", "k3"]
    again, progress = run()  # nothing new
    assert again.count() == 3 and not progress.filter("input_rows > 0").count()
    _arriving(spark, path, [(f"k{i}", t0) for i in (3, 4, 1, 5, 5)], schema)
    table, progress = run()
    assert sorted(r.key for r in table.collect()) == ["k1", "k2", "k3", "k4", "k5"] and progress.agg(F.sum("input_rows")).first()[0] == 5


def test_a_batch_that_runs_again_replaces_its_rows(spark):
    """The state of the last batch is lost after its rows were written: the next run does it again."""
    import os
    import shutil

    J.use_rocksdb(spark)
    t0 = datetime.datetime(2024, 1, 1)
    path, at, schema = scratch_path(spark, "arriving"), scratch_path(spark, "resumed"), "k string, ts timestamp, seq long, value double"
    run = lambda: J.run_available(J.incumbent_stream(spark.readStream.schema(schema).parquet(path), "k", "ts", "seq", "value"), "inc", "update", at)
    _arriving(spark, path, [("a", t0, 1, 1.0), ("b", t0, 2, 5.0)], schema)
    run()
    _arriving(spark, path, [("a", t0, 3, 2.0)], schema)
    before = sorted(map(tuple, run().collect()))
    commits = f"{at}/inc-state/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        shutil.move(f"{commits}/{name}", f"{at}/uncommitted{name}")
    assert sorted(map(tuple, run().collect())) == before and len(before) == 3


def test_stream_queries_read_tables_of_many_files(spark, sf_dir, tmp_path):
    from trialframe.catalog import QUERIES

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("early_stop_stream", "curve_metrics_stream", "pending_stream", "incumbent_stream"):
        key = lambda d: sorted(map(str, d.collect()))
        assert key(QUERIES[name](spark, str(tmp_path))) == key(QUERIES[name](spark, sf_dir))


def test_splits_are_dealt_by_rows_times_attempts(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i * 37 % 101)) for i in range(200)], "id long, v double").coalesce(1)
    want = sorted(map(tuple, D.constrained_splits(df, "id", "v", 4, 5, 2).collect()))
    dealt, drawn = [], D._drawn_splits

    def counted(rows, *rest):
        dealt.append(rows.rdd.getNumPartitions())
        return drawn(rows, *rest)

    monkeypatch.setattr(D, "_drawn_splits", counted)
    monkeypatch.setattr(D, "ORDERED_AT_ONCE", 100)
    assert sorted(map(tuple, D.constrained_splits(df, "id", "v", 4, 5, 2).collect())) == want
    assert dealt[0] == 8  # 200 rows for 4 splits


def test_large_parts_come_in_files_of_one_batch(spark, tmp_path, monkeypatch):
    from trialframe.catalog import streams

    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i * 7 % 90), i % 4, "a", float(i * 31 % 17), None) for i in range(90)]
    spark.createDataFrame(rows, streams.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    names = ["incumbent_stream_of_late_files", "late_rows_by_batch"]
    want = [sorted(map(tuple, getattr(streams, n)(spark, str(tmp_path)).collect())) for n in names]
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    assert list(streams._in_three(spark, str(tmp_path), f"{tmp_path}/parts")) == [3, 3, 3]
    assert [len(list((tmp_path / "parts" / str(n)).glob("*.parquet"))) for n in range(3)] == [3, 3, 3]
    assert [sorted(map(tuple, getattr(streams, n)(spark, str(tmp_path)).collect())) for n in names] == want


def test_first_stop_asks_for_state_once_a_call():
    class State:
        def __init__(self, value):
            self.value, self.calls = value, 0

        def get(self):
            self.calls += 1
            return iter(self.value) if isinstance(self.value, list) else self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def appendList(self, rows):
            self.calls, self.value = self.calls + 1, self.value + rows

    p, timers = J._FirstStop(0.1), []
    p.progress, p.waiting = State(None), State([])
    p.handle = type("H", (), {"registerTimer": lambda _, ms: timers.append(ms)})()
    batch = pd.DataFrame({"us": [5_000, 2_000, 9_000], "seq": [1, 2, 3], "poe": [0.05, 0.5, 0.01]})
    assert list(p.handleInputRows(("k",), iter([batch.iloc[:1], batch.iloc[1:]]), None)) == []
    assert p.waiting.value == [(5_000, 1, 0.05), (2_000, 2, 0.5)] and timers == [3]
    assert p.progress.value == (0, False, 5_000) and (p.progress.calls, p.waiting.calls) == (2, 1)
