"""Experimental designs: splits, Latin hypercubes, grids, one-factor plans, thresholds, sensitivity."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import join_on, ordered
from ..plans.ranks import top_rows
from ..plans.stage import staged
from .candidates import hash_number, hash_text
from .corpus import pending

MAX_ATTEMPTS = 1024

# sufficient statistics of a unit: rows, squared and absolute error, observation and its square about the mean
STATS = ["c", "s2", "s1", "sy", "syy"]
# multipliers modulo a Mersenne prime: a product of two numbers stays below 2 ** 62
MIX_PRIME, MIX_FACTORS = 2**31 - 1, (48271, 69621, 40692, 1583458089)
DRAWS_AT_ONCE = 1_000_000
# rows times attempts a task puts in order
ORDERED_AT_ONCE = 500_000


def constrained_splits(
    df: DataFrame, ident: str, value: str, n_splits: int, n_train: int, n_side: int, seed: int = 0, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Random train/test splits whose test part has ``n_side`` rows below and at or above the train maximum.

    Draws are hash orders, numbered by attempt; each split keeps its first attempt that satisfies the condition. Attempts
    are made in doubling batches for the splits still open, ``max_attempts`` at most; a condition that none of them meets
    is an error. Only ``n_train`` and ``2 n_side`` rows per attempt pass the pruned top-k steps. Rows are dealt to tasks by rows
    times attempts, so what a task sorts doesn't grow with the table.
    """
    spark, slim = df.sparkSession, staged(df.select(ident, value), "split-rows")
    n = slim.count()
    open_splits, first, batch, found = list(range(n_splits)), 0, 1, []
    while open_splits:
        if first >= max_attempts:
            raise ValueError(f"no valid draw in {first} attempts for {len(open_splits)} of {n_splits} splits")
        names = [(s, a) for s in open_splits for a in range(first, first + batch)]
        tries, spread = spark.createDataFrame(names, "split int, attempt int"), slim.repartition(max(1, ceil(n * len(names) / ORDERED_AT_ONCE)))
        drawn = staged(_drawn_splits(spread, tries, ident, value, n_train, n_side, seed), "splits")
        firsts = {r["split"]: r["attempt"] for r in drawn.groupBy("split").agg(F.min("attempt").alias("attempt")).collect()}  # a row per split
        kept = F.broadcast(spark.createDataFrame(list(firsts.items()), "split int, attempt int"))
        found.append(drawn.join(kept, ["split", "attempt"], "left_semi"))
        open_splits = [s for s in open_splits if s not in firsts]
        first, batch = first + batch, min(2 * batch, max_attempts - first - batch)
    return reduce(DataFrame.unionByName, found).drop("attempt")


def _drawn_splits(rows: DataFrame, tries: DataFrame, ident: str, value: str, n_train: int, n_side: int, seed: int) -> DataFrame:
    """The valid ones of ``tries`` (split, attempt): split, attempt, id, value and part."""
    key = ["split", "attempt"]
    pairs = tries.agg(F.collect_list(F.struct(*key)).alias("t"))
    rows = rows.withColumn("__t", pairs.scalar()).withColumn("__t", F.explode("__t")).select(ident, value, "__t.split", "__t.attempt")
    name = F.when(F.col("attempt") == 0, F.col("split").cast("string")).otherwise(F.concat_ws("/", "split", "attempt"))
    rows = rows.withColumn("__h", hash_text(seed, name, F.col(ident)))
    train = top_rows(rows, key, ["__h", ident], n_train, "__r").drop("__r")
    cuts = train.groupBy(*key).agg(F.max(value).alias("__top"), F.max(F.struct("__h", ident)).alias("__last"))
    test = rows.join(F.broadcast(cuts), key).filter(F.struct("__h", ident) > F.col("__last"))  # a row per attempt
    side = F.when(F.col(value) < F.col("__top"), "below").otherwise("above")
    picked = top_rows(test.withColumn("side", side), [*key, "side"], ["__h", ident], n_side, "__r")
    full = picked.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == 2 * n_side).select(*key)
    kept = train.select(*key, ident, value, F.lit("train").alias("part")).unionByName(
        picked.select(*key, ident, value, F.concat(F.lit("test_"), "side").alias("part"))
    )
    return kept.join(full, key, "left_semi")


def latin_hypercube(
    ids: DataFrame, ident: str, bounds: dict[str, tuple[float, float]], seed: int = 0, cap: int | None = None
) -> DataFrame:
    """One point per row of ``ids`` with exactly one point in each of the n strata of every axis.

    Each axis has its own permutation: the rank of a hash, computed without gathering the points.
    """
    out = ids.select(ident)
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    for i, (axis, (lo, hi)) in enumerate(bounds.items()):
        text = hash_text(seed, F.lit(i), F.col(ident))
        keyed = out.withColumns({"__k": hash_number(text), "__u": hash_number(F.reverse(text), 8) / F.lit(16.0**8)})
        o = ordered(keyed, [], ["__k", ident], cap).index("__i").done().withColumn("__n", n)
        point = lo + (F.col("__i") - 1 + F.col("__u")) / F.col("__n") * (hi - lo)
        out = o.withColumn(axis, point).drop("__k", "__u", "__i", "__n")
    return out


def design_grid(bounds: DataFrame, axes: list[str], n: int, times: list[float] | None = None) -> DataFrame:
    """Evenly spaced product grid between ``lo_<axis>`` and ``hi_<axis>`` of every bounds row.

    Each axis is unfolded in place; scaled copies and a boundary flag are added.
    """
    out = bounds
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    for a in axes:
        out = out.withColumn(f"__i_{a}", F.explode(steps))
    scaled = {f"{a}_scaled": F.col(f"__i_{a}") / float(n - 1) for a in axes}
    out = out.withColumns(scaled)
    out = out.withColumns({a: F.col(f"lo_{a}") + F.col(f"{a}_scaled") * (F.col(f"hi_{a}") - F.col(f"lo_{a}")) for a in axes})
    edge = F.lit(False)
    place = F.lit(0)
    for a in axes:
        edge = edge | F.col(f"__i_{a}").isin(0, n - 1)
        place = place * n + F.col(f"__i_{a}")
    out = out.withColumns({"is_boundary": edge, "grid_id": place})
    if times is not None:
        out = out.withColumn("time_h", F.explode(F.array(*[F.lit(float(t)) for t in times])))
    drop = [f"__i_{a}" for a in axes] + [f"{s}_{a}" for a in axes for s in ("lo", "hi")]
    return out.drop(*drop)


def oat_plan(
    baseline: DataFrame, levels: dict[str, list], repeats: int, seed: int = 0, finished: DataFrame | None = None
) -> DataFrame:
    """The baseline and its one-factor variants, repeated with consecutive seeds, less finished runs."""
    cast = lambda v: F.lit(v).cast("double")
    none = F.struct(F.lit("baseline").alias("factor"), cast(None).alias("level"))
    variants = [F.struct(F.lit(f).alias("factor"), cast(v).alias("level")) for f, vs in levels.items() for v in vs]
    rows = baseline.withColumn("__v", F.explode(F.array(none, *variants)))
    own = {f: F.when(F.col("__v.factor") == f, F.col("__v.level")).otherwise(F.col(f).cast("double")) for f in levels}
    rows = rows.withColumns({**own, "factor": F.col("__v.factor")}).drop("__v")
    rows = rows.withColumn("seed", F.explode(F.sequence(F.lit(seed), F.lit(seed + repeats - 1))))
    if finished is None:
        return rows
    keys = {k: F.col(k) for k in [*levels, "seed"]}
    return pending(rows, finished, keys, error="error" if "error" in finished.columns else None)


def threshold_sweep(
    df: DataFrame, split: str, item: str, step: str, poe: str, outcome: str, best: str, thresholds: list[float],
    cap: int | None = None,
) -> DataFrame:
    """Average accuracy, error and lead rates of early stopping per threshold over the splits.

    Type I: stopped although the outcome exceeds the best. Type II: run to the end although it does not.
    Lead rate: share of planned points not sampled, over correctly stopped runs. One pass over the
    series serves all thresholds.
    """
    o = ordered(df, [split, item], [step], cap).index("__i")
    stops = [F.min(F.when(F.col(poe) < t, F.col("__i"))) for t in thresholds]
    per = o.df.groupBy(split, item).agg(
        F.count(F.lit(1)).alias("__n"), (F.max(outcome) > F.max(best)).alias("__good"),
        F.array(*[F.struct(F.lit(float(t)).alias("t"), s.alias("s")) for t, s in zip(thresholds, stops)]).alias("__a"),
    )
    tall = per.withColumn("__e", F.explode("__a"))
    stopped, good = F.col("__e.s").isNotNull(), F.col("__good")
    right = stopped & ~good
    lead = F.when(right, (F.col("__n") - F.col("__e.s") + 1) / F.col("__n"))
    rate = lambda c: F.avg(c.cast("double"))
    each = tall.groupBy(split, F.col("__e.t").alias("threshold")).agg(
        rate(stopped != good).alias("accuracy"), rate(stopped & good).alias("type1"), rate(~stopped & ~good).alias("type2"),
        F.avg(lead).alias("lead_rate"),
    )
    return each.groupBy("threshold").agg(
        *[F.avg(c).alias(c) for c in ("accuracy", "type1", "type2", "lead_rate")], F.count(F.lit(1)).alias("splits")
    )


def choose_threshold(sweep: DataFrame) -> DataFrame:
    """Accuracy first, then type I, type II and lead rate."""
    order = [F.desc("accuracy"), F.asc("type1"), F.asc("type2"), F.desc_nulls_last("lead_rate"), F.asc("threshold")]
    return sweep.orderBy(*order).limit(1)


def sobol_indices(df: DataFrame, y_a: str, y_b: str, y_ab: list[str], y_ba: list[str]) -> DataFrame:
    """First, total and second order indices from evaluated A, B, AB_i and BA_i columns.

    Published estimators (Saltelli 2010 first and second order, Jansen 1999 total) on centred outputs.
    """
    every = [y_a, y_b, *y_ab, *y_ba]
    mean = df.agg((sum((F.avg(c) for c in every[1:]), F.avg(every[0])) / float(len(every))).alias("m")).scalar()
    c = df.select(*every).withColumn("__m", mean).select(*[(F.col(v) - F.col("__m")).alias(v) for v in every])
    a, b = F.col(y_a), F.col(y_b)
    both = (F.avg(a * a) + F.avg(b * b)) / 2.0 - F.pow((F.avg(a) + F.avg(b)) / 2.0, F.lit(2.0))
    n = len(y_ab)
    aggs = [both.alias("__var")]
    for i in range(n):
        ab = F.col(y_ab[i])
        aggs += [F.avg(b * (ab - a)).alias(f"__s{i}"), (F.avg((a - ab) * (a - ab)) / 2.0).alias(f"__t{i}")]
    for i, j in combinations(range(n), 2):
        aggs.append(F.avg(F.col(y_ba[i]) * F.col(y_ab[j]) - a * b).alias(f"__p{i}_{j}"))
    g = c.agg(*aggs)
    v = F.col("__var")
    entries = []
    for i in range(n):
        entries.append(F.struct(F.lit("first").alias("order"), F.lit(str(i + 1)).alias("term"), (F.col(f"__s{i}") / v).alias("value")))
        entries.append(F.struct(F.lit("total").alias("order"), F.lit(str(i + 1)).alias("term"), (F.col(f"__t{i}") / v).alias("value")))
    for i, j in combinations(range(n), 2):
        second = (F.col(f"__p{i}_{j}") - F.col(f"__s{i}") - F.col(f"__s{j}")) / v
        entries.append(F.struct(F.lit("second").alias("order"), F.lit(f"{i + 1},{j + 1}").alias("term"), second.alias("value")))
    return g.select(F.inline(F.array(*entries)))


def main_effects(df: DataFrame, axes: list[str], y: str, n_bins: int = 20) -> DataFrame:
    """Mean outcome per equal-width bin of each axis; the axis maximum falls past the last bin."""
    wide = df.select(*[F.col(a).cast("double").alias(a) for a in axes], y)
    bounds = wide.agg(F.array(*[F.struct(F.min(a).alias("lo"), F.max(a).alias("hi")) for a in axes]).alias("b")).scalar()
    each = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("x"), F.lit(i).alias("i")) for i, a in enumerate(axes)])
    j = wide.withColumn("__b", bounds).select(y, F.inline(each), "__b").select(y, "axis", "x", F.get("__b", F.col("i")).alias("__b"))
    j = j.select(y, "axis", "x", "__b.lo", "__b.hi")
    width = (F.col("hi") - F.col("lo")) / float(n_bins)
    at = F.floor((F.col("x") - F.col("lo")) / width)
    rows = j.filter((F.col("hi") > F.col("lo")) & (F.col("x") < F.col("hi"))).withColumns({"bin": at, "center": F.col("lo") + (at + 0.5) * width})
    return rows.groupBy("axis", "bin", "center").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("effect"))


def dense_units(df: DataFrame, unit: list[str], cap: int | None = None) -> DataFrame:
    """Units numbered 0..n-1 in their order."""
    units = df.select(*unit).distinct()
    return ordered(units, [], unit, cap).index("__u").done().withColumn("__u", F.col("__u") - 1)


def _mixed(parts: list, xor, half):
    """A number below 2 ** 31 - 1 mixed from whole numbers; the same steps on Columns and on numpy arrays."""
    h = parts[0] % MIX_PRIME
    for factor, part in zip(MIX_FACTORS, parts[1:], strict=False):
        h = (h * factor + part % MIX_PRIME) % MIX_PRIME
    for factor in MIX_FACTORS:
        h = xor(h, half(h)) * factor % MIX_PRIME
    return h


def _drawn(seed: int, parts: list, below, one, xor, half):
    """A number from 0 to ``below`` - 1 by 62 mixed bits of seed and ``parts``."""
    high, low = (_mixed([one * (2 * seed + i), *parts], xor, half) for i in (0, 1))
    return (high * 2**31 + low) % below


def _of_columns(seed: int, parts: list[Column], below: int) -> Column:
    return _drawn(seed, parts, F.lit(below).cast("long"), F.lit(1).cast("long"), lambda a, b: a.bitwiseXOR(b), lambda h: F.shiftright(h, 15))


def _block_sums(seed: int):
    """Per replicate, the sums of the units of one block that its draws take there."""

    def run(units: pd.DataFrame, draws: pd.DataFrame) -> pd.DataFrame:
        if not len(draws):  # a block that no replicate draws from
            return pd.DataFrame([], columns=["replicate", "unique_units", *STATS])
        stats = units.sort_values("__u")[STATS].to_numpy()
        block, m, out = int(draws["__block"].iloc[0]), len(units), []
        for replicate, n in zip(draws["replicate"], draws["__n"], strict=True):
            taken = np.zeros(m, dtype=np.int64)
            for at in range(0, n, DRAWS_AT_ONCE):
                j = np.arange(at, min(n, at + DRAWS_AT_ONCE), dtype=np.int64)
                same = lambda v, j=j: np.full(len(j), v, dtype=np.int64)
                taken += np.bincount(_drawn(seed + 1, [same(replicate), same(block), j], m, same(1), np.bitwise_xor, lambda h: h >> 15), minlength=m)
            out.append((replicate, int((taken > 0).sum()), *(taken @ stats)))
        return pd.DataFrame(out, columns=["replicate", "unique_units", *STATS])

    return run


def bootstrap_metrics(
    df: DataFrame, unit: list[str], obs: str, pred: str, replicates: int, seed: int = 0, cap: int | None = None, block: int = 4096
) -> DataFrame:
    """Metrics of each bootstrap replicate, whole units drawn with replacement.

    Units are reduced to sufficient statistics, numbered, and cut into blocks of ``block``. A replicate has as many draws as
    there are units, and each is made in two steps: the block it falls into, each with its share of the units, then a unit
    inside the block. The first step counts draws per replicate and block before any shuffle; the second runs where the
    block's units are. What moves is the units once, and a row per replicate and block; with one block the first step is
    not needed. Draws are mixed from seed, replicate and number, so a lost executor's are made again as they were.
    """
    y, e = F.col(obs), F.col(obs) - F.col(pred)
    known = df.filter(y.isNotNull() & F.col(pred).isNotNull())
    centred = known.withColumn("__mid", known.agg(F.avg(y).alias("m")).scalar())
    d = y - F.col("__mid")  # sums about the overall mean keep their digits
    stats = centred.groupBy(*unit).agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum(e * e).alias("s2"), F.sum(F.abs(e)).alias("s1"), F.sum(d).alias("sy"), F.sum(d * d).alias("syy")
    )
    units = ordered(stats, [], unit, cap).index("__u").done().withColumn("__u", F.col("__u") - 1)
    units = staged(units.select("__u", F.floor(F.col("__u") / block).alias("__block"), *STATS), "units")
    n = units.count()
    spark = df.sparkSession
    if n <= block:
        draws = spark.range(replicates).select(F.col("id").alias("replicate"), F.lit(0).cast("long").alias("__block"), F.lit(n).cast("long").alias("__n")).filter("__n > 0")
    else:
        each = spark.range(replicates * n).select(F.expr(f"id div {n}").alias("replicate"), (F.col("id") % n).alias("__i"))
        at = _of_columns(seed, [F.col("replicate"), F.col("__i")], n)
        draws = each.select("replicate", F.floor(at / block).alias("__block")).groupBy("replicate", "__block").agg(F.count(F.lit(1)).alias("__n"))
    schema = "replicate long, unique_units long, " + ", ".join(f"{c} double" for c in STATS)
    parts = units.groupBy("__block").cogroup(draws.groupBy("__block")).applyInPandas(_block_sums(seed), schema)
    rows = parts.groupBy("replicate").agg(F.sum("unique_units").alias("unique_units"), *[F.sum(c).alias(f"__{c}") for c in STATS])
    tot = F.col("__syy") - F.col("__sy") * F.col("__sy") / F.col("__c")
    return rows.select(
        F.col("replicate").cast("int").alias("replicate"), "unique_units", F.sqrt(F.col("__s2") / F.col("__c")).alias("rmse"), (F.col("__s1") / F.col("__c")).alias("mae"),
        F.when(tot > 0, 1.0 - F.col("__s2") / tot).alias("r2"),
    )


def bootstrap_summary(reps: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, deviation and 95 % percentile range of each metric over the replicates."""
    from ..plans.ranks import percentiles

    tall = reps.unpivot([], metrics, "metric", "value")
    basic = (F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return percentiles(tall, ["metric"], "value", {"p2_5": 0.025, "p50": 0.5, "p97_5": 0.975}, also=basic)
