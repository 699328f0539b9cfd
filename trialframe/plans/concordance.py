"""Counting agreeing and disagreeing pairs without forming pairs.

Equal (x, y) points are merged into weights first. Tied pairs follow from the weights alone. The
number of pairs rising in both coordinates is counted by sorted merging inside groups (or inside
x-ranges and y-ranges of oversized groups), plus the same count over the grid of range totals, which
is a smaller problem of the same kind. Work is O(n log n); no group and no pair list is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import join_on, ordered
from .stage import staged

TASK_POINTS = 2_000_000
PAIRS = "decimal(38,0)"  # pair counts exceed 64 bits for groups of some billion rows


def rising_weights(group: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per point, its weight times the weight of points of its group strictly below in x and y."""
    n = len(x)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    # later groups rank below earlier ones in y, so points of different groups never count
    y_rank = np.empty(n, dtype=np.int64)
    by_y = np.lexsort((y, -group))
    y_sorted, g_sorted = y[by_y], group[by_y]
    fresh = np.r_[True, (y_sorted[1:] != y_sorted[:-1]) | (g_sorted[1:] != g_sorted[:-1])]
    y_rank[by_y] = np.cumsum(fresh)
    start = np.lexsort((-y_rank, x, group))
    rank, weight = y_rank[start], w[start].astype(np.int64)
    place = np.arange(n)
    below = np.zeros(n, dtype=np.int64)
    span = 1
    while span < n:
        block, right = place // (2 * span), (place // span) & 1
        by_block = np.lexsort((1 - right, rank, block))
        left_mass = np.where(right[by_block] == 0, weight[by_block], 0)
        seen = np.cumsum(left_mass)
        first = np.r_[True, block[by_block][1:] != block[by_block][:-1]]
        base = np.maximum.accumulate(np.where(first, seen - left_mass, 0))
        take = right[by_block] == 1
        below[by_block[take]] += (seen - base)[take]
        span *= 2
    out[start] = below * weight
    return out


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consume rows sorted by group key; emit one partial count per group. Only the last, open group is held."""
    held: list[pd.DataFrame] = []

    def settle(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True)
        codes = pdf["key"].ne(pdf["key"].shift()).cumsum().to_numpy() - 1
        hits = rising_weights(codes, pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        return pd.DataFrame({"key": pdf["key"].to_numpy()[firsts], "rising": np.add.reduceat(hits, firsts)})

    for pdf in batches:
        if pdf.empty:
            continue
        open_group = pdf["key"].eq(pdf["key"].iloc[-1]).to_numpy()
        if not held or held[-1]["key"].iloc[-1] == pdf["key"].iloc[-1] and open_group.all():
            held.append(pdf)
            continue
        closed = pdf[~open_group]
        yield settle([*held, closed] if len(closed) else held)
        held = [pdf[open_group]]
    if held:
        yield settle(held)


def _rising_in_tasks(points: DataFrame, part: str | None, x: str, y: str) -> DataFrame:
    """``points(g, [part], x, y, w)`` with bounded (g, part) -> ``(g, rising)``, one row per (g, part)."""
    lead = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    slim = points.select(
        F.concat(lead, F.lit("|"), F.col("__g")).alias("key"),
        F.col(x).cast("double").alias("x"),
        F.col(y).cast("double").alias("y"),
        F.col("__w").cast("long").alias("w"),
    )
    counted = slim.repartition(F.col("key")).sortWithinPartitions("key").mapInPandas(
        _count_batches, "key string, rising long"
    )
    return counted.select(F.expr("substring(key, instr(key, '|') + 1)").alias("__g"), "rising")


def _binned(points: DataFrame, axis: str, name: str, cap: int) -> DataFrame:
    """``name``: the range of each point on ``axis``, in order.

    Even ranges hold at most two caps of points; an odd one is a single value above the cap.
    """
    values = points.groupBy("__g", axis).agg(F.count(F.lit(1)).alias("__n"))
    o = ordered(values, ["__g"], [axis], cap).running(__c=("sum", F.col("__n")))
    at = 2 * F.floor((F.col("__c") - F.col("__n")) / cap) + (F.col("__n") > cap).cast("long")
    return join_on(points, o.done().select("__g", axis, at.alias(name)), ["__g", axis])


def _rising(points: DataFrame, cap: int) -> DataFrame:
    """``points(g, x, y, w)``, distinct (x, y) per g -> ``(g, rising)``."""
    sizes = points.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.filter(F.col("__n") > cap)
    largest = large.agg(F.max("__n")).first()[0]
    if largest is None:
        return _rising_in_tasks(points, None, "__x", "__y")
    # at most sqrt(n) / 2 ranges per axis, so the grid below has at most n / 4 cells
    cap = max(cap, math.ceil(4 * math.sqrt(largest)))
    small = join_on(points, large, ["__g"], "left_anti")
    both = join_on(points, large.select("__g"), ["__g"], "left_semi")
    both = staged(_binned(_binned(both, "__x", "bx", cap), "__y", "by", cap), "binned")
    # a range of one single value holds no pair that rises in that coordinate
    inside_x = both.filter(F.pmod("bx", F.lit(2)) == 0)
    inside_y = both.filter(F.pmod("by", F.lit(2)) == 0)
    cells = both.groupBy("__g", F.col("bx").cast("double").alias("__x"), F.col("by").cast("double").alias("__y")).agg(F.sum("__w").alias("__w"))
    pieces = (
        _rising_in_tasks(small, None, "__x", "__y")
        .unionByName(_rising_in_tasks(inside_x, "bx", "__x", "__y"))
        .unionByName(_rising_in_tasks(inside_y, "by", "bx", "__y"))
        .unionByName(_rising(cells, cap))
    )
    return pieces.groupBy("__g").agg(F.sum(F.col("rising").cast(PAIRS)).alias("rising"))


def _pairs(n: Column) -> Column:
    """n (n - 1) / 2 of a whole number, exactly: one of the two factors is even."""
    even = F.pmod(n, F.lit(2)) == 0
    a, b = F.when(even, F.shiftright(n, 1)).otherwise(n).cast("decimal(19,0)"), F.when(even, n - 1).otherwise(F.shiftright(n - 1, 1)).cast("decimal(19,0)")
    return (a * b).cast(PAIRS)


def concordance(
    df: DataFrame, by: list[str], x: str, y: str, task_points: int | None = None
) -> DataFrame:
    """Pair counts per group: ``n_rows, n_pairs, concordant, discordant, ties_x, ties_y, ties_both``, exact decimals, as
    the pairs of a few thousand million rows exceed a long.

    ``ties_x`` and ``ties_y`` include pairs tied in both. Rows with a null coordinate are left out.
    """
    cap = task_points or TASK_POINTS
    if not by:
        df, by, lone = df.withColumn("__one", F.lit(0)), ["__one"], True
    else:
        lone = False
    points = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
        .agg(F.count(F.lit(1)).alias("__w"))
        .withColumn("__g", F.to_json(F.struct(*by)))
    )
    points = staged(points, "points")  # read five times below

    def tied(*cols: str) -> DataFrame:
        name = "_".join(("t",) + cols)
        c = points.groupBy("__g", *cols).agg(F.sum("__w").alias("__w"))
        return c.groupBy("__g").agg(F.sum(_pairs(F.col("__w"))).alias(name))

    base = points.groupBy(*by, "__g").agg(
        F.sum("__w").alias("n_rows"), F.sum(_pairs(F.col("__w"))).alias("t_both")
    )
    rising = _rising(points.select("__g", F.col("__x").cast("double"), F.col("__y").cast("double"), "__w"), cap)
    out = base.join(tied("__x"), "__g").join(tied("__y"), "__g").join(rising, "__g", "left")
    pairs = _pairs(F.col("n_rows"))
    up = F.coalesce(F.col("rising").cast(PAIRS), F.lit(0).cast(PAIRS))
    out = out.select(
        *by,
        "n_rows",
        pairs.cast(PAIRS).alias("n_pairs"),
        up.cast(PAIRS).alias("concordant"),
        (pairs - F.col("t___x") - F.col("t___y") + F.col("t_both") - up).cast(PAIRS).alias("discordant"),
        F.col("t___x").cast(PAIRS).alias("ties_x"),
        F.col("t___y").cast(PAIRS).alias("ties_y"),
        F.col("t_both").cast(PAIRS).alias("ties_both"),
    )
    return out.drop("__one") if lone else out
