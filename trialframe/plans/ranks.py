"""Ranks with ties, and distribution points, over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import NO_SPLIT, join_on, order_columns, ordered, row_cap, settle

# values the built-in percentile may buffer for one group
SMALL_GROUP = 200_000

def with_ranks(
    df: DataFrame, by: list[str], col: str, prefix: str, desc: bool = False, cap: int | None = None
) -> DataFrame:
    """Add ``<prefix>_min``, ``_max``, ``_avg`` and ``_dense`` ranks of ``col`` within ``by``.

    One sort serves all four: the maximum rank is the count over the value range up to the current
    row. Where a group is oversized, distinct values are ranked with their counts as weights and
    joined back, so a value that fills half a group is one row before the sort.
    """
    spec = f"-{col}" if desc else col
    low, high, dense = f"{prefix}_min", f"{prefix}_max", f"{prefix}_dense"
    limit = settle(df, by, cap)
    if limit == NO_SPLIT:
        w = Window.partitionBy(*by).orderBy(*order_columns([spec]))
        upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumns({low: F.rank().over(w).cast("long"), high: F.count(F.lit(1)).over(upto), dense: F.dense_rank().over(w).cast("long")})
    else:
        values = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("__w"))
        o = ordered(values, by, [spec], limit).running(__cum=("sum", F.col("__w")), __d=("count", F.lit(1)))
        ranks = o.done().select(*by, col, (F.col("__cum") - F.col("__w") + 1).alias(low), F.col("__cum").alias(high), F.col("__d").alias(dense))
        out = join_on(df, ranks, [*by, col])
    return out.withColumn(f"{prefix}_avg", (F.col(low) + F.col(high)) / 2.0)


def top_rows(df: DataFrame, by: list[str], order: list[str], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark prunes to ``k`` per group before the shuffle."""
    if not by:
        # no group: a distributed top-k first, so that the numbering sees k rows only
        df = df.orderBy(*order_columns(order)).limit(k)
        w = Window.orderBy(*order_columns(order))
    else:
        w = Window.partitionBy(*by).orderBy(*order_columns(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def percentiles(
    df: DataFrame, by: list[str], col: str, probs: dict[str, float], cap: int | None = None, also: tuple[Column, ...] = ()
) -> DataFrame:
    """Exact linear-interpolation percentiles per group, named by ``probs``, and the aggregates ``also`` of the same rows.

    Small groups take the built-in exact percentile, which buffers a group's values. Where a group is
    larger, equal values are counted before the shuffle and the two neighbours of each point are picked
    out of the running counts, so no task buffers a group.
    """
    rows = df.filter(F.col(col).isNotNull())
    if settle(rows, by, min(row_cap(df, cap), SMALL_GROUP)) == NO_SPLIT:
        points = F.percentile(F.col(col).cast("double"), F.array(*[F.lit(float(p)) for p in probs.values()]))
        small = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), points.alias("__p"), *also)
        return small.withColumns({n: F.col("__p")[i] for i, n in enumerate(probs)}).drop("__p")
    tall = rows.groupBy(*by, F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__w"))
    o = ordered(tall, by, ["__v"], cap).running(__cum=("sum", F.col("__w"))).total(__n=("sum", F.col("__w")))
    at = {n: (F.col("__n") - 1) * F.lit(float(p)) for n, p in probs.items()}
    picks = []
    for n, pos in at.items():
        picks.append(F.min(F.when(F.col("__cum") > F.floor(pos), F.col("__v"))).alias(f"__lo_{n}"))
        picks.append(F.min(F.when(F.col("__cum") > F.ceil(pos), F.col("__v"))).alias(f"__hi_{n}"))
    g = o.df.groupBy(*o.by).agg(F.max("__n").alias("__n"), *picks)
    for n, p in probs.items():
        pos = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo_{n}"), F.col(f"__hi_{n}")
        g = g.withColumn(n, (lo + (hi - lo) * (pos - F.floor(pos))).cast("double"))
    helpers = [f"__{side}_{n}" for n in probs for side in ("lo", "hi")]
    out = g.drop(*helpers, *o.shed).withColumnRenamed("__n", "n")
    return join_on(out, rows.groupBy(*by).agg(*also), by) if also else out
