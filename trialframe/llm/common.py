"""Helpers the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.stage import staged

# fixed values: the white space of every contract, as a character class and as the characters themselves
WHITE = "[\\x20\\x09-\\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_batches(df: DataFrame, start: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, lean: bool = False) -> DataFrame:
    """``start()`` once per task gives the function from a batch's columns (lists) to the columns of ``schema``.

    ``lean``: for tasks with large texts or caches, batches are cut by bytes and the memory goes back at the task's end.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    names = df.columns

    def run(batches):
        step = start()
        for batch in slices(batches) if lean else batches:
            if batch.num_rows:
                out = step({n: batch.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        if lean:
            del step
            give_back()

    return df.mapInArrow(run, schema)


def slices(batches, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut where they hold more than about ``size`` bytes."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return this process' free memory to the system, where the C library offers that.

    Python workers serve one task after another; what a task has freed stays theirs otherwise.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions_for(rows: int, each: int) -> int:
    """Partitions of about ``each`` rows."""
    return max(1, math.ceil(rows / each))


def running(df: DataFrame, keys: list[str], order: list[str], amount: str, to: str, at: str, each: int = 200_000) -> DataFrame:
    """Adds, per ``keys`` in ``order``, the rows before (``at``) and the sum of ``amount`` before (``to``).

    Groups may be of any size: rows are range-partitioned by keys and order, windows run inside a range, and every range
    adds what the ranges before it hold of the same key. Ties in ``order`` go by the staged row number. The ranges are
    staged, so a recomputed task can't see other borders.
    """
    row, part = fresh(df, "__row"), fresh(df, "__part")
    base = staged(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    n = partitions_for(base.count(), each)
    if n > 1:
        base = staged(base.repartitionByRange(n, *keys, *order, row).withColumn(part, F.spark_partition_id()), "ranges")
    else:
        base = base.withColumn(part, F.lit(0))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = base.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"), F.sum(amount).alias("__s"))
    held = held.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(part).alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"),
    )
    within = Window.partitionBy(part, *keys).orderBy(*order, row)
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns({at: F.row_number().over(within) - 1, to: F.coalesce(F.sum(amount).over(upto), F.lit(0))})
    match = F.col(part) == F.col("__p")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = local.join(held, match).withColumns({at: F.col(at) + F.col("__n0"), to: F.col(to) + F.col("__s0")})
    return out.select(*df.columns, at, to)
