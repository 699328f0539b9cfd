"""Ordered computations over groups that may be far larger than one task.

A Spark window keeps a whole group in one task. That is right for the usual case of many small
groups, and wrong when one group holds a large share of all rows. ``ordered`` counts the groups
first (one map-side-combined aggregation that reads the key columns only). Rows of groups above the
row cap are range-partitioned by group and order, with Spark's own comparison of every type, nulls
and direction; windows then run inside a range, and each range receives what the ranges before it
contribute. Groups below the cap take the plain window plan with a single shuffle.

The driver holds one entry per oversized group, at most ``rows / cap``. What is broadcast is one
entry per oversized group and range, at most ``3 * rows / cap``, whatever the data looks like.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import staged

CAP_CONF = "trialframe.groupRowCap"
DEFAULT_CAP = 4_000_000
# for groups known to be small: the group sizes are not counted
NO_SPLIT = 2**62
ALL = "__all"
PART = "__part"
EMPTY = 0


def row_cap(df: DataFrame, cap: int | None = None) -> int:
    """Rows one task may hold of one group: argument, session setting, default."""
    if cap is not None:
        return cap
    return int(df.sparkSession.conf.get(CAP_CONF, str(DEFAULT_CAP)))


def _parse(order: list[str]) -> list[tuple[str, bool]]:
    return [(o[1:], True) if o.startswith("-") else (o, False) for o in order]


def order_columns(order: list[str]) -> list[Column]:
    """``"-x"`` sorts descending with nulls last, ``"x"`` ascending with nulls first."""
    return [F.desc(c) if desc else F.asc(c) for c, desc in _parse(order)]


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the key columns appear once.

    The right keys are renamed first, so tables derived from one another can be joined.
    """
    if not keys:
        left, right, keys = left.withColumn(ALL, F.lit(EMPTY)), right.withColumn(ALL, F.lit(EMPTY)), [ALL]
        return join_on(left, right, keys, how).drop(ALL)
    names = {k: f"__k_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    out = left.join(renamed, match, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full_outer", "right"):
        out = out.withColumns({k: F.coalesce(k, n) for k, n in names.items()})
    return out.drop(*names.values())


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _oversized(df: DataFrame, keys: list[str], cap: int) -> list:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.filter(F.col("__n") > cap).collect()  # at most rows / cap entries


def settle(df: DataFrame, by: list[str], cap: int | None = None) -> int:
    """The row cap, or ``NO_SPLIT`` where no group exceeds it; lets several steps share one count."""
    limit = row_cap(df, cap)
    if limit >= NO_SPLIT:
        return NO_SPLIT
    if not by:
        df, by = df.withColumn(ALL, F.lit(EMPTY)), [ALL]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    return limit if counts.filter(F.col("__n") > limit).limit(1).count() else NO_SPLIT


@dataclass
class Ordered:
    """Rows with the range columns that keep each (group, range) small and the ranges in order."""

    df: DataFrame
    by: list[str]
    order: list[str]
    parts: list[str] = field(default_factory=list)
    shed: list[str] = field(default_factory=list)
    pinned: bool = False

    # ---- windows ------------------------------------------------------------------------------
    @property
    def keys(self) -> list[str]:
        return self.by + self.parts

    def _window(self):
        return Window.partitionBy(*self.keys).orderBy(*order_columns(self.order))

    def _pin(self) -> None:
        """An oversized group needs its rows twice per step: write them once, so steps do not multiply."""
        if self.parts and not self.pinned:
            self.df, self.pinned = staged(self.df, "ordered"), True

    def _replace(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.by, self.order, self.parts, self.shed, False)

    def _carry(self, aggs: list[Column], window_cols) -> DataFrame:
        """One row per range of an oversized group, extended by ``window_cols(window)``."""
        ranges = self.df.filter(F.col(self.parts[0]).isNotNull()).groupBy(*self.keys).agg(*aggs)
        w = Window.partitionBy(*self.by).orderBy(*[F.asc(p) for p in self.parts])
        return ranges.select(*self.keys, *window_cols(w))

    def _attach(self, df: DataFrame, carry: DataFrame, names: list[str]) -> DataFrame:
        # one row per oversized group and range: at most 3 * rows / cap
        return join_on(df, F.broadcast(carry.select(*self.keys, *names)), self.keys, "left")

    def running(self, exclusive: bool = False, **cols: tuple[str, Column]) -> "Ordered":
        """Running ``sum``/``count``/``max``/``min`` in order, with or without the current row."""
        self._pin()
        w = self._window().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        fold = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
        out = self.df.withColumns({n: fold[fn](c).over(w) for n, (fn, c) in cols.items()})
        if self.parts:
            again = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
            carry = self._carry(
                [fold[fn](c).alias(f"__r_{n}") for n, (fn, c) in cols.items()],
                lambda v: [
                    again[fn](f"__r_{n}").over(v.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__c_{n}")
                    for n, (fn, _) in cols.items()
                ],
            )
            out = self._attach(out, carry, [f"__c_{n}" for n in cols])
            merged = {}
            for n, (fn, _) in cols.items():
                own, before = F.col(n), F.col(f"__c_{n}")
                if fn in ("sum", "count"):
                    merged[n] = F.when(before.isNull(), own).otherwise(F.coalesce(own, F.lit(0)) + before)
                else:
                    merged[n] = (F.greatest if fn == "max" else F.least)(own, before)
            out = out.withColumns(merged).drop(*[f"__c_{n}" for n in cols])
        if exclusive:
            zero = {n: F.coalesce(F.col(n), F.lit(0)) for n, (fn, _) in cols.items() if fn == "count"}
            out = out.withColumns(zero) if zero else out
        return self._replace(out)

    def index(self, name: str) -> "Ordered":
        """1-based position in the group."""
        self._pin()
        out = self.df.withColumn(name, F.row_number().over(self._window()).cast("long"))
        if self.parts:
            rows, before = unused(out, "__r"), unused(out, "__c")  # the caller's rows may hold such names
            carry = self._carry(
                [F.count(F.lit(1)).alias(rows)],
                lambda v: [F.sum(rows).over(v.rowsBetween(Window.unboundedPreceding, -1)).alias(before)],
            )
            out = self._attach(out, carry, [before])
            out = out.withColumn(name, F.col(name) + F.coalesce(before, F.lit(0))).drop(before)
        return self._replace(out)

    def _shift(self, cols: dict[str, Column], forward: bool) -> "Ordered":
        self._pin()
        w = self._window()
        move, back = (F.lead, F.lag) if forward else (F.lag, F.lead)
        wanted = {n: move(c).over(w) for n, c in cols.items()}
        if not self.parts:
            return self._replace(self.df.withColumns(wanted))
        edge, shown, outermost, beyond = (unused(self.df, c) for c in ("__edge", "__r", "__outer", "__c"))
        out = self.df.withColumns({**wanted, edge: move(F.lit(1)).over(w).isNull()})
        # what a range shows its neighbour: its first row when looking ahead, its last when looking back
        held = F.struct(*[c.alias(n) for n, c in cols.items()])
        outer = self.df.filter(F.col(self.parts[0]).isNotNull()).select(*self.keys, held.alias(shown), back(F.lit(1)).over(w).isNull().alias(outermost))
        ranges = Window.partitionBy(*self.by).orderBy(*[F.asc(p) for p in self.parts])
        carry = outer.filter(F.col(outermost)).select(*self.keys, move(shown).over(ranges).alias(beyond))
        out = self._attach(out, carry, [beyond])
        out = out.withColumns({n: F.when(F.col(edge), F.col(beyond)[n]).otherwise(F.col(n)) for n in cols})
        return self._replace(out.drop(edge, beyond))

    def previous(self, **cols: Column) -> "Ordered":
        return self._shift(cols, forward=False)

    def following(self, **cols: Column) -> "Ordered":
        return self._shift(cols, forward=True)

    def total(self, **cols: tuple[str, Column]) -> "Ordered":
        """Whole-group ``sum``/``count``/``max``/``min`` on every row."""
        self._pin()
        fold = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
        w = Window.partitionBy(*self.keys)
        out = self.df.withColumns({n: fold[fn](c).over(w) for n, (fn, c) in cols.items()})
        if self.parts:
            whole = F.broadcast(  # oversized groups only: at most rows / cap
                self.df.filter(F.col(self.parts[0]).isNotNull())
                .groupBy(*self.by)
                .agg(*[fold[fn](c).alias(f"__t_{n}") for n, (fn, c) in cols.items()])
            )
            out = join_on(out, whole, self.by, "left")
            out = out.withColumns({n: F.coalesce(f"__t_{n}", n) for n in cols}).drop(*[f"__t_{n}" for n in cols])
        return self._replace(out)

    def done(self) -> DataFrame:
        return self.df.drop(*self.parts, *self.shed)


def ordered(df: DataFrame, by: list[str], order: list[str], cap: int | None = None) -> Ordered:
    """Prepare ``df`` for ordered computation inside the groups ``by``.

    ``order`` must be total (end with an identifier) where ties matter; rows equal in all of it stay
    in one range.
    """
    limit = row_cap(df, cap)
    shed: list[str] = []
    if not by:
        df, by = df.withColumn(ALL, F.lit(EMPTY)), [ALL]
        shed = [ALL]
    if limit >= NO_SPLIT:
        return Ordered(df, list(by), order, [], shed)
    hot = _oversized(df, by, limit)
    if not hot:
        return Ordered(df, list(by), order, [], shed)
    return Ordered(_ranged(df, by, order, hot, limit), list(by), order, [PART], shed, True)


def _ranged(df: DataFrame, by: list[str], order: list[str], hot: list, limit: int) -> DataFrame:
    """``df`` with the range of each row of an oversized group; null for all others.

    Ranges are written, so a recomputed task can't meet other borders.
    """
    schema = T.StructType([T.StructField(k, df.schema[k].dataType) for k in by])
    keys = df.sparkSession.createDataFrame([tuple(r[k] for k in by) for r in hot], schema)
    pieces = max(2, math.ceil(2 * sum(r["__n"] for r in hot) / limit))
    # at most rows / cap keys
    large = join_on(df, F.broadcast(keys), by, "left_semi").repartitionByRange(pieces, *by, *order_columns(order))
    large = large.withColumn(PART, F.spark_partition_id().cast("long"))
    small = join_on(df, F.broadcast(keys), by, "left_anti").withColumn(PART, F.lit(None).cast("long"))
    return staged(small.unionByName(large), "ordered")
