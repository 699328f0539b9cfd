"""Registry of the driver's queries, each with its SQL statement where one exists.

Doubles are compared after rounding half up on a fixed grid. The offset sits slightly above one half
so that exact halves, which two engines may reach from either side, round alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    scale = 10.0**digits
    return F.floor(c * scale + 0.5003).cast("double") / scale


def gridded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles on their grids; exact pair counts, which fit the test tables' longs, as such."""
    counts = {f.name: F.col(f.name).cast("long") for f in df.schema if f.dataType == T.DecimalType(38, 0)}
    return df.withColumns({c: grid(c, d) for c, d in digits.items()} | counts)


def R(expr: str, digits: int = 6) -> str:
    """The SQL text of :func:`grid`."""
    scale = f"{10 ** digits}::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {scale} + 0.5003::DOUBLE) / {scale})"


def micros(c: str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(F.col(c).cast("timestamp"))


# ---- views several queries share --------------------------------------------------------------
def sales_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Observed extended price against quantity times retail price."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    pt = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    return j.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "p_brand", "p_type", "p_size", "p_retailprice",
        F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * F.col("p_retailprice")).alias("pred"),
    )


SALES_PREDS = """preds AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, p_brand, p_type, p_size, p_retailprice,
  l_extendedprice AS obs, l_quantity * p_retailprice AS pred FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def part_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One observed and one predicted score per part."""
    return sales_preds(spark, sf).groupBy("l_partkey", "p_brand", "p_type", "p_size", "p_retailprice").agg(
        grid(F.avg("obs"), 2).alias("obs"), grid(F.avg("pred"), 2).alias("pred"), F.count(F.lit(1)).alias("sales")
    )


PART_SCORES = SALES_PREDS + f""", scores AS (SELECT l_partkey, p_brand, p_type, p_size, p_retailprice,
  {R('avg(obs)', 2)} AS obs, {R('avg(pred)', 2)} AS pred, count(*) AS sales FROM preds GROUP BY ALL)"""


def day_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Per user and day: summed value and a count-based prediction; days are the time axis."""
    ev = table(spark, sf, "events")
    day = F.floor((micros("ts") - 1704067200000000) / 86400000000.0).cast("double")
    return ev.groupBy("user_id", day.alias("time_h")).agg(
        grid(F.sum("value"), 2).alias("q_obs"), (F.count(F.lit(1)) * 20.0).alias("q_pred")
    )


DAY_CURVE = f"""curve AS (SELECT user_id, floor((epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE) AS time_h,
  {R('sum(value)', 2)} AS q_obs, count(*) * 20.0::DOUBLE AS q_pred FROM events GROUP BY ALL)"""
