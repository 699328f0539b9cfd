"""Stream queries: the events table is replayed through a file source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.corpus import first_per_key
from ..session import scratch_path
from ..streaming import jobs as J
from .base import R, gridded, query

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, sf):
    J.use_rocksdb(spark)
    # as a pattern the path may be a folder of part files or a single file
    return spark.readStream.schema(EVENTS).parquet(f"{sf}/events.parque[t]")


@query(
    "early_stop_stream",
    """WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), i AS (SELECT *, value / (value + 40) AS poe, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT user_id, min(i) AS i FROM i, w WHERE value / (value + 40) < 0.05 AND epoch_ms(ts) + 1 <= epoch_ms(wm) GROUP BY 1)
    SELECT user_id::VARCHAR AS key, event_id AS seq, i - 1 AS position, floor(poe * 1e9 + 0.5003) / 1e9 AS poe FROM i JOIN s USING (user_id, i)""",
)
def early_stop_stream(spark, sf):
    ev = _events(spark, sf).withColumn("poe", F.col("value") / (F.col("value") + 40))
    out = J.run_available(J.early_stop_stream(ev, "user_id", "ts", "event_id", "poe", 0.05), "early-stop")
    return gridded(out.drop("stopped_at"), poe=9)


@query(
    "incumbent_stream",
    """WITH b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM events)
    SELECT user_id::VARCHAR AS key, max(value) AS best, count(*) FILTER (WHERE pb IS NULL OR value > pb) AS improvements, count(*) AS rows FROM b GROUP BY 1""",
)
def incumbent_stream(spark, sf):
    out = J.run_available(J.incumbent_stream(_events(spark, sf), "user_id", "ts", "event_id", "value"), "incumbent", "update")
    return first_per_key(out, ["key"], [F.desc("batch_id")]).drop("batch_id")


FILE_ROWS = 200_000


def _in_three(spark, sf, path):
    """The events table in three parts by id, written one after the other: the number of files of each, which is the same.

    A part of many rows is written and read by many tasks; with ``maxFilesPerTrigger`` of that number it is a batch.
    """
    events = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    part = F.col("event_id") % 3
    held = events.filter(part >= 0).groupBy(part.alias("part")).count()
    least = held.agg(F.when(F.count(F.lit(1)) == 3, F.min("count")).otherwise(0)).first()[0]
    files = max(1, min(least // FILE_ROWS, spark.sparkContext.defaultParallelism))
    for n in range(3):
        rows = events.filter(part == n)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.parquet(f"{path}/{n}")
        yield files


# a batch drops what the watermark had passed when the batch before it began, to the millisecond
LATE = """f AS (SELECT event_id % 3 AS part, epoch_us(ts) AS us FROM events), top AS (SELECT part, max(us) AS hi FROM f GROUP BY 1),
    wm AS (SELECT part + 2 AS part, (max(hi) OVER (ORDER BY part) // 1000 - {0}) * 1000 AS us FROM top)"""


@query(
    "late_rows_by_batch",
    f"""WITH {LATE.format(10 * 86400000)}
    SELECT part::BIGINT AS batch_id, count(*) AS input_rows, count(*) FILTER (f.us <= wm.us) AS late_rows FROM f LEFT JOIN wm USING (part) GROUP BY part""",
)
def late_rows_by_batch(spark, sf):
    """What early stopping over three late files drops: each holds rows of all days, and rows may be ten days late."""
    J.use_rocksdb(spark)
    path = scratch_path(spark, "late")
    files = max(_in_three(spark, sf, path))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    stops = J.early_stop_stream(stream.withColumn("poe", F.col("value") / (F.col("value") + 40)), "user_id", "ts", "event_id", "poe", 0.05, "10 days")
    return J.run_counted(stops, "late-stops")[1].filter("input_rows > 0")


@query("incumbent_stream_of_late_files", """WITH b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM events)
    SELECT user_id::VARCHAR AS key, max(value) AS best, count(*) FILTER (WHERE pb IS NULL OR value > pb) AS improvements, count(*) AS rows FROM b GROUP BY 1""")
def incumbent_stream_of_late_files(spark, sf):
    """Three batches, each with rows between those of the batches before."""
    J.use_rocksdb(spark)
    path = scratch_path(spark, "late")
    files = max(_in_three(spark, sf, path))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(f"{path}/*")
    out = J.run_available(J.incumbent_stream(stream, "user_id", "ts", "event_id", "value"), "late-incumbent", "update")
    return first_per_key(out, ["key"], [F.desc("batch_id")]).drop("batch_id")


@query("pending_stream_resumed", "SELECT DISTINCT user_id::VARCHAR || '/' || event_type AS k FROM events WHERE event_type LIKE '%i%' AND value > 10")
def pending_stream_resumed(spark, sf):
    """A run per file, each taking up where the one before ended."""
    J.use_rocksdb(spark)
    path, at = scratch_path(spark, "arriving"), scratch_path(spark, "resumed")
    key = F.lower(F.trim(F.concat_ws("/", F.col("user_id").cast("string"), F.upper("event_type"))))
    keep = F.col("event_type").rlike("(?i)i") & (F.col("value") > 10)
    for _ in _in_three(spark, sf, path):
        stream = spark.readStream.schema(EVENTS).parquet(f"{path}/*")
        out = J.run_available(J.pending_stream(stream, {"k": key}, "ts", keep, "60 days"), "pending", at=at)
    return out


@query("pending_stream", "SELECT DISTINCT user_id::VARCHAR || '/' || event_type AS k FROM events WHERE event_type LIKE '%i%' AND value > 10")
def pending_stream(spark, sf):
    key = F.lower(F.trim(F.concat_ws("/", F.col("user_id").cast("string"), F.upper("event_type"))))
    keep = F.col("event_type").rlike("(?i)i") & (F.col("value") > 10)
    return J.run_available(J.pending_stream(_events(spark, sf), {"k": key}, "ts", keep, "60 days"), "pending")


@query(
    "curve_metrics_stream",
    f"""WITH w AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), e AS (SELECT date_trunc('hour', ts) AS s, event_type, value AS o, 20.0::DOUBLE AS p FROM events)
    SELECT epoch_us(s) AS start, event_type, count(*) AS n, {R('sqrt(avg((o-p)*(o-p)))', 4)} AS rmse, {R('avg(abs(o-p))', 4)} AS mae, CASE WHEN count(*) >= 5 THEN {R('1 - sum((o-p)*(o-p)) / (count(*) * var_pop(o))', 4)} END AS r2, {R('avg((abs(o-p) <= 1.96*10)::INT)')} AS coverage FROM e, w WHERE s + INTERVAL 1 HOUR <= wm GROUP BY 1, 2""",
)
def curve_metrics_stream(spark, sf):
    ev = _events(spark, sf).select("ts", "event_type", F.col("value").alias("o"), F.lit(20.0).alias("p"), F.lit(10.0).alias("sd"))
    out = J.run_available(J.curve_metrics_stream(ev, "ts", ["event_type"], "o", "p", "sd"), "metrics")
    out = out.withColumns({"start": F.unix_micros("start"), "r2": F.when(F.col("n") >= 5, F.col("r2"))})  # too few rows: noise
    return gridded(out, rmse=4, mae=4, r2=4, coverage=6)
