"""Sequential decisions on event streams.

State per experiment is a few numbers, plus the rows newer than the watermark that cannot be ordered
yet. Rows the watermark has passed are processed in event-time order and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory needs the RocksDB store; custom state requires it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _FirstStop(StatefulProcessor):
    """Holds rows until the watermark passes them; emits the first stop of an experiment once.

    Times are microseconds. An experiment has a few rows a batch, so they are handled as plain numbers, and state is asked for
    once and written once a call.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, seq long, poe double")
        self.progress = handle.getValueState("progress", "sampled long, stopped boolean, candidate long")

    def _progress(self) -> tuple:
        """Rows sampled so far, whether stopped, and the earliest waiting row that would stop."""
        known = self.progress.get()
        return (0, False, None) if known is None else tuple(known)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sampled, stopped, candidate = self._progress()
        if stopped:
            return iter([])
        new = [r for pdf in rows for r in zip(pdf["us"].tolist(), pdf["seq"].tolist(), pdf["poe"].tolist(), strict=True)]
        hits = [us for us, _, poe in new if poe < self.threshold]
        if hits:
            candidate = min(hits) if candidate is None else min(candidate, *hits)
            self.progress.update((sampled, stopped, candidate))
        # rows after the earliest stop cannot matter any more
        new = [(int(us), int(seq), poe) for us, seq, poe in new if candidate is None or us <= candidate]
        if new:
            self.waiting.appendList(new)
            self._wake(min(us for us, _, _ in new))
        return iter([])

    def _wake(self, us: int) -> None:
        """One timer, for the earliest waiting row; it settles every row the watermark has passed."""
        self.handle.registerTimer(us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sampled, stopped, candidate = self._progress()
        held = [] if stopped else sorted(tuple(r) for r in self.waiting.get())
        if not held:
            return iter([])
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        ready = [r for r in held if r[0] < limit]
        later = held[len(ready):]
        out = []
        for us, seq, poe in ready:
            sampled += 1
            if poe < self.threshold:
                stopped = True
                out.append(pd.DataFrame({"key": [str(key[0])], "us": [us], "seq": [seq], "position": [sampled - 1], "poe": [poe]}))
                break
        self.progress.update((sampled, stopped, candidate))
        if stopped or not later:
            self.waiting.clear()
        else:
            self.waiting.put(later)
            self._wake(later[0][0])
        return iter(out)

    def close(self) -> None:
        pass


def early_stop_stream(events: DataFrame, key: str, ts: str, seq: str, poe: str, threshold: float, delay: str = "1 hour") -> DataFrame:
    """One stop per experiment: its first probability below the threshold in event-time order."""
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(seq).cast("long").alias("seq"),
        F.col(poe).cast("double").alias("poe"),
    ).filter("poe IS NOT NULL AND ts IS NOT NULL").withColumn("us", F.unix_micros("ts"))
    stops = rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        statefulProcessor=_FirstStop(threshold),
        outputStructType="key string, us long, seq long, position long, poe double",
        outputMode="Append", timeMode="EventTime",
    )
    return stops.select("key", F.timestamp_micros("us").alias("stopped_at"), "seq", "position", "poe")


class _Incumbent(StatefulProcessor):
    """The rows of a run that improve on all earlier ones, in time order, whatever order they arrive in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.records = handle.getListState("records", "ts long, seq long, value double")
        self.summary = handle.getValueState("summary", "best double, improvements long, rows long, ts long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best, count, seen, ts, seq = self.summary.get() or (float("-inf"), 0, 0, 0, 0)
        new = [r for pdf in rows for r in zip(pdf["ts"].tolist(), pdf["seq"].tolist(), pdf["value"].tolist(), strict=True)]
        new = sorted(((int(t), int(q), v) for t, q, v in new if not any(x is None or x != x for x in (t, q, v))), key=itemgetter(0, 1))
        if new:
            late = count and new[0][:2] < (ts, seq)
            if late:  # a row between known ones, which it may outdo
                known = [tuple(r) for r in self.records.get()]
                rising = self._rising(sorted(known + new, key=itemgetter(0, 1)), float("-inf"))
                self.records.put(rising)
                count = len(rising)
            else:
                rising = self._rising(new, best)
                if rising:
                    self.records.appendList(rising)
                count += len(rising)
            best, (ts, seq) = (rising[-1][2], rising[-1][:2]) if rising else (best, (ts, seq))
            seen += len(new)
            self.summary.update((best, count, seen, ts, seq))
        return iter([pd.DataFrame({"key": [str(key[0])], "best": [best if count else None], "improvements": [count], "rows": [seen]})])

    @staticmethod
    def _rising(rows: list[tuple], best: float) -> list[tuple]:
        kept = []
        for row in rows:
            if row[2] > best:
                kept.append(row)
                best = row[2]
        return kept

    def close(self) -> None:
        pass


def incumbent_stream(events: DataFrame, key: str, ts: str, seq: str, value: str) -> DataFrame:
    """Best value and number of improvements per run over the rows that have arrived, in update mode.

    Both are those of the rows in time order (ties by ``seq``), in whatever order and batches they come. State holds the rows
    that improve on all earlier ones; rows in order only add to it, a late row puts it right. Null times and values don't count.
    """
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"), F.col(seq).cast("long").alias("seq"),
        F.col(value).cast("double").alias("value"),
    )
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Incumbent(), outputStructType="key string, best double, improvements long, rows long",
        outputMode="Update", timeMode="None",
    )


def pending_stream(source: DataFrame, keys: dict[str, Column], ts: str, keep: Column, delay: str = "1 day") -> DataFrame:
    """Screened rows, each normalised key once within the watermark delay."""
    named = source.filter(keep).withColumn("__ts", F.col(ts).cast("timestamp")).withColumns(keys)
    return named.withWatermark("__ts", delay).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def curve_metrics_stream(
    preds: DataFrame, ts: str, by: list[str], obs: str, pred: str, sd: str | None = None, width: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Tumbling-window errors, and interval coverage where a deviation is given."""
    y, e = F.col(obs), F.col(obs) - F.col(pred)
    aggs = [F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")]
    aggs.append((1.0 - F.sum(e * e) / F.nullif(F.count(F.lit(1)) * F.var_pop(y), F.lit(0.0))).alias("r2"))
    if sd is not None:
        aggs.append(F.avg((F.abs(e) <= 1.96 * F.col(sd)).cast("double")).alias("coverage"))
    rows = preds.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay)
    out = rows.groupBy(F.window("__ts", width).alias("w"), *by).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), *by, *[a for a in out.columns if a not in ("w", *by)])


def run_available(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Process what the source holds into a table of the shared folder and return that table.

    With ``at``, a folder that outlives the run, table and progress live there under ``name``: a later run, also after a
    crash, takes up where this one ended, and the table has every row once. The file sink lists what each batch committed;
    in other modes a batch owns a folder, which it replaces if it is run again.
    """
    return run_counted(stream, name, mode, at)[0]


def run_counted(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """As :func:`run_available`, and a table (batch_id, input_rows, late_rows) with a row per batch of this run.

    ``late_rows`` have been dropped: the watermark had passed them when the batch before theirs began. The driver holds one
    entry a batch.
    """
    spark = stream.sparkSession
    if at is None:
        path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    else:
        path, state = f"{at.rstrip('/')}/{name}", f"{at.rstrip('/')}/{name}-state"
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

        query = writer.outputMode(mode).foreachBatch(save).start()
    seen: dict[int, tuple[int, int]] = {}
    done = False
    while not done:  # the query remembers its last hundred batches
        done = query.awaitTermination(1)
        for p in query.recentProgress:
            dropped = sum(op.get("numRowsDroppedByWatermark", 0) for op in p["stateOperators"])
            seen[p["batchId"]] = (p["numInputRows"], dropped)
    progress = spark.createDataFrame([(k, *v) for k, v in sorted(seen.items())], "batch_id long, input_rows long, late_rows long")
    columns = stream.columns if mode == "append" else [*stream.columns, "batch_id"]
    schema = f"{_ddl(stream)}{'' if mode == 'append' else ', batch_id int'}"
    return spark.read.schema(schema).parquet(path).select(*columns), progress


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
