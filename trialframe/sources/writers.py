"""Sinks of the curation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_routed(df: DataFrame, route: str, path: str, fmt: str = "parquet", mode: str = "overwrite", **options) -> None:
    """One pass over the rows, one folder per route value."""
    df.write.partitionBy(route).mode(mode).options(**options).format(fmt).save(path)


def status_append(df: DataFrame, path: str) -> None:
    """Append run status rows with the time of writing."""
    df.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
