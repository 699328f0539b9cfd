"""Tables written once where a plan would otherwise run several times."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import scratch_path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Consumers read only their columns from it, the lineage ends there, and a lost executor costs a
    re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
