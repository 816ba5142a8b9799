"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.sources.store import new_store_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: cuts lineage, is computed once, and outlives lost executors."""
    path = new_store_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
