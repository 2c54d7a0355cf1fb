"""Cutting lineage: tables written to the shared checkpoint folder and read back."""
from __future__ import annotations

from pyspark.sql import DataFrame

from labelforge.session import scratch_path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under spark.checkpoint.dir (shared by all executors) and read it
    back: later steps neither recompute it nor depend on the executors that made it, and the
    reader knows its size, so a small table is broadcast by the planner's own threshold."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
