"""Driver tables: one parquet file per table; Catalyst prunes columns and pushes filters into
the scan (through the optional spread below), so callers select what they need and nothing
else is read."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
# Text tables whose per-row work (splitting, regexes, tokenising) dominates, with their keys.
TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    return spread(df, TEXT_KEYS[name], path) if name in TEXT_KEYS else df


_SPLITS: dict[tuple[str, str], int] = {}


def spread(df: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """Hash-partition a scan on its key when it yields fewer splits than the cluster has cores
    (one large row group reads as one task, and every per-row step after it would run there).
    Large inputs already have enough splits and are left as they are. The split count of a
    path is looked up once per application (planning only, no job)."""
    try:
        sc = df.sparkSession.sparkContext
        par = sc.defaultParallelism
        k = (sc.applicationId, path or ",".join(sorted(df.inputFiles())))
        if k not in _SPLITS:
            _SPLITS[k] = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view of the plan (e.g. a remote session): leave as is
        return df
    if _SPLITS[k] >= par:
        return df
    return df.repartition(par, key)
