"""File sources and sinks: CSV (S1, S2, S5, S6 sink), JSON lines (S7, S8, S11). ``records`` reads S6 and S3.

Every reader takes an explicit schema (nothing is inferred). Writers go through Spark's commit
protocol, so a task retried after an executor loss never leaves a half-written file behind.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

QUERY_SCHEMA = "Query string"
LABELED_SCHEMA = "Query string, Label string"
_CSV_OPTS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}
# Spark trims leading/trailing spaces of written CSV values by default; keep them.
_CSV_WRITE_OPTS = {"header": "true", "quote": '"', "escape": '"',
                   "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: str | StructType = QUERY_SCHEMA) -> DataFrame:
    """CSV with a header and quoted (possibly multi-line) text."""
    return spark.read.schema(schema).options(**_CSV_OPTS).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """CSV sink with a header; quotes are doubled inside quoted values."""
    w = df.write.mode(mode).options(**_CSV_WRITE_OPTS)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def read_labeled_dir(spark: SparkSession, path: str, schema: str | StructType = LABELED_SCHEMA,
                     source: str = "source") -> DataFrame:
    """Every ``*.csv`` in a folder as one table; ``source`` is the file stem
    (``timebound.csv`` → ``timebound``). A folder written partitioned by ``source``
    (``source=<x>/part-*.csv``) gets the value from partition discovery instead."""
    if _has_partition_dirs(spark, path, source):
        # partition values stay text (no type inference: a subset named "007" is not 7)
        sch = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        return (spark.read.schema(sch.add(source, "string")).options(**_CSV_OPTS)
                .option("pathGlobFilter", "*.csv").csv(path))
    df = (spark.read.schema(schema).options(**_CSV_OPTS)
          .option("pathGlobFilter", "*.csv").csv(path))
    return df.withColumn(source, F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))


def _has_partition_dirs(spark: SparkSession, path: str, column: str) -> bool:
    """Whether ``path`` holds ``<column>=<value>`` folders (a listing, no job)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    return any(st.isDirectory() and st.getPath().getName().startswith(f"{column}=") for st in fs.listStatus(p))


def write_unquoted_lines(df: DataFrame, line_col: str, path: str, header: str | None = None,
                         mode: str = "overwrite") -> None:
    """S6 sink: pre-built unquoted CSV lines written as text (one part file per task; the
    header, when given, goes to its own first part so the data is never funnelled through
    one task)."""
    out = df.select(F.col(line_col).alias("value"))
    if header is not None:
        out = df.sparkSession.createDataFrame([(header,)], "value string").unionByName(out)
    out.write.mode(mode).text(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """S7/S8/S11 sink: JSON lines; nulls are left out of each record (the optional field)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """S7 source: JSON lines with an explicit schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)
