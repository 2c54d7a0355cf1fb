"""Checks and gates: required columns (P4), label-domain report (P5), failed rows (P8, A21),
missing rows (J4), the error table (J5), batch reply checks (F14) and reply parsing (F15)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from labelforge.functions.labels import normalize_label

DEFAULT_ERROR = "unknown error"


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail before any job runs when a column is absent (schema check, no Spark job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"no such column: {', '.join(missing)} (the table has {', '.join(df.columns)})")
    return df


def label_domain(df: DataFrame, label: str = "label", name: str = "label_id") -> DataFrame:
    """P5 non-fatal form: the mapped id (null outside the domain) and a ``bad_label`` flag."""
    return (df.withColumn(name, normalize_label(label))
            .withColumn("bad_label", F.col(name).isNull()))


def failed_per_batch(results: DataFrame, batch: str = "batch_id",
                     value: str = "translation") -> DataFrame:
    """P8 + A21: rows and failed rows (null result) per batch."""
    return results.groupBy(batch).agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.count_if(F.col(value).isNull()).alias("n_failed"))


def missing_rows(source: DataFrame, results: DataFrame, key: str = "row_id") -> DataFrame:
    """Source rows without any result: how many, and the first id (one row)."""
    miss = source.select(key).join(results.select(key), key, "left_anti")
    return miss.agg(F.count(F.lit(1)).alias("n_missing"), F.min(key).alias("first_missing"))


def error_table(source: DataFrame, results: DataFrame, key: str = "row_id", text: str = "query",
                value: str = "translation", error: str = "error") -> DataFrame:
    """Failed rows joined back to their source text, error defaulting to 'unknown error',
    sorted by id (a range-partitioned global sort)."""
    failed = results.filter(F.col(value).isNull()).select(
        key, F.coalesce(F.col(error), F.lit(DEFAULT_ERROR)).alias("error"))
    return (failed.join(source.select(key, F.col(text).alias("query")), key)
            .select(key, "error", "query").orderBy(key))


def zip_replies(batches: DataFrame, items: str, replies: str, batch: str = "batch_id") -> DataFrame:
    """a reply must have as many labels as its batch has queries; matching batches are
    unpacked to one row per query, the others become error rows (``ok`` false)."""
    ok = F.size(items) == F.size(replies)
    z = batches.withColumn("ok", ok)
    good = (z.filter("ok").select(batch, "ok", F.posexplode(F.arrays_zip(F.col(items).alias("item"),
                                                                        F.col(replies).alias("reply"))))
            .select(batch, F.col("pos"), F.col("col.item").alias("item"),
                    F.col("col.reply").alias("reply"), "ok"))
    bad = (z.filter(~F.col("ok")).select(batch, F.posexplode(items).alias("pos", "item"), "ok")
           .withColumn("reply", F.lit(None).cast("string")).select(batch, "pos", "item", "reply", "ok"))
    return good.unionByName(bad)


def parse_replies(df: DataFrame, col: str, schema: DataType | str, field: str,
                  name: str = "value") -> DataFrame:
    """extract a field from a structured JSON reply; a reply that does not parse or lacks
    the field yields a null value and an error text."""
    parsed = F.from_json(F.col(col), schema, {"mode": "PERMISSIVE"})
    v = parsed[field]
    return (df.withColumn(name, v)
            .withColumn("parse_error", F.when(v.isNull(), F.lit("unparsable reply"))))
