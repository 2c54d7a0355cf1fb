"""Row-wise batch jobs (lifecycle B): row ids, batches, consolidation of batch results with
the last attempt winning (Q10), attaching results back, and the unquoted CSV line format (S6)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.operators.position import batch_id, batch_name, key_position

RESULT_SCHEMA = "row_id long, translation string, error string"


def with_row_ids(df: DataFrame, key: str, name: str = "row_id") -> DataFrame:
    """Dense row ids 0..n-1 in ``key`` order (bucketed, no single-task window)."""
    return key_position(df, key, name=name)


def with_batches(df: DataFrame, size: int, row_id: str = "row_id") -> DataFrame:
    """Batch id and the batch file name."""
    return (df.withColumn("batch_id", batch_id(row_id, size))
            .withColumn("batch_name", batch_name("batch_id")))


def consolidate(results: DataFrame, key: str = "row_id", order: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """Q10: one result per row id; when a row id appears in several batches (or attempts) the
    latest one wins. ``max_by`` is a partial aggregate."""
    others = [c for c in results.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return results.groupBy(key).agg(last.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def attach_results(source: DataFrame, results: DataFrame, key: str = "row_id",
                   value: str = "translation") -> DataFrame:
    """Left join of results on the row id."""
    return source.join(results.select(key, value), key, "left")


def unquoted_csv_line(cols: list[str], sep: str = ",", escape: str = "\\") -> F.Column:
    """A CSV line with no quoting where the separator, quote, escape character and line
    breaks inside a field are each preceded by the escape character; null is empty."""
    def esc(c):
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        v = F.replace(v, F.lit(escape), F.lit(escape + escape))
        for ch in (sep, '"', "\n", "\r"):
            v = F.replace(v, F.lit(ch), F.lit(escape + ch))
        return v
    return F.concat_ws(sep, *[esc(c) for c in cols])
