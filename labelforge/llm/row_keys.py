"""A key of each row's own, for operators that judge rows and not ids."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.store import materialize


def _hashed(doc_id: Column, text: Column, salt: int) -> Column:
    parts = [p for c, none in ((doc_id, F.lit(0)), (text, F.lit(""))) for p in (c.isNull(), F.coalesce(c, none))]
    return F.xxhash64(F.lit(salt), *parts)


def row_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Column, DataFrame]:
    """The key of a row, as an expression on ``docs``, and the table (key, id, n) of all keys: rows
    with equal doc_id and text share a key and count as n, all others differ, null ids included. The
    key is a 64-bit hash; a second one tells whether two rows met, and then another salt is taken."""
    ident, salt = F.col(doc_id).cast("long"), 0
    while True:
        key, check = _hashed(ident, F.col(text), salt), _hashed(ident, F.col(text), salt + 1)
        rows = docs.select(key.alias("key"), check.alias("check"), ident.alias("id"))
        keys = materialize(rows.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"),
                                                   (F.min("check") < F.max("check")).alias("met")), "row-keys")
        if not keys.where("met").limit(1).count():
            return key, keys.drop("met")
        salt += 2
