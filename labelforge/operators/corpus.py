"""Corpus building: hold-out removal (J1, J2), distinct and first-row dedupe (A1, A2),
concat with provenance (U1), union of rounds (U2) and set difference (U3)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import py_strip


def remove_avoided(df: DataFrame, avoid: DataFrame, query: str = "query",
                   avoid_col: str = "query", key=None) -> DataFrame:
    """J1 (exact, case-sensitive) / J2 (with ``key`` = a normaliser such as ``normalized_key``):
    keep the rows whose text is not in the avoid list.

    A left-anti join: the avoid side is hashed (broadcast by AQE when its measured size allows,
    shuffled otherwise), the candidate side is streamed, so duplicates and order are kept."""
    if key is None:
        a = avoid.select(F.col(avoid_col).alias("_k")).distinct()
        return df.join(a, df[query] == a["_k"], "left_anti")
    a = avoid.select(key(F.col(avoid_col)).alias("_k")).distinct()
    return (df.withColumn("_k", key(F.col(query)))
            .join(a, "_k", "left_anti").drop("_k"))


def normalized_key(c: Column) -> Column:
    """J2 key: lower-cased text without outer whitespace."""
    return F.lower(py_strip(c))


def distinct_queries(df: DataFrame, cols: Sequence[str] = ("query",)) -> DataFrame:
    """A1: distinct rows (hash aggregate with map-side combine: a hot text is merged per task
    before the shuffle)."""
    return df.select(*cols).distinct()


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A2: one row per ``keys``, the first by ``order`` (``dropDuplicates`` keeps an arbitrary
    one). ``min_by`` is a partial aggregate, so a key held by a third of all rows is reduced
    inside each map task before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*[F.col(c) for c in order]))
    return (df.groupBy(*keys).agg(best.alias("_first"))
            .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others])
            .select(*df.columns))


def concat_with_source(parts: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """Concatenate tables by column name, tagging each with its source name."""
    out = None
    for name, d in parts.items():
        t = d.withColumn(source, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def union_rounds(rounds: Sequence[DataFrame], query: str = "query") -> DataFrame:
    """Union of rounds as a set."""
    out = None
    for r in rounds:
        t = r.select(query)
        out = t if out is None else out.union(t)
    return out.distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """U3 set form (EXCEPT DISTINCT)."""
    return a.subtract(b)
