"""Derived views over the driver tables, shared by every registered query.

- ``queries(subset, rid, query)``: url ← pages.url, chat ← user turns, short ← part.p_name,
  general ← documents.text (whole texts).
- ``labeled(doc_id, query, label, source, lang, n_chars)``: documents ⋈ labels,
  label = Search when quality = 1 else Chat.
- ``groups(doc_id, lang, grp, ord, query, label, y, n_chars)``: labelled fr/en rows split per
  language by D2 into six groups.
- ``preds(doc_id, grp, y, prob)``: prob = least(n_chars / 25000, 1) (deterministic, has ties).
- ``vocab(token, n, p, logp, token_id)`` over documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators.embed import build_vocab, token_blocks, token_counts, tokenize
from labelforge.operators.split import exact_split
from labelforge.sources.tables import table

SPLIT_SEED = 666
GROUP_ORDER = ["fr_train", "en_train", "fr_val", "en_eval", "fr_test", "en_test"]
EVAL_NAMES = {"en": ("en_train", "en_eval", "en_test"), "fr": ("fr_train", "fr_val", "fr_test")}
TURN_BASE = 1000  # rid of a user turn = conv_id * 1000 + turn


def queries(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(F.lit("url").alias("subset"),
                                            F.col("page_id").alias("rid"), F.col("url").alias("query"))
    conv = (table(spark, d, "conversations").filter(F.col("role") == "user")
            .select(F.lit("chat").alias("subset"),
                    (F.col("conv_id") * TURN_BASE + F.col("turn")).alias("rid"),
                    F.col("text").alias("query")))
    part = table(spark, d, "part").select(F.lit("short").alias("subset"),
                                          F.col("p_partkey").alias("rid"), F.col("p_name").alias("query"))
    docs = table(spark, d, "documents").select(F.lit("general").alias("subset"),
                                               F.col("doc_id").alias("rid"), F.col("text").alias("query"))
    return pages.unionByName(conv).unionByName(part).unionByName(docs)


def labeled(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lab = table(spark, d, "labels")
    return (docs.join(lab, "doc_id")
            .select("doc_id", F.col("text").alias("query"),
                    F.when(F.col("quality") == 1, "Search").otherwise("Chat").alias("label"),
                    "source", "lang", "n_chars"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    lab = labeled(spark, d).filter(F.col("lang").isin("fr", "en"))
    s = exact_split(lab, "doc_id", SPLIT_SEED, partition_by=["lang"], name="split")
    grp = (F.when(F.col("split") == "train", F.concat(F.col("lang"), F.lit("_train")))
           .when(F.col("split") == "test", F.concat(F.col("lang"), F.lit("_test")))
           .when(F.col("lang") == "fr", F.lit("fr_val")).otherwise(F.lit("en_eval")))
    order = F.create_map(*[x for i, g in enumerate(GROUP_ORDER) for x in (F.lit(g), F.lit(i))])
    return (s.withColumn("grp", grp).withColumn("ord", order[F.col("grp")])
            .withColumn("y", (F.col("label") == "Search").cast("int")).drop("split"))


def preds(spark: SparkSession, d: str) -> DataFrame:
    return groups(spark, d).select(
        "doc_id", "grp", "y", F.least(F.col("n_chars") / F.lit(25000.0), F.lit(1.0)).alias("prob"))


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokenize(table(spark, d, "documents"), "doc_id", "text")


def doc_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, token, cnt) over documents: the one pre-aggregate both sides start from."""
    return token_counts(doc_tokens(spark, d), "doc_id")


def doc_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as token blocks: counted per document and per block in one pass over the texts."""
    return token_blocks(table(spark, d, "documents"), "doc_id", "text")


def vocab(spark: SparkSession, d: str) -> DataFrame:
    """Counted straight from the occurrences: the map-side partial count folds a hot token
    before the shuffle (cheaper than going through the wider (doc, token) pre-aggregate)."""
    return build_vocab(doc_tokens(spark, d))
