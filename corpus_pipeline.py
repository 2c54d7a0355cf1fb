"""The corpus pipeline: documents → quality rules → near duplicates → decontamination → secrets → packing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next stage's docs. All stages but the last keep the
columns of documents; the last returns the packed pieces with their ids. A document that a stage
rejects is gone for the later ones; secrets are replaced in the text. Near duplicates and
decontamination judge rows, not ids: rows without an id are checked too, and different texts under
one id each for itself. Null texts, repeated rows, empty tables and extra columns are handled as each
operator's module says.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelforge.llm import chosen_path, decontaminate, packing, quality_cascade, secrets
from labelforge.llm.queries import ranks_path, read
from labelforge.llm.store import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_cascade.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(docs, ranks_path(spark)))


STAGES = [("quality_rules", good_documents), ("near_duplicates", one_of_each), ("decontamination", without_benchmark),
          ("secrets", without_secrets), ("packing", packed)]

ORACLE_SQL = None  # byte-level BPE and the spaced seeds have no SQL form; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
