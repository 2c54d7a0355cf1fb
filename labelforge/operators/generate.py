"""Generation until the quota (D6 with M3): rounds of requests to a user-supplied generator until enough
distinct, unlisted queries are collected or the rounds run out.

Every round is committed in two steps, each one Spark job with its own folder: the replies as they came
(``replies/round=...``: calls are paid once), then the queries that are new (``collected/round=...``). A
rerun on the same folder finds the committed steps by a listing and goes on behind them, so a crash
costs at most the step it happens in. The collected set lives in those folders, never in the driver; a
new round is compared with it by digest, in a join of slim rows that Spark may spill or split.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.operators.user_fn import GENERATED_SCHEMA, generate_with

# Requests of a round, queries asked for by each, and rounds at most
WORKERS = 8
REQUEST_SIZE = 400
MAX_ROUNDS = 50

COLLECTED_SCHEMA = "query string, digest string, request_id long, round int"


def _folder(out: str, step: str, n: int) -> str:
    return f"{out.rstrip('/')}/{step}/round={n:06d}"


def _committed(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def collected(spark: SparkSession, out: str, rounds: int) -> DataFrame:
    """The queries of the first ``rounds`` committed rounds: query, digest, request_id (the smallest one that
    gave it), round (from 0)."""
    if not rounds:
        return spark.createDataFrame([], COLLECTED_SCHEMA)
    paths = [_folder(out, "collected", r) for r in range(rounds)]
    return spark.read.schema(COLLECTED_SCHEMA).option("basePath", f"{out.rstrip('/')}/collected").parquet(*paths)


def new_queries(replies: DataFrame, known: DataFrame, avoid: DataFrame | None, avoid_col: str) -> DataFrame:
    """Distinct non-null queries of a round that are neither on the avoid list nor collected before.
    A query many requests returned is folded by a partial aggregate on its digest."""
    q = replies.where(F.col("query").isNotNull()).select(F.sha2("query", 256).alias("digest"), "query", "request_id")
    for listed in ([] if avoid is None else [avoid.select(F.sha2(F.col(avoid_col), 256).alias("digest"))]) + [known.select("digest")]:
        q = q.join(listed, "digest", "left_anti")
    # equal digests have equal texts, so any of them will do
    return q.groupBy("digest").agg(F.any_value("query").alias("query"), F.min("request_id").alias("request_id"))


def generate_until(spark: SparkSession, ask: Callable[[DataFrame], DataFrame], prompt: str, target: int, out: str,
                   avoid: DataFrame | None = None, avoid_col: str = "query", workers: int = WORKERS,
                   request_size: int = REQUEST_SIZE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Collect at least ``target`` distinct queries under ``out``, in whole rounds, or what ``max_rounds``
    rounds give; returns them (see ``collected``).

    ``ask`` turns a round's requests (request_id, round, prompt, n) into replies with at least the columns
    request_id and query (``asking`` makes one from a function). Failed requests are reply rows
    with a null query: they are kept under ``out`` and add nothing. A finished folder is returned as is."""
    done, total = 0, 0
    while done < max_rounds and total < target:
        raw, fresh = _folder(out, "replies", done), _folder(out, "collected", done)
        if not _committed(spark, fresh):
            if not _committed(spark, raw):
                requests = spark.range(done * workers, (done + 1) * workers, 1, workers).select(
                    F.col("id").alias("request_id"), F.lit(done).alias("round"), F.lit(prompt).alias("prompt"), F.lit(request_size).alias("n"))
                ask(requests).write.mode("overwrite").parquet(raw)
            new_queries(spark.read.parquet(raw), collected(spark, out, done), avoid, avoid_col).write.mode("overwrite").parquet(fresh)
        done += 1
        total += spark.read.parquet(fresh).count()
    return collected(spark, out, done)


def asking(fn: Callable[[str, int], list[str]], max_retries: int = 3, sleep: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """``ask`` of ``generate_until`` from a user function fn(prompt, n) -> queries (M3)."""
    return lambda requests: generate_with(requests, fn, max_retries=max_retries, sleep=sleep)


def failed_requests(spark: SparkSession, out: str) -> DataFrame:
    """(round, request_id, error, attempts) of the requests that gave nothing, for functions asked
    through ``asking``."""
    rows = spark.read.schema(f"{GENERATED_SCHEMA}, round int").parquet(f"{out.rstrip('/')}/replies")
    return rows.where("error IS NOT NULL").select("round", "request_id", "error", "attempts")
