"""Equi-joins whose keys may be hot: detection by a bounded counter sketch, and a replicated,
salted join for the hot keys only (F7, F8, J8, and any join of many rows with one row per key)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 256      # a key with more than 1/256 of all rows is hot: at most 256 keys are
SKETCH_ITEMS = 4096  # counters of the sketch; it misses no key above about total / 3,000
SKETCH_GROUPS = 64   # sketches of the map tasks are merged in this many tasks first
SALTS = 64           # a hot key's rows go to this many places


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key): the values of ``key`` that hold more than 1/HOT_SHARE of the rows, at most HOT_SHARE of
    them, nulls left out. Counters of bounded size are kept per task and merged in two steps, so no
    task sees more than the sketches of a part of the others. It is one pass over the keys."""
    k = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), (F.spark_partition_id() % SKETCH_GROUPS).alias("_g"))
    part = k.groupBy("_g").agg(F.expr(f"approx_top_k_accumulate(_k, {SKETCH_ITEMS})").alias("_s"), F.count(F.lit(1)).alias("_n"))
    top = part.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s, {SKETCH_ITEMS}), {HOT_SHARE})").alias("_t"), F.sum("_n").alias("_n"))
    return (top.select("_n", F.explode("_t").alias("_e")).where(F.col("_e.count") * HOT_SHARE > F.col("_n"))
            .select(F.col("_e.item").alias(key)))


def salted_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, spread: Column,
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined with ``table`` (one row per key, bounded or not) on ``key``.

    ``hot`` lists the hot keys, at most HOT_SHARE rows (``hot_keys``, or counts the caller has), so it
    is broadcast. Their rows get a salt from ``spread`` (a hash of what tells the rows of one key
    apart), and their table rows are repeated once per salt; all others keep salt 0. It is one
    shuffle join in which no key has more than 1/HOT_SHARE of the rows, or 1/``salts`` of a hot
    key's. Null keys find no partner; with how = "left" their rows are salted too."""
    flag = F.broadcast(hot.select(F.col(key).alias("_hk"), F.lit(True).alias("_hot")))
    salt = F.pmod(spread, F.lit(salts)).cast("int")
    r = rows.join(flag, F.col(key) == F.col("_hk"), "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), salt).otherwise(0)).drop("_hk", "_hot")
    t = table.withColumnRenamed(key, "_tk")
    t = (t.join(flag, F.col("_tk") == F.col("_hk"), "left")
         .withColumn("_ts", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hk", "_hot"))
    return r.join(t, (F.col(key) == F.col("_tk")) & (F.col("_salt") == F.col("_ts")), how).drop("_salt", "_tk", "_ts")
