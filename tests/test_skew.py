"""Exactness when one key, score or group holds a third of all rows."""
import itertools
import random

from pyspark.sql import functions as F

from labelforge.operators import corpus as C
from labelforge.operators import evaluate as EV
from labelforge.operators import position as P
from labelforge.operators import split as S

N = 3000


def test_dedupe_with_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", "Chat", f"s{i % 7}") for i in range(N)]
    df = spark.createDataFrame(rows, "doc_id long, query string, label string, source string")
    out = {r.query: r.doc_id for r in C.dedupe_first(df, ["query", "label"], ["source", "doc_id"]).collect()}
    first_hot = min((s, i) for i, q, _, s in rows if q == "hot")[1]
    assert len(out) == 1 + sum(1 for i in range(N) if i % 3) and out["hot"] == first_hot


def test_auc_with_a_hot_score(spark):
    rnd = random.Random(11)
    rows = [("g", rnd.randint(0, 1), 0.5 if i % 3 == 0 else round(rnd.random(), 3)) for i in range(N)]
    got = EV.auc(spark.createDataFrame(rows, "grp string, y int, prob double"), ["grp"]).collect()[0].auc
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    exp = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12


def test_positions_with_a_hot_group(spark):
    rows = [(i, "big" if i % 3 == 0 else f"g{i % 50}") for i in range(N)]
    df = spark.createDataFrame(rows, "k long, g string")
    pos = P.key_position(df, "k", partition_by=["g"], total="n").collect()
    by = {}
    for r in pos:
        by.setdefault(r.g, []).append((r.k, r.pos, r.n))
    for g, xs in by.items():
        xs.sort()
        assert [p for _, p, _ in xs] == list(range(len(xs))) and all(n == len(xs) for _, _, n in xs)


def test_upsample_when_one_class_dominates(spark):
    rows = [(i, "big" if i % 3 else "small") for i in range(N)]
    df = spark.createDataFrame(rows, "vec_id long, label string")
    up = S.upsample_classes(df, "label", "vec_id", seed=3)
    counts = {r.label: r["count"] for r in up.groupBy("label").count().collect()}
    assert counts == {"big": 2000, "small": 2000}
    assert up.filter((F.col("label") == "small") & F.col("draw").isNotNull()).count() == 0


def test_hot_keys_and_their_salted_join(spark):
    from labelforge.operators.hot_join import hot_keys, salted_join
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("t"), F.col("id") % 997))
                                      .when(F.col("id") % 5 == 0, F.lit(None)).otherwise("unknown").alias("k"))
    table = spark.createDataFrame([("hot", 1), ("never", 2), *[(f"t{i}", 10 + i) for i in range(997)]], "k string, v int")
    hot = {r.k for r in hot_keys(rows, "k").collect()}
    assert {"hot", "unknown"} <= hot and len(hot) <= 256 and not any(k.startswith("t") for k in hot)
    for how in ("inner", "left"):
        got = salted_join(rows, table, "k", hot_keys(rows, "k"), F.xxhash64("id"), how)
        want = rows.join(table, "k", how).select("id", "k", "v")
        assert got.columns == ["id", "k", "v"] and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert hot_keys(rows.limit(0), "k").count() == 0


def test_no_join_task_holds_a_hot_token(spark):
    from labelforge.operators.hot_join import hot_keys, salted_join
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    table = spark.range(60_000).select(F.col("id").alias("k")).unionByName(spark.range(1).select(F.lit(-1).alias("k"))).withColumn("v", F.lit(1))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(old, ("-1", "64", "false")):
            spark.conf.set(c, v)
        got = salted_join(rows, table, "k", hot_keys(rows, "k"), F.xxhash64("id"))
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 60_000 and max(sizes) <= 0.05 * 60_000
