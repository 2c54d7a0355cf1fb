from pyspark.sql import Window
from pyspark.sql import functions as F

from labelforge.operators import position as P
from labelforge.operators import split as S


def test_shuffle_position_equals_global_window(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    got = P.shuffle_position(df, "k", 7).select("k", "pos")
    w = Window.orderBy(P.hash_key(7, "k"), "k")
    ref = df.select("k", (F.row_number().over(w) - 1).alias("pos"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_key_position_sparse_and_partitioned(spark):
    rows = [(k * 37 + (k % 5) * 1000003, k % 3) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, g int")
    got = {(r.k, r.pos) for r in P.key_position(df, "k", partition_by=["g"]).collect()}
    exp = set()
    for g in range(3):
        ks = sorted(k for k, gg in rows if gg == g)
        exp |= {(k, i) for i, k in enumerate(ks)}
    assert got == exp


def test_batches(spark):
    df = spark.range(0, 10).withColumnRenamed("id", "row_id")
    r = df.select(P.batch_id("row_id", 4).alias("b"), P.batch_name(P.batch_id("row_id", 4)).alias("n")).collect()
    assert [x.b for x in r] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    assert r[-1].n == "batch-000002"


def test_d2_sizes(spark):
    for n, train in [(0, 0), (1, 1), (5, 5), (10, 9), (1000, 801)]:
        df = spark.range(0, n).withColumnRenamed("id", "doc_id")
        c = {r.split: r["count"] for r in S.exact_split(df, "doc_id").groupBy("split").count().collect()}
        assert c.get("train", 0) == train
        assert sum(c.values()) == n
    c = {r.split: r["count"] for r in S.exact_split(spark.range(0, 1000).withColumnRenamed("id", "doc_id"), "doc_id")
         .groupBy("split").count().collect()}
    assert c == {"train": 801, "eval": 100, "test": 99}


def test_d3_carve(spark):
    df = spark.range(0, 100).withColumnRenamed("id", "k")
    assert S.carve_validation(df, "k").filter("part = 'val'").count() == 5
    assert S.carve_validation(spark.range(0, 3).withColumnRenamed("id", "k"), "k").filter("part = 'val'").count() == 1


def test_d4_upsample(spark):
    rows = [(i, "a") for i in range(3)] + [(10 + i, "b") for i in range(5)] + [(20 + i, "c") for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label string")
    up = S.upsample_classes(df, "label", "vec_id", seed=1)
    counts = {r.label: r["count"] for r in up.groupBy("label").count().collect()}
    assert counts == {"a": 5, "b": 5, "c": 5}
    draws = up.filter(F.col("draw").isNotNull()).collect()
    assert len(draws) == 2 and all(r.label == "a" for r in draws)
    assert {r.vec_id for r in up.filter("label = 'a'").collect()} == {0, 1, 2}


def test_u4_replicate_two_level(spark):
    df = spark.createDataFrame([(1, 10), (2, 1), (3, 0)], "k long, t int")
    r = S.replicate(df, "t", block=3).collect()
    got = sorted((x.k, x.copy) for x in r)
    assert got == [(1, c) for c in range(1, 11)] + [(2, 1)]


def test_d6_quota_rounds(spark):
    rows = [("a", 0), ("b", 0), ("a", 1), ("c", 1), ("d", 2), ("e", 3), ("x", 3)]
    df = spark.createDataFrame(rows, "q string, r long")
    avoid = spark.createDataFrame([("x",)], "query string")
    res = {r["round"]: (r.new, r.prior, r.kept) for r in S.quota_rounds(df, "q", "r", target=3, avoid=avoid).collect()}
    assert res == {0: (2, 0, True), 1: (1, 2, True), 2: (1, 3, False), 3: (1, 4, False)}


def test_range_partitions_stay_balanced_with_outliers(spark):
    df = spark.range(0, 20000).select(F.when(F.col("id") == 7, F.lit(10 ** 15)).otherwise(F.col("id")).alias("k"))
    packed = spark.range(0, 20000).select(F.when(F.col("id") == 7, F.lit(0.02)).otherwise(F.col("id") * 1e-11).alias("k"))
    far = spark.range(0, 20000).select((F.lit(10 ** 15) + F.when(F.col("id") == 7, F.lit(10 ** 12)).otherwise(F.col("id"))).alias("k"))
    text = spark.range(0, 20000).select(F.concat(F.lit("a-long-prefix-that-all-share/"), F.col("id")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for table in (df, packed, far, text):
            b = P.ordered(table, ["k"])
            mono = (b.groupBy("_part").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"))
                    .orderBy("_part").collect())
            assert all(x.hi < y.lo for x, y in zip(mono, mono[1:]))
            assert len(mono) > 4 and max(x.n for x in mono) <= 3 * 20000 / len(mono)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pos = {r.k: r.pos for r in P.key_position(df, "k").collect()}
    assert pos[10 ** 15] == 19999 and pos[0] == 0 and pos[8] == 7


def test_text_and_composite_keys(spark):
    rows = [(f"k{i % 97:03d}é" if i % 5 else None, -i, f"g{i % 3}" if i % 7 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, n long, g string")
    got = P.key_position(df, ["k", F.col("n").desc()], partition_by=["g"], total="m").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    assert len(got) == 600 and None in by
    for xs in by.values():
        want = sorted(xs, key=lambda r: (r.k is not None, r.k or "", -r.n))
        assert [r.pos for r in want] == list(range(len(xs))) and all(r.m == len(xs) for r in xs)


def test_vocabulary_ranks_with_many_single_tokens_of_one_prefix(spark):
    from labelforge.operators.embed import build_vocab
    toks = (spark.range(100_000).select(F.format_string("shared%06d", "id").alias("token"))
            .unionByName(spark.range(30_000).select(F.lit("hot").alias("token"))))
    v = build_vocab(toks)
    assert v.where("token = 'hot' and token_id = 0 and n = 30000").count() == 1
    assert v.where("token <> 'hot' and token_id <> 1 + cast(substring(token, 7) as long)").count() == 0 and v.count() == 100_001


def test_key_position_empty(spark):
    df = spark.range(0).withColumnRenamed("id", "k")
    assert P.key_position(df, "k").count() == 0


def test_null_ids_and_groups_keep_their_rows(spark):
    from labelforge.operators.position import shuffle_position
    df = spark.createDataFrame([(i if i % 5 else None, "g" if i % 3 else None) for i in range(100)], "id long, grp string")
    got = shuffle_position(df, "id", 42, partition_by=["grp"]).collect()
    assert len(got) == 100
    from labelforge.operators.split import exact_split
    assert exact_split(df.where("id is not null"), "id", 42, partition_by=["grp"]).count() == 80


def test_draws_reach_past_32_bits(spark):
    from pyspark.sql import functions as F
    from labelforge.operators.split import draw_index
    top = spark.range(2000).select(draw_index(42, F.lit("a"), F.col("id"), F.lit(10**11)).alias("d")).agg(F.max("d").alias("m")).first().m
    assert 2**32 < top < 10**11


def test_undeclared_group_stops_the_job(spark):
    import pytest
    from labelforge.operators.groups import corpus_ids
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, grp string")
    with pytest.raises(Exception, match="not in the declared order"):
        corpus_ids(df, ["a"], "id").collect()


def test_the_final_shuffle_is_a_permutation(spark):
    rows = [(i, "a") for i in range(3)] + [(10 + i, "b") for i in range(50)] + [(100 + i, None) for i in range(17)]
    df = spark.createDataFrame(rows, "vec_id long, label string")
    up = S.upsampled_shuffle(df, "label", "vec_id", seed=5)
    got = up.collect()
    assert up.columns == ["vec_id", "label", "copy", "draw", "position"] and sorted(r.position for r in got) == list(range(150))
    plain = S.upsample_classes(df, "label", "vec_id", seed=5).collect()
    assert sorted(str(tuple(r)) for r in plain) == sorted(str(tuple(r)[:4]) for r in got)
    again = {(r.vec_id, r.copy, r.draw): r.position for r in S.upsampled_shuffle(df.repartition(5), "label", "vec_id", seed=5).collect()}
    assert again == {(r.vec_id, r.copy, r.draw): r.position for r in got}
    other = [r.position for r in S.upsampled_shuffle(df, "label", "vec_id", seed=6).collect()]
    assert sorted(other) == list(range(150)) and other != [r.position for r in got]


def test_permuted_spreads_neighbours(spark):
    n = 5000
    at = [r.p for r in spark.range(n).select("id", S.permuted(F.col("id"), F.lit(n), 9).alias("p")).orderBy("id").collect()]
    assert sorted(at) == list(range(n))
    # neighbours land about n/3 apart on average, as in a random order, and each tenth fills each tenth alike
    assert abs(sum(abs(a - b) for a, b in zip(at, at[1:])) / (n - 1) - n / 3) < 0.05 * n
    cells = [sum(1 for x in at[k * 500:(k + 1) * 500] if x // 500 == j) for k in range(10) for j in range(10)]
    assert 20 <= min(cells) and max(cells) <= 90


def test_split_decides_rows_without_sorting_them(spark):
    import contextlib
    import io

    df = spark.range(4000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('g', id % 11)) AS g", "repeat('x', 50) AS text")
    s = S.exact_split(df, "id", 3, partition_by=["g"])
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        s.explain("formatted")
    assert "Window" not in buf.getvalue() and "Sort " not in buf.getvalue()
    p = P.shuffle_position(df.select("id", "g"), "id", 3, ["g"], total="n").collect()
    want = {}
    for r in p:
        t = min(r.n, int(0.8 * r.n) + 1)
        e = min(r.n - t, int(0.5 * (r.n - t)) + 1)
        want[r.id] = "train" if r.pos < t else "eval" if r.pos < t + e else "test"
    assert {r.id: r.split for r in s.collect()} == want


def test_rows_of_one_id_share_a_part(spark):
    df = spark.range(300).selectExpr("if(id % 10 = 0, null, id div 3) AS id", "id AS k")
    s = S.exact_split(df, "id", 1).collect()
    assert len(s) == 300 and all(len({r.split for r in s if r.id == i}) == 1 for i in {r.id for r in s})
