import pytest

from labelforge.operators import generate as G


def by_round(requests):
    """Deterministic replies: request k of round r returns q(10 r + k) .. 4 long, one shared text and a null."""
    from pyspark.sql import functions as F
    many = requests.select("request_id", "round", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    return many.select("request_id", F.when(F.col("i") == 3, F.lit(None)).when(F.col("i") == 2, F.lit("shared"))
                       .otherwise(F.concat(F.lit("q"), F.col("round") * 10 + F.col("request_id") % 4 + F.col("i"))).alias("query"))


def test_whole_rounds_until_the_target(spark, tmp_dir):
    got = G.generate_until(spark, by_round, "p", 9, tmp_dir, workers=4).collect()
    # a round gives q0..q4 and the shared text: 6, then 5 more
    assert {(r.query, r["round"]) for r in got} == {("shared", 0), *((f"q{k}", 0) for k in range(5)), *((f"q{10 + k}", 1) for k in range(5))}
    assert {r.request_id for r in got if r.query == "shared"} == {0}
    assert G.generate_until(spark, None, "p", 9, tmp_dir, workers=4).count() == 11  # a finished folder asks nobody


def test_avoid_list_and_round_limit(spark, tmp_dir):
    def limited(prompt, n):
        return [f"q{i % 7}" for i in range(n)]

    avoid = spark.createDataFrame([("q1",), ("q5",), (None,)], "query string")
    got = G.generate_until(spark, G.asking(limited), "p", 100, tmp_dir, avoid=avoid, workers=2, request_size=20, max_rounds=5)
    assert sorted(r.query for r in got.collect()) == ["q0", "q2", "q3", "q4", "q6"]
    import os
    assert sorted(os.listdir(f"{tmp_dir}/replies")) == [f"round={r:06d}" for r in range(5)]


def test_fifty_rounds_by_default(spark, tmp_dir):
    calls = []

    def ask(requests):
        calls.append(1)
        return requests.selectExpr("request_id", "'same' AS query").coalesce(1)
    assert G.generate_until(spark, ask, "p", 2, tmp_dir, workers=1).count() == 1 and len(calls) == 50


def test_a_crash_after_round_two_loses_nothing(spark, tmp_dir):
    asked = []

    def ask(requests):
        asked.append(requests.first()["round"])
        if len(asked) == 3:
            raise RuntimeError("service gone")
        return by_round(requests)
    with pytest.raises(RuntimeError, match="service gone"):
        G.generate_until(spark, ask, "p", 20, tmp_dir, workers=4)
    assert G.collected(spark, tmp_dir, 2).count() == 11
    got = G.generate_until(spark, ask, "p", 20, tmp_dir, workers=4)
    assert asked == [0, 1, 2, 2, 3] and got.count() == 21 and got.select("query").distinct().count() == 21


def test_a_crash_between_replies_and_queries_pays_once(spark, tmp_dir, monkeypatch):
    asked = []

    def ask(requests):
        asked.append(1)
        return by_round(requests)
    real = G.new_queries
    monkeypatch.setattr(G, "new_queries", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        G.generate_until(spark, ask, "p", 3, tmp_dir, workers=4)
    monkeypatch.setattr(G, "new_queries", real)
    assert G.generate_until(spark, ask, "p", 3, tmp_dir, workers=4).count() == 6 and len(asked) == 1


def test_failed_requests_are_kept_and_add_nothing(spark, tmp_dir):
    def refuses(prompt, n):
        raise ValueError("refused")

    assert G.generate_until(spark, G.asking(refuses, max_retries=2), "p", 1, tmp_dir, workers=2, max_rounds=2).count() == 0
    assert sorted((r["round"], r.request_id, r.error, r.attempts) for r in G.failed_requests(spark, tmp_dir).collect()) == [
        (r, 2 * r + k, "refused", 2) for r in range(2) for k in range(2)]


def test_streamed_rounds_equal_the_batch_over_three_arrivals(spark, tmp_dir):
    import os
    import shutil

    from labelforge.streaming import jobs as J
    lots = [[("a", 0), ("b", 0), ("a", 0), (None, 0), ("c", 1), ("a", 1)], [("d", 2), ("c", 2), (None, 2)], [("e", 3), ("a", 3), ("e", 4), ("f", 4)]]
    schema = "q string, r long"
    runs = []
    for k, lot in enumerate(lots):
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/inbox")
        if k == 1:  # a run that dies after its state was written and before the batch was committed
            J.stream_rounds(spark, f"{tmp_dir}/inbox", schema, "q", "r", f"{tmp_dir}/out", f"{tmp_dir}/ck")
            last = max(os.listdir(f"{tmp_dir}/ck/commits"), key=lambda n: (n.isdigit(), n))
            for n in (last, f".{last}.crc"):
                if os.path.exists(f"{tmp_dir}/ck/commits/{n}"):
                    shutil.move(f"{tmp_dir}/ck/commits/{n}", f"{tmp_dir}/{n}.moved")
        got = J.stream_rounds(spark, f"{tmp_dir}/inbox", schema, "q", "r", f"{tmp_dir}/out", f"{tmp_dir}/ck")
        runs.append([tuple(x) for x in got.orderBy("round").collect()])
    assert runs[0] == [(0, 4, 3, 3), (1, 2, 1, 4)]
    assert runs[1] == [*runs[0], (2, 3, 1, 5)]
    assert runs[2] == [*runs[1], (3, 2, 1, 6), (4, 2, 1, 7)]
