import json
import os

import pytest
from pyspark.sql import functions as F

from labelforge.operators import checks as CK
from labelforge.operators import translation as TR
from labelforge.operators import user_fn as U
from labelforge.sources import files as IO
from labelforge.sources import records as RD
from labelforge.streaming import jobs as J


def test_s1_csv_round_trip_keeps_text(spark, tmp_dir):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, "  padded  "), (4, ""), (5, None), (6, "NA")]
    df = spark.createDataFrame(rows, "rid long, query string")
    IO.write_csv(df, tmp_dir + "/q")
    back = sorted(tuple(r) for r in IO.read_csv(spark, tmp_dir + "/q", "rid long, query string").collect())
    # An empty text reads back as null, as pandas reads an empty CSV field (F1 turns it into '').
    assert back == sorted((k, None if v == "" else v) for k, v in rows)


def test_s2_stem_from_flat_folder(spark, tmp_dir):
    for stem, rows in {"timebound": [("price of gold", "Search")], "chat": [("how to knit", "Chat")]}.items():
        with open(os.path.join(tmp_dir, f"{stem}.csv"), "w") as f:
            f.write("Query,Label\n" + "".join(f"{q},{lab}\n" for q, lab in rows))
    with open(os.path.join(tmp_dir, "notes.txt"), "w") as f:
        f.write("ignore me")
    got = sorted(tuple(r) for r in IO.read_labeled_dir(spark, tmp_dir).collect())
    assert got == [("how to knit", "Chat", "chat"), ("price of gold", "Search", "timebound")]


def test_s3_pretty_printed_json_array(spark, tmp_dir):
    items = ["write a haiku about foxes", "summarize", 'quote " inside']
    with open(os.path.join(tmp_dir, "avoid.json"), "w") as f:
        json.dump(items, f, indent=2)
    assert sorted(r.query for r in RD.read_json_arrays(spark, tmp_dir).collect()) == sorted(items)


def test_json_array_chunks_round_trip(spark, tmp_dir):
    df = spark.range(0, 25).select(F.col("id").alias("pos"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("t"))
    RD.write_json_arrays(df, "t", "pos", tmp_dir + "/a", files=4)
    assert sorted(r.query for r in RD.read_json_arrays(spark, tmp_dir + "/a").collect()) == sorted(f"q{i}" for i in range(25))


def test_s6_unquoted_escapes(spark):
    df = spark.createDataFrame([('a,b"c\\d\ne', "Chat", None)], "q string, l string, s string")
    line = df.select(TR.unquoted_csv_line(["q", "l", "s"])).collect()[0][0]
    assert line == 'a\\,b\\"c\\\\d\\\ne,Chat,'


def test_s7_blank_lines_and_optional_field(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "batch-000000.jsonl"), "w") as f:
        f.write('{"row_id": 0, "translation": "bonjour"}\n\n{"row_id": 1, "translation": null, "error": "boom"}\n')
    r = sorted(tuple(x) for x in IO.read_jsonl(spark, tmp_dir, TR.RESULT_SCHEMA).collect())
    assert r == [(0, "bonjour", None), (1, None, "boom")]


def test_q10_last_batch_wins_and_error_table(spark):
    res = spark.createDataFrame([(0, "old", None, 0), (0, "new", None, 3), (1, None, None, 0), (2, None, "x", 1)],
                                "row_id long, translation string, error string, batch_id long")
    c = {r.row_id: r.translation for r in TR.consolidate(res).collect()}
    assert c == {0: "new", 1: None, 2: None}
    src = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "row_id long, query string")
    err = [tuple(r) for r in CK.error_table(src, TR.consolidate(res)).collect()]
    assert err == [(1, "unknown error", "b"), (2, "x", "c")]
    miss = CK.missing_rows(src, res).collect()[0]
    assert (miss.n_missing, miss.first_missing) == (1, 3)


def test_p4_required_columns(spark):
    df = spark.createDataFrame([("q",)], "Query string")
    CK.require_columns(df, ["Query"])
    with pytest.raises(CK.MissingColumns):
        CK.require_columns(df, ["Query", "Label"])


def test_f14_reply_length_check(spark):
    b = spark.createDataFrame([(0, ["a", "b"], ["Chat", "Search"]), (1, ["c", "d"], ["Chat"])],
                              "batch_id long, items array<string>, replies array<string>")
    r = sorted(tuple(x) for x in CK.zip_replies(b, "items", "replies").collect())
    assert r == [(0, 0, "a", "Chat", True), (0, 1, "b", "Search", True), (1, 0, "c", None, False), (1, 1, "d", None, False)]


def test_m1_m2_m3_user_functions(spark):
    calls = {"n": 0}

    def flaky(q, lang):
        if q == "bad":
            raise RuntimeError("service down")
        return q.upper() + "?"

    df = spark.createDataFrame([(0, "hello"), (1, "bad"), (2, None)], "row_id long, query string")
    r = {x.row_id: (x.translation, x.error, x.attempts) for x in U.translate_with(df, flaky, "fr", sleep=0).collect()}
    assert r[0] == ("HELLO", None, 1) and r[1] == (None, "service down", 3) and r[2][1] == "missing query text"
    lab = U.label_with(df.withColumnRenamed("row_id", "id").fillna("x"), lambda q: "Chat" if q == "hello" else "Maybe")
    got = {x.id: (x.label, x.error is None) for x in lab.collect()}
    assert got[0] == ("Chat", True) and got[1] == (None, False)
    reqs = spark.createDataFrame([(7, "p", 3)], "request_id long, prompt string, n int")
    gen = U.generate_with(reqs, lambda p, n: [f"{p}{i}" for i in range(n)]).collect()
    assert sorted(x.query for x in gen) == ["p0", "p1", "p2"]


def test_t1_restart_does_no_work(spark, tmp_dir):
    work = spark.range(0, 20).select(F.col("id").alias("row_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"),
                                     (F.col("id") / 8).cast("long").alias("batch_id"))

    def process(todo):
        res = U.translate_with(todo, lambda q, lang: q + "!", "fr", sleep=0)
        return res.join(todo.select("row_id", "batch_id"), "row_id").select("row_id", "translation", "error", "batch_id")

    out = tmp_dir + "/job"
    assert J.run_batches(work.filter("batch_id < 2"), process, out, TR.RESULT_SCHEMA) == 16
    assert J.run_batches(work, process, out, TR.RESULT_SCHEMA) == 4     # only the missing batch
    assert J.run_batches(work, process, out, TR.RESULT_SCHEMA) == 0     # nothing left
    res = J.read_results(spark, out, TR.RESULT_SCHEMA)
    assert res.count() == 20 and res.filter("translation = concat('q', row_id, '!')").count() == 20


def test_t1_keeps_finished_waves_after_a_crash(spark, tmp_dir):
    work = spark.range(0, 40).select(F.col("id").alias("row_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"),
                                     (F.col("id") / 8).cast("long").alias("batch_id"))
    out, schema = tmp_dir + "/job", TR.RESULT_SCHEMA

    def ok(todo):
        return U.translate_with(todo, lambda q, lang: q + "!", "fr", sleep=0, carry=["batch_id"]).select("row_id", "translation", "error", "batch_id")

    def dies(todo):
        bad = F.when(F.col("batch_id") == 4, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("batch_id"))
        return ok(todo).withColumn("batch_id", bad)

    with pytest.raises(Exception, match="lost"):
        J.run_batches(work, dies, out, schema, wave_batches=1)
    assert J.finished_ranges(spark, out) == [(0, 3)] and J.read_results(spark, out, schema).count() == 32
    assert J.run_batches(work, ok, out, schema, wave_batches=1) == 8
    assert J.read_results(spark, out, schema).where("translation = concat('q', row_id, '!')").count() == 40
    assert J.run_batches(work, ok, out, schema) == 0


def test_t1_stream_keeps_finished_micro_batches(spark, tmp_dir):
    for k in range(3):
        spark.range(8 * k, 8 * k + 8).select(F.col("id").alias("row_id"), F.lit("q").alias("query"), F.lit(k).cast("long").alias("batch_id")).coalesce(1).write.parquet(f"{tmp_dir}/inbox/{k}")

    def ok(todo):
        return todo.select("row_id", F.col("query").alias("translation"), F.lit(None).cast("string").alias("error"), "batch_id")

    def dies(todo):
        if todo.where("batch_id = 2").count():
            raise RuntimeError("lost")
        return ok(todo)

    args = (tmp_dir + "/out", tmp_dir + "/ck", 1)
    schema = "row_id long, query string, batch_id long"
    with pytest.raises(Exception):
        J.stream_batches(spark, f"{tmp_dir}/inbox/*", schema, dies, *args)
    kept = J.read_results(spark, tmp_dir + "/out", TR.RESULT_SCHEMA).count()
    assert J.stream_batches(spark, f"{tmp_dir}/inbox/*", schema, ok, *args) == 24 - kept
    assert J.read_results(spark, tmp_dir + "/out", TR.RESULT_SCHEMA).count() == 24


def test_t2_stream_equals_batch(spark, tmp_dir):
    src = tmp_dir + "/src"
    spark.createDataFrame([("a",), ("b",), ("a",)], "text string").write.parquet(src + "/r0")
    spark.createDataFrame([("c",), ("b",), ("x",)], "text string").write.parquet(src + "/r1")
    avoid = spark.createDataFrame([("x",)], "query string")
    out = J.stream_distinct(spark, src + "/*", "text string", "text", avoid, tmp_dir + "/sink", tmp_dir + "/ck")
    assert sorted(r.query for r in out.collect()) == ["a", "b", "c"]


def test_t1_streaming_form_processes_each_arrival_once(spark, tmp_dir):
    def process(todo):
        res = U.translate_with(todo, lambda q, lang: q + "!", "fr", sleep=0)
        return res.join(todo.select("row_id", "batch_id"), "row_id").select("row_id", "translation", "error", "batch_id")

    def arrive(lo, hi, name):
        spark.range(lo, hi).select(F.col("id").alias("row_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("query"),
                                   (F.col("id") / 8).cast("long").alias("batch_id")).write.parquet(f"{tmp_dir}/inbox/{name}")

    schema = "row_id long, query string, batch_id long"
    arrive(0, 16, "a")
    args = (f"{tmp_dir}/inbox/*", schema, process, tmp_dir + "/out", tmp_dir + "/ck")
    assert J.stream_batches(spark, *args) == 16
    arrive(16, 24, "b")
    assert J.stream_batches(spark, *args) == 8
    assert J.stream_batches(spark, *args) == 0
    res = J.read_results(spark, tmp_dir + "/out", TR.RESULT_SCHEMA)
    assert res.count() == 24 and res.filter("translation = concat('q', row_id, '!')").count() == 24


def test_s2_partitioned_folder_keeps_text_values(spark, tmp_dir):
    df = spark.createDataFrame([("q1", "Chat", "007"), ("q2", "Search", "timebound")], "Query string, Label string, source string")
    IO.write_csv(df, tmp_dir + "/p", partition_by=["source"])
    got = sorted(tuple(r) for r in IO.read_labeled_dir(spark, tmp_dir + "/p").collect())
    assert got == [("q1", "Chat", "007"), ("q2", "Search", "timebound")]


def test_m1_batched_labeller_checks_reply_length(spark):
    b = spark.createDataFrame([(0, ["a", "b"]), (1, ["c", "d", "e"])], "batch_id long, items array<string>")

    def fn(qs):
        return ["Chat"] * len(qs) if len(qs) == 2 else ["Chat"]

    r = {x.batch_id: x for x in U.label_batches_with(b, fn, max_retries=2).collect()}
    assert r[0].replies == ["Chat", "Chat"] and r[0].error is None and r[0].attempts == 1
    assert r[1].replies is None and "1 labels for 3 queries" in r[1].error and r[1].attempts == 2


def test_s6_sink_writes_header_then_lines(spark, tmp_dir):
    df = spark.createDataFrame([("a,b", "Chat", "x"), ("c", "Search", "y")], "q string, l string, s string")
    lines = df.select(TR.unquoted_csv_line(["q", "l", "s"]).alias("line"))
    IO.write_unquoted_lines(lines, "line", tmp_dir + "/s6", header="Query,Label,source")
    import glob
    parts = sorted(p for p in glob.glob(tmp_dir + "/s6/part-*"))
    text = "".join(open(p).read() for p in parts).splitlines()
    assert text[0] == "Query,Label,source" and sorted(text[1:]) == ["a\\,b,Chat,x", "c,Search,y"]


def test_generate_reports_failed_requests(spark):
    def broken(p, n):
        raise RuntimeError("down")
    reqs = spark.createDataFrame([(1, "x", 2)], "request_id long, prompt string, n int")
    rows = U.generate_with(reqs, broken).collect()
    assert [(r.request_id, r.pos, r.query, r.error, r.attempts) for r in rows] == [(1, None, None, "down", 3)]
