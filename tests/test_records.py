import csv
import io
import json
import os
import random

import pytest

from labelforge.operators import translation as TR
from labelforge.sources import files as IO
from labelforge.sources import records as R

SCHEMA = "q string, l string, s string"


def odd_rows(n, seed):
    r = random.Random(seed)
    word = ["a", "é", ",", "\\", "\n", "\r", '"', "\\\n", "\n\n", "\\\\", " ", "longer words here", "\\,"]
    return [("".join(r.choice(word) for _ in range(r.randrange(12))), r.choice(["Chat", "Search"]), r.choice(["x", "y\\", "\n"])) for _ in range(n)]


def whole(rows):
    return sorted(tuple(v or "" for v in r) for r in rows)


def test_round_trip_with_breaks_separators_and_escapes(spark, tmp_dir):
    rows = [*odd_rows(500, 1), ("q", "l", "s"), (None, "", "only")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    IO.write_unquoted_lines(df.select(TR.unquoted_csv_line(["q", "l", "s"]).alias("line")), "line", tmp_dir + "/s6", header="q,l,s")
    got = R.read_unquoted(spark, tmp_dir + "/s6", SCHEMA)
    assert whole(got.collect()) == whole(rows) and got.where("q = ''").count() == 0


@pytest.mark.parametrize("split", [7, 64, 1000])
def test_one_file_in_splits_that_begin_inside_records(spark, tmp_dir, split):
    rows = [*odd_rows(300, split), ("\n" * 200, "l", "\\" * 41), ("e", "nd", "\n")]
    buf = io.StringIO()
    csv.writer(buf, quoting=csv.QUOTE_NONE, escapechar="\\", quotechar=None, lineterminator="\n").writerows([("q", "l", "s"), *rows])
    with open(f"{tmp_dir}/one.csv", "w", newline="", encoding="utf-8") as f:
        f.write(buf.getvalue())
    old = {c: spark.conf.get(c, None) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split * 10))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = R.read_unquoted(spark, f"{tmp_dir}/one.csv", SCHEMA)
        assert len(got.inputFiles()) == 1
        assert whole(got.collect()) == whole(rows)
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_a_record_of_the_wrong_width_stops_the_job(spark, tmp_dir):
    with open(f"{tmp_dir}/bad.csv", "w") as f:
        f.write("q,l,s\na,b,c\nd,e\n")
    with pytest.raises(Exception, match="2 fields, 3 expected"):
        R.read_unquoted(spark, f"{tmp_dir}/bad.csv", SCHEMA).collect()


def test_json_arrays_in_any_layout(spark, tmp_dir):
    items = ["plain", 'quo"te', "a, b", "[x]", "],", "", " lead", "line\nbreak", "tab\t\\", "é 😀", "{", "[", "]"]
    os.makedirs(f"{tmp_dir}/in")
    for name, text in (("pretty", json.dumps(items, indent=2)), ("flat", json.dumps(items, ensure_ascii=False)), ("none", "[]"), ("spaced", "[\n\n" + ",\n".join(json.dumps(x) for x in items) + "\n\n ]\n")):
        with open(f"{tmp_dir}/in/{name}.json", "w", encoding="utf-8") as f:
            f.write(text)
    assert sorted(r.query for r in R.read_json_arrays(spark, f"{tmp_dir}/in").collect()) == sorted(items * 3)


def test_json_array_files_hold_one_array_each_in_order(spark, tmp_dir):
    df = spark.range(1000).selectExpr("id", "if(id % 100 = 7, null, concat('t\"', id, char(10), ',]')) AS t").repartition(7)
    R.write_json_arrays(df, "t", "id", f"{tmp_dir}/out", files=3)
    files = sorted(f for f in os.listdir(f"{tmp_dir}/out") if f.startswith("part-"))
    parts = [json.load(open(f"{tmp_dir}/out/{f}")) for f in files if os.path.getsize(f"{tmp_dir}/out/{f}")]
    want = [f't"{i}\n,]' for i in range(1000) if i % 100 != 7]
    assert len(parts) == 3 and [x for p in parts for x in p] == want
    assert sorted(r.query for r in R.read_json_arrays(spark, f"{tmp_dir}/out").collect()) == sorted(want)


def test_a_broken_array_stops_the_job(spark, tmp_dir):
    with open(f"{tmp_dir}/x.json", "w") as f:
        f.write('["a",\n oops,\n"b"]')
    with pytest.raises(Exception):  # noqa: B017
        R.read_json_arrays(spark, f"{tmp_dir}/x.json").collect()


def test_group_documents_are_json_and_read_back_in_splits(spark, tmp_dir):
    r = random.Random(2)
    sizes = {"a": 5000, "b": 1, "c": 1024, "d": 1025}
    rows = [(g, i, r.randrange(2)) for g, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "grp string, gpos long, y int").repartition(6)
    from labelforge.operators import groups as G
    meta = spark.createDataFrame([(g, n) for g, n in sizes.items()] + [("empty", 0)], "grp string, n long")
    R.write_group_documents(meta, G.label_chunks(df, "grp", "gpos", "y"), f"{tmp_dir}/labels")
    for g, n in sizes.items():
        files = [f for f in os.listdir(f"{tmp_dir}/labels/grp={g}") if f.startswith("part-")]
        doc = json.load(open(f"{tmp_dir}/labels/grp={g}/{files[0]}"))
        assert len(files) == 1 and doc == {"grp": g, "n": n, "labels": [y for h, _, y in sorted(rows) if h == g]}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = R.read_group_labels(spark, f"{tmp_dir}/labels").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((x.grp, x.pos, x.y) for x in got) == sorted(rows)
