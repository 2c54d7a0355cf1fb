from pyspark.sql import functions as F

from labelforge.functions import labels as LB
from labelforge.functions import text as T


def _one(spark, col, values, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_f1_remove_question_marks(spark):
    assert _one(spark, T.remove_question_marks("x"), [None, "a?b?", "plain"]) == ["", "ab", "plain"]


def test_f2_strip_one_trailing_qmark_then_space(spark):
    got = _one(spark, T.strip_trailing_qmark("x"), ["a??", "ab? ", "x?\n", "  hi?", " q?　"])
    assert got == ["a?", "ab?", "x?", "hi", "q?"]


def test_word_count(spark):
    assert _one(spark, T.word_count("x"), ["", "  ", "one", " two  words ", "a\tb\nc"]) == [0, 0, 1, 2, 3]


def test_fill_template(spark):
    assert _one(spark, T.fill_template("into {}.", F.col("x")), ["French"]) == ["into French."]


def test_f6_nfkc_and_word_marks(spark):
    got = _one(spark, T.normalize_for_pieces("x"), ["ﬁne  day", "Ａ b"])
    assert got == ["▁fine▁day", "▁A▁b"]


def test_p5_label_domain(spark):
    got = _one(spark, LB.normalize_label("x"), [" chat ", "SEARCH", "other", None])
    assert got == [0, 1, None, None]


def test_p5_strict_raises(spark):
    import pytest
    df = spark.createDataFrame([("other",)], "x string")
    with pytest.raises(Exception, match="label outside the domain"):
        df.select(LB.normalize_label_strict("x")).collect()
    ok = spark.createDataFrame([(" chat ",), ("Search",)], "x string").select(LB.normalize_label_strict("x"))
    assert [r[0] for r in ok.collect()] == [0, 1]


def test_f4_maps_both_ways(spark):
    df = spark.createDataFrame([("Chat",), ("Search",), ("chat",)], "x string")
    r = df.select(LB.label_to_id("x").alias("i")).select("i", LB.id_to_label("i").alias("b")).collect()
    assert [(x.i, x.b) for x in r] == [(0, "Chat"), (1, "Search"), (None, None)]
