import pytest
from pyspark.sql import functions as F

from labelforge.plans import lifecycles as L


def _labeled(spark):
    rows = [("What is a cat?", "Chat", "chat", 0), ("What is a cat", "Chat", "chat", 1),
            ("weather paris", None, "short", 2), ("help", None, "general", 3),
            ("What is a cat?", "Chat", "chat", 4), ("write a haiku about autumn leaves", "Chat", "imperative_chat", 5)]
    return spark.createDataFrame(rows, "Query string, Label string, source string, row_id long")


def test_build_dataset_routes_dedupes_and_splits(spark, tmp_dir):
    avoid = spark.createDataFrame([("write a haiku about autumn leaves",)], "query string")
    out = L.build_dataset(_labeled(spark), avoid=avoid, out=tmp_dir + "/ds")
    rows = {r.row_id: (r.Query, r.Label) for r in out.collect()}
    # row 4 duplicates row 0 (dedupe happens before '?' removal); row 5 is held out
    assert set(rows) == {0, 1, 2, 3}
    assert rows[2] == ("weather paris", "Search") and rows[3] == ("help", "Chat")
    assert rows[0] == rows[1] == ("What is a cat", "Chat")          # Q4: duplicates can come back
    again = L.build_dataset(_labeled(spark), avoid=avoid, dedupe_after_clean=True)
    assert again.count() == 3
    back = spark.read.option("header", True).csv(tmp_dir + "/ds")
    assert back.count() == 4 and set(r.split for r in back.select("split").distinct().collect()) <= {"train", "eval", "test"}


def test_build_dataset_knows_file_stems(spark):
    """A source named after any subset's file gets that subset's policy."""
    from labelforge.operators import rules as R
    rows = [(f"write a long story about number {i}", None, f.rsplit("/", 1)[-1].removesuffix(".csv"), i) for i, (f, _p) in enumerate(R.SUBSET_REGISTRY.values())]
    out = L.build_dataset(spark.createDataFrame(rows, "Query string, Label string, source string, row_id long"))
    policy = {i: p for i, (_f, p) in enumerate(R.SUBSET_REGISTRY.values())}
    got = {r.row_id: r.Label for r in out.collect()}
    assert len(got) == len(rows) and all(got[i] == "Search" for i, p in policy.items() if p == "search")
    assert {got[i] for i, p in policy.items() if p != "search"} == {"Chat"}


def test_build_dataset_labeler_and_avoid_sources(spark):
    avoid = spark.createDataFrame([("weather paris",), ("write a haiku about autumn leaves",)], "query string")
    out = L.build_dataset(_labeled(spark), avoid=avoid, avoid_sources=["imperative_chat"], labeler=lambda q: "Chat")
    rows = {r.row_id: r.Label for r in out.collect()}
    assert set(rows) == {0, 1, 2, 3} and rows[3] == "Chat"

    def broken(q):
        raise RuntimeError("down")
    with pytest.raises(L.LabellingFailed, match="down"):
        L.build_dataset(_labeled(spark), labeler=broken)


def test_translate_table_restart_and_strict(spark, tmp_dir):
    df = spark.range(0, 30).select(F.col("id").alias("row_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("Query"),
                                   F.lit("Chat").alias("Label"))
    good, errors = L.translate_table(df, lambda q, lang: q.upper() + "?", "fr", tmp_dir + "/ok", batch_size=8, sleep=0)
    assert errors.count() == 0
    assert {r.row_id: r.Query for r in good.collect()}[7] == "Q7"

    def flaky(q, lang):
        if q == "q3":
            raise RuntimeError("quota")
        return q
    with pytest.raises(L.TranslationFailed, match="1 rows have an error"):
        L.translate_table(df, flaky, "fr", tmp_dir + "/bad", batch_size=8, sleep=0)
    res, err = L.translate_table(df, flaky, "fr", tmp_dir + "/bad", batch_size=8, sleep=0, strict=False)
    assert [tuple(r) for r in err.collect()] == [(3, "quota", "q3")]


def test_evaluate_groups_and_export(spark, tmp_dir):
    preds = spark.createDataFrame([("fr_val", 1, 0.9), ("fr_val", 0, 0.2), ("en_eval", 1, 0.4), ("en_eval", 0, 0.6)],
                                  "grp string, y int, prob double")
    wide, long = L.evaluate_groups(preds, [("dev", "fr_val"), ("dev", "en_eval"), ("fr", "fr_val")])
    w = {r.report: r for r in wide.collect()}
    assert w["dev"].n == 4 and w["fr"].auc == 1.0 and w["dev"].accuracy == 0.5
    labels = sorted(r.label for r in long.filter("report = 'fr'").collect())
    assert labels == ["Chat", "Search", "macro avg", "weighted avg"]
    g = spark.createDataFrame([(i, f"t{i}", "b" if i % 2 else "a", i % 2) for i in range(6)],
                              "doc_id long, text string, grp string, y int")
    c = L.export_corpus(g, ["a", "b"], tmp_dir + "/exp", key="doc_id")
    assert sorted(r.id for r in c.collect()) == list(range(6))
    meta = {r.grp: (r.n, r.off, r.n_pos) for r in spark.read.json(tmp_dir + "/exp/meta").collect()}
    assert meta == {"a": (3, 0, 0), "b": (3, 3, 3)}
