import itertools
import random

from pyspark.sql import functions as F

from labelforge.operators import corpus as C
from labelforge.operators import evaluate as EV


def test_a2_first_row_and_label_conflicts(spark):
    rows = [(1, "same text", "Chat", "b"), (2, "same text", "Search", "a"), (3, "dup", "Chat", "z"),
            (4, "dup", "Chat", "a"), (5, "dup", "Chat", "a")]
    df = spark.createDataFrame(rows, "doc_id long, query string, label string, source string")
    got = sorted(tuple(r) for r in C.dedupe_first(df, ["query", "label"], ["source", "doc_id"]).collect())
    assert got == [(1, "same text", "Chat", "b"), (2, "same text", "Search", "a"), (4, "dup", "Chat", "a")]


def test_j1_j2_avoid(spark):
    df = spark.createDataFrame([("Help",), ("help ",), ("summarize",), (None,)], "query string")
    avoid = spark.createDataFrame([("help",), ("summarize",)], "query string")
    exact = sorted(r.query or "" for r in C.remove_avoided(df, avoid).collect())
    assert exact == ["", "Help", "help "]
    norm = sorted(r.query or "" for r in C.remove_avoided(df, avoid, key=C.normalized_key).collect())
    assert norm == [""]


def _preds(spark, rows):
    return spark.createDataFrame(rows, "grp string, y int, prob double")


def _auc_pairs(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def test_auc_matches_pair_count_and_symmetry(spark):
    rnd = random.Random(3)
    rows = [("g", rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(300)]
    a = EV.auc(_preds(spark, rows), ["grp"]).collect()[0].auc
    assert abs(a - _auc_pairs(rows)) < 1e-12
    neg = [(g, y, -p) for g, y, p in rows]
    b = EV.auc(_preds(spark, neg), ["grp"]).collect()[0].auc
    assert abs(a + b - 1) < 1e-12


def test_auc_ties_and_one_class(spark):
    tied = [("t", i % 2, 0.3) for i in range(10)]
    one = [("o", 1, 0.1 * i) for i in range(5)]
    r = {x.grp: x.auc for x in EV.auc(_preds(spark, tied + one), ["grp"]).collect()}
    assert r["t"] == 0.5 and r["o"] is None


def test_metrics_zero_division_and_identities(spark):
    rows = [("g", 1, 0.1), ("g", 0, 0.2), ("g", 1, 0.3)]
    p = _preds(spark, rows).withColumn("pred", EV.threshold("prob"))
    m = EV.binary_metrics(EV.confusion(p, ["grp"])).collect()[0]
    assert (m.precision, m.recall, m.f1, m.tp, m.fn) == (0.0, 0.0, 0.0, 0, 2)
    rnd = random.Random(5)
    rows = [("h", rnd.randint(0, 1), rnd.random()) for _ in range(200)]
    p = _preds(spark, rows).withColumn("pred", EV.threshold("prob"))
    rep = EV.class_report(EV.confusion(p, ["grp"]), ["grp"])
    avg = EV.averaged_report(rep, ["grp"]).collect()[0]
    per = {r.label: r for r in rep.collect()}
    assert abs(avg.macro_f1 - (per["Chat"].f1 + per["Search"].f1) / 2) < 1e-12
    assert avg.support == 200


def test_threshold_tie_goes_to_search(spark):
    r = spark.createDataFrame([(0.5,), (0.4999,)], "p double").select(EV.threshold("p")).collect()
    assert [x[0] for x in r] == [1, 0]


def test_overlapping_reports_one_pass(spark):
    rows = [("fr_val", 1, 0.9), ("fr_val", 0, 0.1), ("en_eval", 1, 0.2), ("en_eval", 0, 0.7)]
    members = spark.createDataFrame([("dev", "fr_val"), ("dev", "en_eval"), ("fr", "fr_val")], "report string, grp string")
    x = EV.expand_memberships(_preds(spark, rows), members).drop("grp").withColumnRenamed("report", "grp")
    r = {z.grp: z for z in EV.group_report(x, ["grp"]).collect()}
    assert r["dev"].n == 4 and r["fr"].n == 2 and r["fr"].auc == 1.0 and r["dev"].accuracy == 0.5


def test_log_loss_and_parity(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.3)], "y int, prob double")
    import math
    ll = EV.log_loss(df, []).collect()[0].log_loss
    assert abs(ll - (-(math.log(0.8) + math.log(0.7)) / 2)) < 1e-12
    par = EV.parity(spark.createDataFrame([(0.1, 0.10001), (0.5, 0.5)], "a double, b double"), "a", "b").collect()[0]
    assert par["pass"] and par.n == 2


def test_stable_bce_equals_plain(spark):
    import math
    df = spark.createDataFrame([(2.0, 1), (-1.0, 0), (0.3, 0)], "z double, y int")
    got = [r[0] for r in df.select(EV.bce_with_logits("z", "y")).collect()]
    for (z, y), g in zip([(2.0, 1), (-1.0, 0), (0.3, 0)], got):
        p = 1 / (1 + math.exp(-z))
        assert abs(g - -(y * math.log(p) + (1 - y) * math.log(1 - p))) < 1e-12
