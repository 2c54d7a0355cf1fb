"""Classifier evaluation as aggregates.

Every metric is one grouped aggregate over (group, y, score) rows; nothing is collected. Groups
may overlap (A13): a membership table maps each row's group to every report it belongs to, and
one ``groupBy(report)`` computes all reports in a single pass.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.operators.position import ordered

LABELS = ("Chat", "Search")  # class 0, 1


def threshold(prob, thr: float = 0.5) -> Column:
    """Predicted class, prob >= thr (a tie goes to Search)."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p >= F.lit(thr)).cast("int")


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def confusion(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Tn, fp, fn, tp per group, labels fixed at [0, 1], in one pass."""
    yc, pc = F.col(y), F.col(pred)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((yc == 0) & (pc == 0)).alias("tn"), F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 1) & (pc == 0)).alias("fn"), F.count_if((yc == 1) & (pc == 1)).alias("tp"))


def binary_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 for positive = Search, zero_division = 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec, rec = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    return (cm.withColumn("accuracy", _safe_div(tp + tn, tp + tn + fp + fn))
            .withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f1", _safe_div(2 * tp, 2 * tp + fp + fn)))


def class_report(cm: DataFrame, by: Sequence[str]) -> DataFrame:
    """precision/recall/F1/support for each class (one row per group and class)."""
    long = cm.select(*by, F.expr(
        "stack(2, 'Chat', tn, fn, fp, tn + fp, 'Search', tp, fp, fn, tp + fn) "
        "as (label, hit, false_pos, false_neg, support)"))
    hit, fpos, fneg = F.col("hit"), F.col("false_pos"), F.col("false_neg")
    return (long.withColumn("precision", _safe_div(hit, hit + fpos))
            .withColumn("recall", _safe_div(hit, hit + fneg))
            .withColumn("f1", _safe_div(2 * hit, 2 * hit + fpos + fneg))
            .select(*by, "label", "precision", "recall", "f1", "support"))


def averaged_report(report: DataFrame, by: Sequence[str]) -> DataFrame:
    """Macro and support-weighted averages of the per-class rows."""
    s = F.col("support")
    tot = F.sum(s)
    return report.groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        _safe_div(F.sum(F.col("precision") * s), tot).alias("weighted_precision"),
        _safe_div(F.sum(F.col("recall") * s), tot).alias("weighted_recall"),
        _safe_div(F.sum(F.col("f1") * s), tot).alias("weighted_f1"),
        tot.alias("support"))


def auc(df: DataFrame, by: Sequence[str], y: str = "y", score: str = "prob") -> DataFrame:
    """A10: exact ROC AUC with ties counted one half (the rank-sum statistic).

    AUC = Σ_s pos(s) · (neg(< s) + neg(s)/2) / (P · N). Rows are first reduced to one row per
    distinct (group, score) by a partial aggregate, so tied scores never make a hot key. The
    running count of negatives below each score is a running sum in two levels: the distinct
    (group, score) rows are put in order by range partitions (balanced however the scores are
    spread), partition totals (a small table) give offsets, and a window partitioned by (group,
    range partition) sums inside. A group with one class only gives null."""
    return auc_from_scores(score_counts(df, by, y, score), by, score)


def score_counts(df: DataFrame, by: Sequence[str], y: str = "y", score: str = "prob") -> DataFrame:
    """(group, score, _pos, _neg): the partial aggregate every ranking metric starts from."""
    return df.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).alias("_pos"),
                                      F.count_if(F.col(y) == 0).alias("_neg"))


def auc_from_scores(per: DataFrame, by: Sequence[str], score: str = "prob") -> DataFrame:
    """A10 on the (group, score, _pos, _neg) table of ``score_counts``."""
    return _auc_in_order(ordered(per, [*by, score]), by)


def _auc_in_order(per: DataFrame, by: Sequence[str]) -> DataFrame:
    parts = list(by)
    w = Window.partitionBy(*parts).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per.groupBy(*parts, "_part").agg(F.sum("_neg").alias("_n"))
               .select(*[F.col(c).alias(f"_o_{c}") for c in parts], F.col("_part").alias("_o_part"),
                       F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off")))
    same = [F.col("_part") == F.col("_o_part"), *[F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in parts]]
    inside = Window.partitionBy(*parts, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (per.withColumn("_in", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(offsets, same)
              .withColumn("_below", F.col("_off") + F.col("_in")))
    agg = ranked.groupBy(*parts).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return agg.select(*parts, F.when((F.col("_P") == 0) | (F.col("_N") == 0), F.lit(None))
                      .otherwise(F.col("_u") / (F.col("_P") * F.col("_N"))).alias("auc"))


def expand_memberships(df: DataFrame, membership: DataFrame, grp: str = "grp",
                       report: str = "report") -> DataFrame:
    """Attach every report a row's group belongs to (a row may land in several). The planner
    broadcasts the membership table when its size is under the threshold, as it nearly always is."""
    return df.join(membership, grp)


def group_report(df: DataFrame, by: Sequence[str], y: str = "y", prob: str = "prob",
                 thr: float = 0.5) -> DataFrame:
    """Wide report per group: n, AUC, accuracy and the confusion cells (A8 + A9 + A10).
    Cells and AUC both come from one (group, score) pre-aggregate, so the predictions are read
    once."""
    per = ordered(score_counts(df, by, y, prob), [*by, prob])
    hi = F.col(prob) >= F.lit(thr)
    cells = per.groupBy(*by).agg(
        F.sum(F.col("_pos") + F.col("_neg")).alias("n"),
        F.sum(F.when(~hi, F.col("_neg")).otherwise(0)).alias("tn"), F.sum(F.when(hi, F.col("_neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hi, F.col("_pos")).otherwise(0)).alias("fn"), F.sum(F.when(hi, F.col("_pos")).otherwise(0)).alias("tp"))
    return binary_metrics(cells).join(_auc_in_order(per, by), list(by), "left")


def positive_rate(df: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """Positive rate and the class weight (1-p)/max(p, 1e-6)."""
    r = df.groupBy(*by).agg(F.avg(F.col(y).cast("double")).alias("pos_rate"),
                            F.sum(y).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("pos_weight", (1 - F.col("pos_rate")) / F.greatest(F.col("pos_rate"), F.lit(1e-6)))


def log_loss(df: DataFrame, by: Sequence[str], y: str = "y", prob: str = "prob",
             pos_weight: Column | None = None, eps: float = 1e-7) -> DataFrame:
    """Mean binary cross-entropy with an optional positive weight; p clipped to [eps, 1-eps]."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    w = pos_weight if pos_weight is not None else F.lit(1.0)
    yc = F.col(y).cast("double")
    loss = -(w * yc * F.log(p) + (1 - yc) * F.log(1 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


def bce_with_logits(z, y) -> Column:
    """Numerically stable per-row BCE on a logit (w = 1)."""
    zc = F.col(z) if isinstance(z, str) else z
    yc = (F.col(y) if isinstance(y, str) else y).cast("double")
    return F.greatest(zc, F.lit(0.0)) - zc * yc + F.log1p(F.exp(-F.abs(zc)))


def parity(df: DataFrame, a: str, b: str, tol: float = 1e-4, by: Sequence[str] = ()) -> DataFrame:
    """Max |a - b| and whether it is under the tolerance."""
    return (df.groupBy(*by).agg(F.max(F.abs(F.col(a) - F.col(b))).alias("max_abs_diff"),
                                F.count(F.lit(1)).alias("n"))
            .withColumn("pass", F.col("max_abs_diff") < tol))
