"""The reference's four flows as library calls, each one lazy DataFrame plan (actions only where
a flow writes or must fail).

- ``build_dataset``   (A): labelled files → route labels → hold-out removal → first-row dedupe →
  clean → exact split → optional CSV sink partitioned by split.
- ``translate_table`` (B): row ids → batches → restartable job with a user translator →
  consolidation (last batch wins) → error and completeness gates → join back (write it with
  ``translation.unquoted_csv_line`` + ``files.write_unquoted_lines`` for the S6 format).
- ``evaluate_groups`` (C): per-report confusion cells, AUC, accuracy, per-class and averaged
  metrics over possibly overlapping groups, in one pass per table.
- ``export_corpus``  (C/D): groups laid end to end with global ids, JSON lines + group metadata.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import remove_question_marks
from labelforge.operators import checks as CK
from labelforge.operators import corpus as C
from labelforge.operators import evaluate as EV
from labelforge.operators import groups as G
from labelforge.operators import rules as R
from labelforge.operators import split as S
from labelforge.operators import translation as TR
from labelforge.operators import user_fn as U
from labelforge.session import scratch_path, written
from labelforge.sources import files as IO
from labelforge.sources import records as RD
from labelforge.streaming import jobs as J


class TranslationFailed(RuntimeError):
    pass


class LabellingFailed(RuntimeError):
    pass


def _ask_labeler(df: DataFrame, fn: Callable[[str], str], id_col: str) -> DataFrame:
    """M1 for the rows that have no label and whose subset has no constant one. The replies are
    written once (a call is never repeated by a later action); a failed one stops the flow."""
    spark = df.sparkSession
    open_rows = df.where(F.col("Label").isNull() & ~F.col("source").isin(*R.constant_label_subsets()))
    path = scratch_path(spark, "labels")
    U.label_with(open_rows, fn, id_col, "Query").write.parquet(path)
    got = spark.read.parquet(path)
    failed = got.where("error is not null")
    if n := failed.count():
        raise LabellingFailed(f"{n} rows have no label; first error: {failed.first()['error']}")
    got = got.select(F.col("id").alias(id_col), F.col("label").alias("_told"))
    return df.join(got, id_col, "left").withColumn("Label", F.coalesce("Label", "_told")).drop("_told").select(*df.columns)


def build_dataset(labeled: DataFrame, avoid: DataFrame | None = None, seed=666, id_col: str = "row_id",
                  dedupe_after_clean: bool = False, out: str | None = None, labeler: Callable[[str], str] | None = None,
                  avoid_sources: Sequence[str] | None = None) -> DataFrame:
    """Lifecycle A on a table (Query, Label?, source, row_id). Rows without a label are
    labelled by ``labeler`` (M1) if given, else by their subset's policy (P3); the avoid list is
    removed (J1) from the rows of ``avoid_sources``, or from all; (Query, Label) is
    deduplicated keeping the first row by (source, row_id) (A2); '?' is removed (F1); the
    reference dedupes before cleaning (Q4), ``dedupe_after_clean`` dedupes once more after it;
    then the exact split (D2). With ``out`` the result is written as CSV partitioned by split."""
    df = labeled if "Label" in labeled.columns else labeled.withColumn("Label", F.lit(None).cast("string"))
    if labeler is not None:
        df = _ask_labeler(df, labeler, id_col)
    # the rule chain sees a text only where there is no label yet
    df = R.route_labels(df.withColumn("_ask", F.when(F.col("Label").isNull(), F.col("Query"))), "source", "_ask", name="_routed")
    df = df.withColumn("Label", F.coalesce("Label", "_routed")).drop("_ask", "_routed")
    if avoid is not None and avoid_sources is None:
        df = C.remove_avoided(df, avoid, query="Query")
    elif avoid is not None:
        listed = F.coalesce(F.col("source").isin(*avoid_sources), F.lit(False))
        df = C.remove_avoided(df.where(listed), avoid, query="Query").unionByName(df.where(~listed))
    df = C.dedupe_first(df, ["Query", "Label"], ["source", id_col])
    df = df.withColumn("Query", remove_question_marks("Query"))
    if dedupe_after_clean:
        df = C.dedupe_first(df, ["Query", "Label"], ["source", id_col])
    df = S.exact_split(written(df, "dataset"), id_col, seed)
    if out:
        IO.write_csv(df.select("Query", "Label", "source", "split"), out, partition_by=["split"])
    return df


def translate_table(df: DataFrame, fn: Callable[[str, str], str], lang: str, work_dir: str,
                    key: str = "row_id", text: str = "Query", batch_size: int = 512, max_retries: int = 3,
                    sleep: float = 2.0, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Lifecycle B. Returns (translated table, error table). Batches already under
    ``work_dir/results`` are not redone. With ``strict`` (the reference's behaviour, Q7) the
    error table is written to ``work_dir/errors`` and the call raises when any row failed or
    has no result."""
    spark = df.sparkSession
    src = df if key in df.columns else TR.with_row_ids(df, key)
    work = TR.with_batches(src, batch_size, key).select(key, F.col(text).alias("query"), "batch_id")
    out = f"{work_dir.rstrip('/')}/results"

    def process(todo: DataFrame) -> DataFrame:
        res = U.translate_with(todo, fn, lang, row_id=key, max_retries=max_retries, sleep=sleep, carry=["batch_id"])
        return res.select(key, "translation", "error", "batch_id")

    J.run_batches(work, process, out, TR.RESULT_SCHEMA)
    results = J.read_results(spark, out, TR.RESULT_SCHEMA, key)
    errors = CK.error_table(work, results, key)
    if strict:
        n_err = errors.count()
        miss = CK.missing_rows(work, results, key).collect()[0]
        if n_err:
            IO.write_jsonl(errors, f"{work_dir.rstrip('/')}/errors")
            raise TranslationFailed(f"{n_err} rows have an error; they are listed in {work_dir}/errors")
        if miss.n_missing:
            raise TranslationFailed(f"{miss.n_missing} rows have no result, from {key} {miss.first_missing} on")
    joined = TR.attach_results(src, results, key)
    keep = [c for c in src.columns if c not in (text,)]
    return joined.select(*keep, F.col("translation").alias(text)), errors


def evaluate_groups(preds: DataFrame, reports: Sequence[tuple[str, str]], grp: str = "grp", y: str = "y",
                    prob: str = "prob", thr: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Lifecycle C. ``reports`` lists (report, group) memberships; a group may feed several
    reports. Returns the wide table (report, n, accuracy, auc, tn, fp, fn, tp) and the long one
    (report, label or average, precision, recall, f1, support)."""
    spark = preds.sparkSession
    members = spark.createDataFrame(list(reports), f"report string, {grp} string")
    rows = EV.expand_memberships(preds.select(grp, y, prob), members, grp).drop(grp)
    wide = EV.group_report(rows, ["report"], y, prob, thr)
    p = rows.withColumn("pred", EV.threshold(prob, thr))
    per_class = EV.class_report(EV.confusion(p, ["report"], y, "pred"), ["report"])
    avg = EV.averaged_report(per_class, ["report"])
    macro = avg.select("report", F.lit("macro avg").alias("label"), F.col("macro_precision").alias("precision"),
                       F.col("macro_recall").alias("recall"), F.col("macro_f1").alias("f1"), "support")
    weighted = avg.select("report", F.lit("weighted avg").alias("label"),
                          F.col("weighted_precision").alias("precision"), F.col("weighted_recall").alias("recall"),
                          F.col("weighted_f1").alias("f1"), "support")
    return wide, per_class.unionByName(macro).unionByName(weighted)


def export_corpus(groups: DataFrame, order: Sequence[str], out: str, key: str, text: str = "text",
                  grp: str = "grp", y: str = "y") -> DataFrame:
    """Groups laid end to end in ``order``: JSON lines {id, text} under ``out/corpus``, the group metadata
    (order, count, offset, positives) under ``out/meta``, and under ``out/labels`` one JSON document per
    group: its metadata and its whole ordered label list, streamed chunk by chunk."""
    c = G.corpus_ids(groups, order, key=key, grp=grp)
    IO.write_jsonl(c.select("id", F.col(text).alias("text"), grp, y), f"{out.rstrip('/')}/corpus")
    meta = G.group_offsets(c, order, grp).join(
        c.groupBy(grp).agg(F.sum(y).alias("n_pos")), grp, "left").fillna(0, ["n_pos"])
    IO.write_jsonl(meta, f"{out.rstrip('/')}/meta")
    RD.write_group_documents(meta, G.label_chunks(c, grp, "gpos", y), f"{out.rstrip('/')}/labels", grp)
    return c
