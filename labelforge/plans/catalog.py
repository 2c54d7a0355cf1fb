"""Registered queries: one per operator of the inventory, each a Spark plan over the driver
tables (spark, sf_dir) → DataFrame, with the DuckDB statement that must give the same rows.

Computed columns carry the same names on both sides; floats are compared rounded to 4 places;
arrays are flattened to text or to long (id, dim, value) rows so value hashes are stable.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.functions import text as T
from labelforge.functions.vectors import round4
from labelforge.operators import corpus as C
from labelforge.operators import evaluate as EV
from labelforge.operators import groups as G
from labelforge.operators import rules as R
from labelforge.operators import split as S
from labelforge.operators.position import shuffle_position
from labelforge.plans import views as V
from labelforge.plans.oracle_sql import f2 as f2_sql
from labelforge.plans.oracle_sql import py_strip as strip_sql
from labelforge.plans.oracle_sql import q, r4, rule_sql, split_case, weak_label_sql, weak_rule_sql
from labelforge.session import scratch_path, written
from labelforge.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

BATCH_SIZE = 64          # translation batch size of the registered job
REQUEST_BATCH = 50       # labelling request size
ROUND_TARGET = 500       # distinct queries wanted by the quota rounds
FR_OVERSAMPLE = 3
PARITY_K = 64
MAX_LEN = 48


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _dedup_clean(spark, d):
    """labeled → A2 (first by source, doc_id) → F1."""
    dd = C.dedupe_first(V.labeled(spark, d).select("doc_id", "query", "label", "source"),
                        keys=["query", "label"], order=["source", "doc_id"])
    return dd.withColumn("query", T.remove_question_marks("query"))


_DEDUP_SQL = """
dd AS (SELECT * FROM (SELECT doc_id, query, label, source,
         row_number() OVER (PARTITION BY query, label ORDER BY source, doc_id) AS _rn FROM labeled) WHERE _rn = 1),
cl AS (SELECT doc_id, coalesce(replace(query, '?', ''), '') AS query, label, source FROM dd),
sp AS (SELECT *, row_number() OVER (ORDER BY md5('666:' || doc_id), doc_id) - 1 AS _pos,
              count(*) OVER () AS _n FROM cl),
spl AS (SELECT doc_id, query, label, source,
               """ + split_case("_pos", "_n", "'train'", "'eval'", "'test'") + """ AS split FROM sp)
"""


# ---------------------------------------------------------------- lifecycle A: dataset build
@register("d2_split_label_counts", q("SELECT split, label, count(*) AS n FROM spl GROUP BY split, label", _DEDUP_SQL))
def d2_split_label_counts(spark, d):
    """Flagship: labeled → dedupe → clean → exact split → rows per (split, label)."""
    clean = written(_dedup_clean(spark, d).select("doc_id", "label"), "clean")
    return S.exact_split(clean, "doc_id", V.SPLIT_SEED).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("d2_exact_split", q("SELECT doc_id, split FROM spl", _DEDUP_SQL))
def d2_exact_split(spark, d):
    clean = written(_dedup_clean(spark, d).select("doc_id"), "clean")
    return S.exact_split(clean, "doc_id", V.SPLIT_SEED)


@register("a2_dedupe_first", q("SELECT doc_id, query, label, source FROM dd", _DEDUP_SQL))
def a2_dedupe_first(spark, d):
    return C.dedupe_first(V.labeled(spark, d).select("doc_id", "query", "label", "source"),
                          keys=["query", "label"], order=["source", "doc_id"])


@register("d1_seeded_shuffle", q("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos FROM documents"))
def d1_seeded_shuffle(spark, d):
    return shuffle_position(table(spark, d, "documents").select("doc_id"), "doc_id", 42)


@register("f1_strip_question_marks", q("SELECT subset, rid, coalesce(replace(query, '?', ''), '') AS cleaned FROM queries"))
def f1_strip_question_marks(spark, d):
    return V.queries(spark, d).select("subset", "rid", T.remove_question_marks("query").alias("cleaned"))


@register("f2_strip_trailing_qmark", q(f"SELECT subset, rid, {f2_sql('query')} AS cleaned FROM queries"))
def f2_strip_trailing_qmark(spark, d):
    return V.queries(spark, d).select("subset", "rid", T.strip_trailing_qmark("query").alias("cleaned"))


@register("p9_weak_labels", q(f"SELECT subset, rid, {weak_label_sql('query')} AS label, "
                              f"{weak_rule_sql('query')} AS rule FROM queries"))
def p9_weak_labels(spark, d):
    return R.apply_rules(V.queries(spark, d)).select("subset", "rid", "label", "rule")


@register("p3_route_labels", q(f"SELECT subset, rid, CASE WHEN subset IN ('url', 'short') THEN 'Search' "
                               f"ELSE {weak_label_sql('query')} END AS label FROM queries"))
def p3_route_labels(spark, d):
    return R.route_labels(V.queries(spark, d)).select("subset", "rid", "label")


def _flags_sql():
    r = rule_sql("query")
    low = f"lower({strip_sql('coalesce(query, ' + chr(39) * 2 + ')')})"
    from labelforge.plans.oracle_sql import word_count
    parts = [f"CASE WHEN subset = 'short' AND {word_count(low)} >= 4 THEN 'short_too_long' END",
             f"CASE WHEN subset = 'chat' AND {r['url']} THEN 'chat_has_url' END",
             f"CASE WHEN contains({low}, 'what are the pros of') THEN 'generic_filler' END",
             f"CASE WHEN subset IN ('url', 'short') AND {r['tab_ref']} THEN 'tab_ref_in_search' END"]
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return f"SELECT subset, rid, array_to_string({arr}, ',') AS flags, len({arr})::INTEGER AS n_flags FROM queries"


@register("p10_rule_flags", q(_flags_sql()))
def p10_rule_flags(spark, d):
    return R.rule_flags(V.queries(spark, d)).select("subset", "rid", "flags", "n_flags")


@register("p10_rule_summary", q("SELECT subset, count(*) AS n, sum(CASE WHEN n_flags > 0 THEN 1 ELSE 0 END)::BIGINT AS n_flagged "
                                "FROM (" + _flags_sql() + ") GROUP BY subset"))
def p10_rule_summary(spark, d):
    f = R.rule_flags(V.queries(spark, d))
    return f.groupBy("subset").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum((F.col("n_flags") > 0).cast("long")).alias("n_flagged"))


@register("j1_avoid_benchmark", q("SELECT subset, rid FROM queries v WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = v.query)"))
def j1_avoid_benchmark(spark, d):
    avoid = table(spark, d, "benchmark").select(F.col("text").alias("query"))
    return C.remove_avoided(V.queries(spark, d), avoid).select("subset", "rid")


@register("j1_holdout_labeled", q("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labeled l WHERE l.query = d.text)"))
def j1_holdout_labeled(spark, d):
    """Held-out labelled texts removed from the whole candidate pool (this hold-out really hits)."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("query"))
    return C.remove_avoided(docs, V.labeled(spark, d).select("query")).select("doc_id")


@register("j2_avoid_normalized", q(f"SELECT subset, rid FROM queries v WHERE NOT EXISTS (SELECT 1 FROM labeled l "
                                   f"WHERE lower({strip_sql('l.query')}) = lower({strip_sql('v.query')}))"))
def j2_avoid_normalized(spark, d):
    return C.remove_avoided(V.queries(spark, d), V.labeled(spark, d).select("query"),
                            key=C.normalized_key).select("subset", "rid")


@register("a1_distinct_queries", q("SELECT DISTINCT subset, query FROM queries"))
def a1_distinct_queries(spark, d):
    return C.distinct_queries(V.queries(spark, d), ["subset", "query"])


@register("u1_concat_fresh_index", q(
    "SELECT subset, rid, off + row_number() OVER (PARTITION BY subset ORDER BY rid) - 1 AS pos FROM "
    "(SELECT *, (sum(n) OVER (ORDER BY o))::BIGINT - n AS off FROM (SELECT subset, count(*) AS n, "
    "CASE subset WHEN 'url' THEN 0 WHEN 'chat' THEN 1 WHEN 'short' THEN 2 ELSE 3 END AS o "
    "FROM queries GROUP BY subset)) s JOIN queries USING (subset)"))
def u1_concat_fresh_index(spark, d):
    qv = V.queries(spark, d)
    return G.corpus_ids(qv, ["url", "chat", "short", "general"], key="rid", grp="subset",
                        name="pos").select("subset", "rid", "pos")


@register("u2_rounds_union", q("SELECT text AS query FROM documents UNION SELECT text FROM conversations "
                              "WHERE role = 'user' UNION SELECT text FROM benchmark"))
def u2_rounds_union(spark, d):
    """Three collection rounds (documents, user turns, benchmark items) united as a set."""
    rounds = [table(spark, d, "documents").select(F.col("text").alias("query")),
              table(spark, d, "conversations").filter(F.col("role") == "user").select(F.col("text").alias("query")),
              table(spark, d, "benchmark").select(F.col("text").alias("query"))]
    return C.union_rounds(rounds)


@register("u3_set_difference", q("SELECT text AS query FROM documents EXCEPT SELECT query FROM labeled"))
def u3_set_difference(spark, d):
    return C.set_difference(table(spark, d, "documents").select(F.col("text").alias("query")),
                            V.labeled(spark, d).select("query"))


_ROUNDS_SQL = """
rq AS (SELECT text AS q, CAST(substr(source, 4) AS BIGINT) AS round FROM documents d
       WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)),
fr AS (SELECT q, min(round) AS round FROM rq GROUP BY q),
pr AS (SELECT round, count(*) AS new FROM fr GROUP BY round),
rr AS (SELECT r.round, coalesce(p.new, 0) AS new FROM (SELECT DISTINCT round FROM rq) r LEFT JOIN pr p USING (round)),
rt AS (SELECT round, new, (sum(new) OVER (ORDER BY round))::BIGINT AS total,
              row_number() OVER (ORDER BY round) - 1 AS idx FROM rr)
"""


@register("d6_quota_rounds", q(f"SELECT round, new, total, total - new AS prior, "
                               f"(total - new < {ROUND_TARGET} AND idx < 50) AS kept FROM rt", _ROUNDS_SQL))
def d6_quota_rounds(spark, d):
    docs = table(spark, d, "documents").withColumn("round", F.substring("source", 4, 10).cast("long"))
    avoid = table(spark, d, "benchmark").select(F.col("text").alias("query"))
    return S.quota_rounds(docs, "text", "round", ROUND_TARGET, 50, avoid=avoid).select(
        "round", "new", "total", "prior", "kept")


@register("d6_generate_until", q(f"""SELECT t.query, min(t.round) AS round FROM (
  SELECT text AS query, substr(source, 4)::BIGINT AS round FROM documents WHERE text NOT IN (SELECT text FROM benchmark WHERE text IS NOT NULL)) t
  WHERE t.round IN (SELECT round FROM rt WHERE total - new < {ROUND_TARGET} AND idx < 50) GROUP BY t.query""", _ROUNDS_SQL))
def d6_generate_until(spark, d):
    """Generation until the quota. Round r's replies are the texts of source r, dealt to its requests."""
    from labelforge.operators.generate import generate_until
    docs = table(spark, d, "documents").select(F.col("text").alias("query"), F.substring("source", 4, 10).cast("int").alias("of"), F.pmod("doc_id", F.lit(8)).alias("part"))

    def ask(requests):
        mine = requests.select("request_id", F.col("round").alias("r"), F.pmod("request_id", F.lit(8)).alias("p"))
        return docs.join(mine, (F.col("of") == F.col("r")) & (F.col("part") == F.col("p"))).select("request_id", "query")

    avoid = table(spark, d, "benchmark").select(F.col("text").alias("query"))
    got = generate_until(spark, ask, "texts", ROUND_TARGET, scratch_path(spark, "d6-rounds"), avoid=avoid)
    return got.select("query", F.col("round").cast("long").alias("round"))


# ---------------------------------------------------------------- lifecycle C: evaluation
@register("w4_group_offsets", q("SELECT grp, min(ord) AS ord, count(*) AS n, "
                                "(sum(count(*)) OVER (ORDER BY min(ord)))::BIGINT - count(*) AS off FROM groups_o GROUP BY grp"))
def w4_group_offsets(spark, d):
    return G.group_offsets(V.groups(spark, d), V.GROUP_ORDER).select("grp", "ord", "n", "off")


@register("a4_group_counts", q("SELECT grp, count(*) AS n FROM groups GROUP BY grp"))
def a4_group_counts(spark, d):
    return V.groups(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@register("s4_group_union", q("SELECT doc_id, grp, lang, query, label FROM groups"))
def s4_group_union(spark, d):
    return V.groups(spark, d).select("doc_id", "grp", "lang", "query", "label")


@register("s8_corpus_ids", q("SELECT id, doc_id, grp, query AS text FROM corpus"))
def s8_corpus_ids(spark, d):
    return G.corpus_ids(V.groups(spark, d), V.GROUP_ORDER, key="doc_id").select(
        "id", "doc_id", "grp", F.col("query").alias("text"))


@register("j6_range_join", q("SELECT c.id, o.grp FROM corpus c JOIN (SELECT grp, count(*) AS n, "
                             "(sum(count(*)) OVER (ORDER BY min(ord)))::BIGINT - count(*) AS off FROM groups_o GROUP BY grp) o "
                             "ON c.id >= o.off AND c.id < o.off + o.n"))
def j6_range_join(spark, d):
    ids = G.corpus_ids(V.groups(spark, d).select("doc_id", "grp"), V.GROUP_ORDER, key="doc_id").select("id", "grp")
    offs = G.group_offsets(ids, V.GROUP_ORDER)
    return G.range_join(ids.select("id"), "id", offs).select("id", "grp")


@register("a5_label_chunks", q("SELECT grp, gpos // 1024 AS chunk, string_agg(y::VARCHAR, '' ORDER BY gpos) AS labels "
                               "FROM corpus GROUP BY grp, chunk"))
def a5_label_chunks(spark, d):
    c = G.corpus_ids(V.groups(spark, d).select("doc_id", "grp", "y"), V.GROUP_ORDER, key="doc_id")
    return G.label_chunks(c, "grp", "gpos", "y")


@register("l2_first_k_per_group", q(f"SELECT grp, id, doc_id FROM corpus WHERE grp IN ('fr_val', 'en_eval') AND gpos < {PARITY_K}"))
def l2_first_k_per_group(spark, d):
    from pyspark.sql import Window
    c = G.corpus_ids(V.groups(spark, d).select("doc_id", "grp"), V.GROUP_ORDER, key="doc_id").filter(F.col("grp").isin("fr_val", "en_eval"))
    w = Window.partitionBy("grp").orderBy("id")
    return c.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= PARITY_K).select("grp", "id", "doc_id")


@register("p6_threshold", q("SELECT doc_id, grp, y, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM preds"))
def p6_threshold(spark, d):
    return V.preds(spark, d).select("doc_id", "grp", "y", EV.threshold("prob").alias("pred"))


_CM_SQL = """
cm AS (SELECT grp, count(*) AS n,
         count(*) FILTER (WHERE y = 0 AND prob < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND prob >= 0.5) AS fp,
         count(*) FILTER (WHERE y = 1 AND prob < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND prob >= 0.5) AS tp
       FROM preds GROUP BY grp)
"""


def _div(a, b):
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END)"


@register("a8_confusion", q("SELECT grp, n, tn, fp, fn, tp FROM cm", _CM_SQL))
def a8_confusion(spark, d):
    p = V.preds(spark, d).withColumn("pred", EV.threshold("prob"))
    return EV.confusion(p, ["grp"])


@register("a9_binary_metrics", q(
    f"SELECT grp, {r4(_div('tp + tn', 'n'))} AS accuracy, {r4(_div('tp', 'tp + fp'))} AS precision, "
    f"{r4(_div('tp', 'tp + fn'))} AS recall, {r4(_div('2 * tp', '2 * tp + fp + fn'))} AS f1 FROM cm", _CM_SQL))
def a9_binary_metrics(spark, d):
    p = V.preds(spark, d).withColumn("pred", EV.threshold("prob"))
    m = EV.binary_metrics(EV.confusion(p, ["grp"]))
    return m.select("grp", *[round4(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_AUC_SQL = """
sc AS (SELECT grp, prob, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
       FROM {src} GROUP BY grp, prob),
sr AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY grp ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc),
au AS (SELECT grp, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL
                   ELSE sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) END AS auc FROM sr GROUP BY grp)
"""


@register("a10_auc", q(f"SELECT grp, {r4('auc')} AS auc FROM au", _AUC_SQL.format(src="preds")))
def a10_auc(spark, d):
    a = EV.auc(V.preds(spark, d), ["grp"])
    return a.select("grp", round4("auc").alias("auc"))


_REP_SQL = _CM_SQL + """,
cr AS (SELECT grp, 'Chat' AS label, tn AS hit, fn AS fpos, fp AS fneg, tn + fp AS support FROM cm
       UNION ALL SELECT grp, 'Search', tp, fp, fn, tp + fn FROM cm),
crm AS (SELECT grp, label, """ + _div("hit", "hit + fpos") + " AS precision, " + _div("hit", "hit + fneg") + \
    " AS recall, " + _div("2 * hit", "2 * hit + fpos + fneg") + " AS f1, support FROM cr)"


@register("a11_class_report", q(f"SELECT grp, label, {r4('precision')} AS precision, {r4('recall')} AS recall, "
                                f"{r4('f1')} AS f1, support::BIGINT AS support FROM crm", _REP_SQL))
def a11_class_report(spark, d):
    p = V.preds(spark, d).withColumn("pred", EV.threshold("prob"))
    rep = EV.class_report(EV.confusion(p, ["grp"]), ["grp"])
    return rep.select("grp", "label", *[round4(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("a12_avg_report", q(
    "SELECT grp, " + ", ".join(
        [f"{r4('avg(' + m + ')')} AS macro_{m}" for m in ("precision", "recall", "f1")]
        + [f"{r4(_div('sum(' + m + ' * support)', 'sum(support)'))} AS weighted_{m}" for m in ("precision", "recall", "f1")])
    + ", sum(support)::BIGINT AS support FROM crm GROUP BY grp", _REP_SQL))
def a12_avg_report(spark, d):
    p = V.preds(spark, d).withColumn("pred", EV.threshold("prob"))
    rep = EV.class_report(EV.confusion(p, ["grp"]), ["grp"])
    a = EV.averaged_report(rep, ["grp"])
    cols = [f"{k}_{m}" for k in ("macro", "weighted") for m in ("precision", "recall", "f1")]
    return a.select("grp", *[round4(c).alias(c) for c in cols], "support")


REPORTS = [("Dev combined", "fr_val"), ("Dev combined", "en_eval"), ("Dev French", "fr_val"),
           ("Dev English", "en_eval"), ("Test French", "fr_test"), ("Test English", "en_test")]
_MEMBERS_SQL = "members AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{g}')" for r, g in REPORTS) + ") t(report, grp))"


@register("a13_overlapping_report", q(
    f"SELECT r.report AS grp, r.n, {r4('r.accuracy')} AS accuracy, {r4('a.auc')} AS auc, r.tn, r.fp, r.fn, r.tp FROM "
    "(SELECT grp AS report, count(*) AS n, count(*) FILTER (WHERE y = 0 AND prob < 0.5) AS tn, "
    "count(*) FILTER (WHERE y = 0 AND prob >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND prob < 0.5) AS fn, "
    "count(*) FILTER (WHERE y = 1 AND prob >= 0.5) AS tp, "
    "avg(CASE WHEN (y = 1) = (prob >= 0.5) THEN 1.0 ELSE 0.0 END) AS accuracy FROM mp GROUP BY grp) r "
    "LEFT JOIN au a ON a.grp = r.report",
    _MEMBERS_SQL + ",\nmp AS (SELECT m.report AS grp, p.y, p.prob FROM preds p JOIN members m ON p.grp = m.grp),\n"
    + _AUC_SQL.format(src="mp")))
def a13_overlapping_report(spark, d):
    members = spark.createDataFrame(REPORTS, "report string, grp string")
    rows = EV.expand_memberships(V.preds(spark, d), members).drop("grp").withColumnRenamed("report", "grp")
    r = EV.group_report(rows, ["grp"])
    return r.select("grp", "n", round4("accuracy").alias("accuracy"), round4("auc").alias("auc"),
                    "tn", "fp", "fn", "tp")


@register("a6_positive_rate", q(f"SELECT grp, {r4('avg(y)')} AS pos_rate, sum(y)::BIGINT AS n_pos, count(*) AS n, "
                                f"{r4('(1 - avg(y)) / greatest(avg(y), 1e-6)')} AS pos_weight FROM groups GROUP BY grp"))
def a6_positive_rate(spark, d):
    r = EV.positive_rate(V.groups(spark, d), ["grp"])
    return r.select("grp", round4("pos_rate").alias("pos_rate"), "n_pos", "n", round4("pos_weight").alias("pos_weight"))


@register("a20_log_loss", q(
    f"SELECT grp, {r4('avg(-(w * y * ln(least(greatest(prob, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(prob, 1e-7), 1 - 1e-7))))')} AS log_loss "
    "FROM preds, (SELECT (1 - avg(y)) / greatest(avg(y), 1e-6) AS w FROM groups WHERE grp IN ('fr_train', 'en_train')) GROUP BY grp"))
def a20_log_loss(spark, d):
    g = V.groups(spark, d)
    tr = g.filter(F.col("grp").isin("fr_train", "en_train"))
    w = tr.agg(((1 - F.avg("y")) / F.greatest(F.avg("y"), F.lit(1e-6)))).scalar()
    ll = EV.log_loss(V.preds(spark, d), ["grp"], pos_weight=w)
    return ll.select("grp", round4("log_loss").alias("log_loss"))


@register("u4_replicate_group", q(f"SELECT doc_id, grp, c.copy FROM groups, "
                                  f"LATERAL (SELECT unnest(range(1, CASE WHEN grp = 'fr_train' THEN {FR_OVERSAMPLE} ELSE 1 END + 1)) AS copy) c "
                                  "WHERE grp IN ('fr_train', 'en_train')"))
def u4_replicate_group(spark, d):
    g = V.groups(spark, d).filter(F.col("grp").isin("fr_train", "en_train"))
    times = F.when(F.col("grp") == "fr_train", F.lit(FR_OVERSAMPLE)).otherwise(F.lit(1))
    return S.replicate(g.select("doc_id", "grp"), times).select("doc_id", "grp", "copy")


_OVER_SQL = f"""
ov AS (SELECT doc_id, grp, c.copy, doc_id || ':' || c.copy AS k FROM groups,
       LATERAL (SELECT unnest(range(1, CASE WHEN grp = 'fr_train' THEN {FR_OVERSAMPLE} ELSE 1 END + 1)) AS copy) c
       WHERE grp IN ('fr_train', 'en_train')),
ovp AS (SELECT *, row_number() OVER (ORDER BY md5('0:' || k), k) - 1 AS pos, count(*) OVER () AS n FROM ov)
"""


def _oversampled(spark, d):
    g = V.groups(spark, d).filter(F.col("grp").isin("fr_train", "en_train"))
    times = F.when(F.col("grp") == "fr_train", F.lit(FR_OVERSAMPLE)).otherwise(F.lit(1))
    r = S.replicate(g.select("doc_id", "grp", "y"), times)
    return r.withColumn("k", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("copy").cast("string")))


@register("d5_lang_oversample", q("SELECT doc_id, grp, copy, pos FROM ovp", _OVER_SQL))
def d5_lang_oversample(spark, d):
    return shuffle_position(_oversampled(spark, d), "k", 0).select("doc_id", "grp", "copy", "pos")


@register("d3_carve_validation", q("SELECT doc_id, copy, CASE WHEN pos < greatest(1, floor(0.05::DOUBLE * n)::BIGINT) "
                                   "THEN 'val' ELSE 'train' END AS part FROM ovp", _OVER_SQL))
def d3_carve_validation(spark, d):
    return S.carve_validation(_oversampled(spark, d), "k", 0).select("doc_id", "copy", "part")


def all_queries() -> dict[str, tuple[QueryFn, str | None]]:
    """Every registered query (importing the other catalog parts registers theirs)."""
    from labelforge.plans import catalog_jobs, catalog_vectors  # noqa: F401
    return dict(REGISTRY)
