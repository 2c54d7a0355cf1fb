"""Registered queries of the row-wise job side (lifecycle B), the file sources and sinks, the
streaming jobs, label maps and checks, user functions and model fitting.

The registered translation job uses a deterministic stand-in for the external translator,
expressible in SQL so the oracle can check it: toxic texts fail, those labelled Search with
'declined' and the others without an error text (→ 'unknown error'); the last batch has not run
yet, so its rows are missing; all others translate to their F2-cleaned text.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from labelforge.functions import labels as LB
from labelforge.functions import text as T
from labelforge.functions.vectors import round4
from labelforge.operators import checks as CK
from labelforge.operators import embed as E
from labelforge.operators import evaluate as EV
from labelforge.operators import groups as G
from labelforge.operators import model as M
from labelforge.operators import rules as R
from labelforge.operators import translation as TR
from labelforge.operators import user_fn as U
from labelforge.operators.position import batch_id, key_position
from labelforge.plans import views as V
from labelforge.plans.catalog import BATCH_SIZE, REQUEST_BATCH, REGISTRY, register
from labelforge.plans.oracle_sql import f2 as f2_sql
from labelforge.plans.oracle_sql import py_strip as strip_sql
from labelforge.plans.oracle_sql import q, r4, weak_label_sql, word_count
from labelforge.session import scratch_path
from labelforge.sources import files as IO
from labelforge.sources import records as RD
from labelforge.sources.tables import table
from labelforge.streaming import jobs as J

# Request text of the translation job ('{}' = target language).
TRANSLATE_TEMPLATE = "Give the {} wording of each search query below."


def _rowids(spark, d):
    return TR.with_row_ids(V.labeled(spark, d), "doc_id")


def _stub_results(spark, d, rows=None):
    """Results of a stand-in translator for the numbered rows (``rows``, else they are numbered here)."""
    r = (_rowids(spark, d) if rows is None else rows).withColumn("batch_id", batch_id("row_id", BATCH_SIZE))
    r = r.filter(F.col("batch_id") < r.agg(F.max("batch_id")).scalar())
    r = r.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    fail = F.col("toxic") == 1
    return r.select("row_id", "batch_id",
                    F.when(fail, F.lit(None).cast("string")).otherwise(T.strip_trailing_qmark("query")).alias("translation"),
                    F.when(fail & (F.col("label") == "Search"), F.lit("declined")).alias("error"))


# ---------------------------------------------------------------- lifecycle B
@register("w1_row_ids", q("SELECT doc_id, row_id FROM rowids"))
def w1_row_ids(spark, d):
    return _rowids(spark, d).select("doc_id", "row_id")


@register("w2_batch_ids", q(f"SELECT row_id, row_id // {BATCH_SIZE} AS batch_id, "
                            f"'batch-' || lpad((row_id // {BATCH_SIZE})::VARCHAR, 6, '0') AS batch_name FROM rowids"))
def w2_batch_ids(spark, d):
    return TR.with_batches(_rowids(spark, d), BATCH_SIZE).select("row_id", "batch_id", "batch_name")


@register("p1_select_rename", q('SELECT query AS "Query", label AS "Label", source FROM labeled'))
def p1_select_rename(spark, d):
    return V.labeled(spark, d).select(F.col("query").alias("Query"), F.col("label").alias("Label"), "source")


@register("s7_results_roundtrip", q("SELECT row_id, translation, error, batch_id FROM tr_results"))
def s7_results_roundtrip(spark, d):
    """Batch results written as JSON lines partitioned by batch, read back, one row per id."""
    out = scratch_path(spark, "s7-results")
    IO.write_jsonl(_stub_results(spark, d), out, partition_by=["batch_id"])
    res = IO.read_jsonl(spark, out, f"{TR.RESULT_SCHEMA}, batch_id long")
    return TR.consolidate(res).select("row_id", "translation", "error", "batch_id")


@register("p8_failed_per_batch", q("SELECT batch_id, count(*) AS n_rows, count(*) FILTER (WHERE translation IS NULL) AS n_failed "
                                   "FROM tr_results GROUP BY batch_id"))
def p8_failed_per_batch(spark, d):
    return CK.failed_per_batch(_stub_results(spark, d))


@register("a21_failed_total", q("SELECT count(*) AS n_rows, count(*) FILTER (WHERE translation IS NULL) AS n_failed FROM tr_results"))
def a21_failed_total(spark, d):
    return _stub_results(spark, d).agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.count_if(F.col("translation").isNull()).alias("n_failed"))


@register("j3_attach_translations", q('SELECT r.row_id, t.translation AS "Query", r.label AS "Label", r.source '
                                      "FROM rowids r LEFT JOIN tr_results t USING (row_id)"))
def j3_attach_translations(spark, d):
    rows = _rowids(spark, d)
    j = TR.attach_results(rows, _stub_results(spark, d, rows))
    return j.select("row_id", F.col("translation").alias("Query"), F.col("label").alias("Label"), "source")


@register("j4_missing_rows", q("SELECT count(*) AS n_missing, min(row_id) AS first_missing FROM rowids r "
                               "WHERE NOT EXISTS (SELECT 1 FROM tr_results t WHERE t.row_id = r.row_id)"))
def j4_missing_rows(spark, d):
    rows = _rowids(spark, d)
    return CK.missing_rows(rows, _stub_results(spark, d, rows))


@register("j5_error_table", q("SELECT t.row_id, coalesce(t.error, 'unknown error') AS error, r.query "
                              "FROM tr_results t JOIN rowids r USING (row_id) WHERE t.translation IS NULL ORDER BY t.row_id"))
def j5_error_table(spark, d):
    rows = _rowids(spark, d)
    return CK.error_table(rows, _stub_results(spark, d, rows))


@register("l1_sort_by_row_id", q("SELECT row_id, batch_id FROM tr_results ORDER BY row_id"))
def l1_sort_by_row_id(spark, d):
    return _stub_results(spark, d).select("row_id", "batch_id").orderBy("row_id")


def _esc_sql(x: str) -> str:
    v = f"coalesce(({x})::VARCHAR, '')"
    v = f"replace({v}, '\\', '\\\\')"
    for ch in (",", '"'):
        v = f"replace({v}, '{ch}', '\\{ch}')"
    for code in (10, 13):
        v = f"replace({v}, chr({code}), '\\' || chr({code}))"
    return v


@register("s6_unquoted_lines", q("SELECT r.row_id, " + _esc_sql("t.translation") + " || ',' || " + _esc_sql("r.label")
                                 + " || ',' || " + _esc_sql("r.source") + " AS line FROM rowids r LEFT JOIN tr_results t USING (row_id)"))
def s6_unquoted_lines(spark, d):
    """The final translated table as unquoted CSV lines with backslash escapes (and written)."""
    rows = _rowids(spark, d)
    j = TR.attach_results(rows, _stub_results(spark, d, rows))
    lines = j.select("row_id", TR.unquoted_csv_line(["translation", "label", "source"]).alias("line"))
    IO.write_unquoted_lines(lines, "line", scratch_path(spark, "s6-lines"), header="Query,Label,source")
    return lines


@register("s6_unquoted_roundtrip", q("""SELECT nullif(t.translation, '') AS "Query", r.label AS "Label", r.source FROM rowids r LEFT JOIN tr_results t USING (row_id)"""))
def s6_unquoted_roundtrip(spark, d):
    """The unquoted file written and read back, fields with line breaks, separators and escapes whole."""
    rows, out = _rowids(spark, d), scratch_path(spark, "s6-table")
    j = TR.attach_results(rows, _stub_results(spark, d, rows))
    lines = j.select(TR.unquoted_csv_line(["translation", "label", "source"]).alias("line"))
    IO.write_unquoted_lines(lines, "line", out, header="Query,Label,source")
    return RD.read_unquoted(spark, out, "Query string, Label string, source string")


# ---------------------------------------------------------------- request batches and replies
_UB_SQL = f"""
ub AS (SELECT conv_id * 1000 + turn AS rid, text, row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS pos
       FROM conversations WHERE role = 'user'),
bb AS (SELECT pos // {REQUEST_BATCH} AS batch_id, NOT contains(arg_min(text, pos), '?') AS ok FROM ub GROUP BY 1)
"""


def _user_turns(spark, d):
    qv = V.queries(spark, d).filter(F.col("subset") == "chat")
    return key_position(qv, "rid").withColumn("batch_id", batch_id("pos", REQUEST_BATCH))


def _request_batches(spark, d):
    b = (_user_turns(spark, d).groupBy("batch_id")
         .agg(F.array_sort(F.collect_list(F.struct("pos", "query"))).alias("_l")))
    return b.select("batch_id", F.transform("_l", lambda x: x["query"]).alias("items"))


@register("w3_request_batches", q(f"SELECT pos // {REQUEST_BATCH} AS batch_id, count(*) AS n, "
                                  "string_agg(text, chr(10) ORDER BY pos) AS request FROM ub GROUP BY 1", _UB_SQL))
def w3_request_batches(spark, d):
    b = _request_batches(spark, d)
    return b.select("batch_id", F.size("items").cast("long").alias("n"), F.concat_ws("\n", "items").alias("request"))


@register("f14_zip_replies", q(f"SELECT ub.pos // {REQUEST_BATCH} AS batch_id, (ub.pos % {REQUEST_BATCH})::INTEGER AS pos, "
                               f"ub.text AS item, CASE WHEN bb.ok THEN {weak_label_sql('ub.text')} END AS reply, "
                               "bb.ok FROM ub JOIN bb ON bb.batch_id = ub.pos // " + str(REQUEST_BATCH), _UB_SQL))
def f14_zip_replies(spark, d):
    """Replies of a stand-in labeler per request batch; batches whose first item
    holds a '?' get one label short, so the length check sends them to the error rows."""
    b = _request_batches(spark, d)
    labels = F.transform("items", lambda x: R.weak_label(x))
    replies = F.when(F.get("items", F.lit(0)).contains("?"), F.slice(labels, 1, F.size("items") - 1)).otherwise(labels)
    z = CK.zip_replies(b.withColumn("replies", replies), "items", "replies")
    return z.select("batch_id", "pos", "item", "reply", "ok")


@register("f15_parse_replies", q(f"SELECT rid, CASE WHEN contains(text, '?') THEN NULL ELSE {weak_label_sql('text')} END AS label, "
                                 "CASE WHEN contains(text, '?') THEN 'unparsable reply' END AS parse_error FROM ub", _UB_SQL))
def f15_parse_replies(spark, d):
    """Structured replies {intent_category: ...}; replies to texts holding a '?' come back cut
    short (invalid JSON) and are reported, not raised."""
    u = _user_turns(spark, d)
    good = F.to_json(F.struct(R.weak_label("query").alias("intent_category")))
    reply = F.when(F.col("query").contains("?"), F.lit('{"intent_category": ')).otherwise(good)
    p = CK.parse_replies(u.withColumn("reply", reply), "reply", "intent_category string", "intent_category", "label")
    return p.select("rid", "label", "parse_error")


# ---------------------------------------------------------------- labels and checks
@register("f4_label_maps", q("SELECT doc_id, CASE label WHEN 'Chat' THEN 0 WHEN 'Search' THEN 1 END AS label_id, "
                             "label AS label_back FROM labeled"))
def f4_label_maps(spark, d):
    m = V.labeled(spark, d).withColumn("label_id", LB.label_to_id("label"))
    return m.select("doc_id", "label_id", LB.id_to_label("label_id").alias("label_back"))


_RAW_SQL = ("raw AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsure' WHEN quality = 1 THEN ' SEARCH' ELSE 'Chat ' END AS raw FROM labels),\n"
            f"rawn AS (SELECT doc_id, raw, CASE lower({strip_sql('raw')}) WHEN 'chat' THEN 0 WHEN 'search' THEN 1 END AS label_id FROM raw)")


def _raw_labels(spark, d):
    lab = table(spark, d, "labels")
    raw = (F.when(F.col("toxic") == 1, F.lit("unsure")).when(F.col("quality") == 1, F.lit(" SEARCH"))
           .otherwise(F.lit("Chat ")))
    return lab.select("doc_id", raw.alias("raw"))


@register("p5_label_domain", q("SELECT doc_id, raw, label_id, label_id IS NULL AS bad_label FROM rawn", _RAW_SQL))
def p5_label_domain(spark, d):
    """Hand-typed label texts (case and spaces vary; toxic rows carry an invalid label)."""
    return CK.label_domain(_raw_labels(spark, d), "raw").select("doc_id", "raw", "label_id", "bad_label")


@register("p5_bad_label_counts", q("SELECT raw, count(*) AS n, count(*) FILTER (WHERE label_id IS NULL) AS n_bad FROM rawn GROUP BY raw", _RAW_SQL))
def p5_bad_label_counts(spark, d):
    c = CK.label_domain(_raw_labels(spark, d), "raw")
    return c.groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad_label").alias("n_bad"))


@register("f5_template_fill", q("SELECT doc_id, replace('" + TRANSLATE_TEMPLATE + "', '{}', lang) AS prompt FROM documents"))
def f5_template_fill(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fill_template(TRANSLATE_TEMPLATE, "lang").alias("prompt"))


@register("f6_normalize_text", None)
def f6_normalize_text(spark, d):
    """NFKC + space collapsing + word-start marks (no SQL form: NFKC)."""
    return V.queries(spark, d).select("subset", "rid", T.normalize_for_pieces("query").alias("normalized"))


# ---------------------------------------------------------------- file round trips
@register("s1_csv_roundtrip", q("SELECT subset, rid, query FROM queries"))
def s1_csv_roundtrip(spark, d):
    out = scratch_path(spark, "s1-csv")
    IO.write_csv(V.queries(spark, d), out)
    return IO.read_csv(spark, out, "subset string, rid long, query string")


@register("s2_labeled_dir", q('SELECT query AS "Query", label AS "Label", source FROM labeled'))
def s2_labeled_dir(spark, d):
    out = scratch_path(spark, "s2-labeled")
    lab = V.labeled(spark, d).select(F.col("query").alias("Query"), F.col("label").alias("Label"), "source")
    IO.write_csv(lab, out, partition_by=["source"])
    return IO.read_labeled_dir(spark, out)


@register("s3_avoid_json", q("SELECT text AS query FROM benchmark"))
def s3_avoid_json(spark, d):
    out = scratch_path(spark, "s3-avoid")
    b = key_position(table(spark, d, "benchmark"), "item_id")
    RD.write_json_arrays(b, "text", "pos", out)
    return RD.read_json_arrays(spark, out)


@register("s9_group_meta", q("SELECT grp, min(ord) AS ord, count(*) AS n, "
                             "(sum(count(*)) OVER (ORDER BY min(ord)))::BIGINT - count(*) AS off FROM groups_o GROUP BY grp"))
def s9_group_meta(spark, d):
    out = scratch_path(spark, "s9-meta")
    IO.write_jsonl(G.group_offsets(V.groups(spark, d), V.GROUP_ORDER).select("grp", "ord", "n", "off"), out)
    return IO.read_jsonl(spark, out, "grp string, ord int, n long, off long")


@register("s9_group_labels", q("SELECT grp, gpos AS pos, y FROM corpus"))
def s9_group_labels(spark, d):
    """The groups' metadata documents with their whole label lists, written and read back."""
    out = scratch_path(spark, "s9-labels")
    c = G.corpus_ids(V.groups(spark, d).select("doc_id", "grp", "y"), V.GROUP_ORDER, key="doc_id")
    RD.write_group_documents(G.group_offsets(c, V.GROUP_ORDER), G.label_chunks(c, "grp", "gpos", "y"), out)
    return RD.read_group_labels(spark, out)


@register("s11_report_json", REGISTRY["a13_overlapping_report"][1])
def s11_report_json(spark, d):
    out = scratch_path(spark, "s11-report")
    IO.write_jsonl(REGISTRY["a13_overlapping_report"][0](spark, d), out)
    return IO.read_jsonl(spark, out, "grp string, n long, accuracy double, auc double, tn long, fp long, fn long, tp long")


# ---------------------------------------------------------------- restartable job and stream
def _identity_translator(q: str, lang: str) -> str:
    return q


def _translate_batch(todo):
    res = U.translate_with(todo, _identity_translator, "fr", sleep=0.0, carry=["batch_id"])
    return res.select("row_id", "translation", "error", "batch_id")


@register("t1_restartable_translation", q(f"SELECT row_id, {f2_sql('query')} AS translation, row_id // {BATCH_SIZE} AS batch_id FROM rowids"))
def t1_restartable_translation(spark, d):
    """T1 + M2: the translation job run twice over the same folder; the second run finds every
    batch done and sends no row to the translator. The stand-in translator returns its input."""
    out = scratch_path(spark, "t1-job")
    work = TR.with_batches(_rowids(spark, d), BATCH_SIZE).select("row_id", "query", "batch_id")
    J.run_batches(work, _translate_batch, out, TR.RESULT_SCHEMA)
    again = J.run_batches(work, _translate_batch, out, TR.RESULT_SCHEMA)
    if again:
        raise RuntimeError(f"restart redid {again} rows")
    return J.read_results(spark, out, TR.RESULT_SCHEMA).select("row_id", "translation", "batch_id")


@register("t1_stream_translation", REGISTRY["t1_restartable_translation"][1])
def t1_stream_translation(spark, d):
    """T1, streaming form: the work rows arrive as files; a file-source stream with an
    availableNow trigger translates them batch by batch from foreachBatch; a second run finds
    every file recorded in the checkpoint and does nothing."""
    base = scratch_path(spark, "t1-stream")
    work = TR.with_batches(_rowids(spark, d), BATCH_SIZE).select("row_id", "query", "batch_id")
    work.write.parquet(f"{base}/inbox/arrival-0")
    args = (f"{base}/inbox/*", "row_id long, query string, batch_id long", _translate_batch,
            f"{base}/out", f"{base}/ckpt")
    J.stream_batches(spark, *args)
    again = J.stream_batches(spark, *args)
    if again:
        raise RuntimeError(f"restart redid {again} rows")
    return J.read_results(spark, f"{base}/out", TR.RESULT_SCHEMA).select("row_id", "translation", "batch_id")


@register("t2_stream_distinct", q("SELECT DISTINCT text AS query FROM documents d "
                                  "WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)"))
def t2_stream_distinct(spark, d):
    """Documents arriving as a file stream, minus the avoid list, deduplicated on text."""
    sink = scratch_path(spark, "t2-sink")
    ck = scratch_path(spark, "t2-ckpt")
    avoid = table(spark, d, "benchmark").select(F.col("text").alias("query"))
    schema = table(spark, d, "documents").schema
    return J.stream_distinct(spark, d, schema, "text", avoid, sink, ck, glob="documents.parquet")


# ---------------------------------------------------------------- user functions (rows only)
def _stub_labeler(q: str) -> str:
    return "Search" if len((q or "").split()) < 4 else "Chat"


@register("m1_label_with", q(f"""SELECT row_number() OVER (ORDER BY CASE subset WHEN 'url' THEN 0 WHEN 'chat' THEN 1 WHEN 'short' THEN 2 ELSE 3 END, rid) - 1 AS id,
  CASE WHEN {word_count("coalesce(query, '')")} < 4 THEN 'Search' ELSE 'Chat' END AS label, NULL::VARCHAR AS error, 1 AS attempts FROM queries"""))
def m1_label_with(spark, d):
    """M1 with a stand-in labeler (fewer than 4 words → Search) over every query row."""
    qv = G.corpus_ids(V.queries(spark, d), ["url", "chat", "short", "general"], key="rid", grp="subset", name="id")
    return U.label_with(qv, _stub_labeler, id_col="id", text="query")


def _sentences(prompt: str, n: int) -> list[str]:
    parts = [s.strip() for s in prompt.replace("\n", ". ").split(". ")]
    return [p for p in parts if p][: max(n, 0) or None]


_SENTENCES = strip_sql("x")


@register("m3_generate_with", q(f"""SELECT doc_id AS request_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS query, NULL::VARCHAR AS error, 1 AS attempts
FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), '. '), '. '), lambda x: {_SENTENCES}), lambda x: x <> '') AS s FROM documents) WHERE len(s) > 0"""))
def m3_generate_with(spark, d):
    """M3 with a stand-in generator: each document is a request; its sentences are the
    generated queries (every sentence: n = the sentence count)."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("prompt"),
                                               F.lit(0).alias("n"))
    return U.generate_with(docs, _sentences)


# ---------------------------------------------------------------- models (rows only)
def _pooled_groups(spark, d):
    from labelforge.plans.catalog_vectors import _pooled_ids
    emb = table(spark, d, "embeddings")
    blocks, ids = _pooled_ids(spark, d)
    pooled = E.pool(ids, emb, "doc_id", E.vector_dim(emb), weight=E.sif_weight("logp"), blocks=blocks)
    # Model fitting passes over its input many times: cut the lineage once with a reliable
    # checkpoint in the shared checkpoint folder (survives executor loss, unlike a local one).
    return V.groups(spark, d).select("doc_id", "grp", "y").join(pooled, "doc_id").checkpoint(eager=True)


@register("m4_logreg_eval", None)
def m4_logreg_eval(spark, d):
    """M4 + M5: weighted logistic regression on SIF vectors of the training groups, exact AUC
    and metrics on every group."""
    data = _pooled_groups(spark, d)
    train = M.with_class_weight(data.filter(F.col("grp").isin("fr_train", "en_train")))
    model = M.fit_logistic(train, reg=0.01)
    scored = M.score(model, data)
    r = EV.group_report(scored, ["grp"])
    return r.select("grp", "n", round4("auc").alias("auc"), round4("accuracy").alias("accuracy"))


@register("m6_pca_variance", None)
def m6_pca_variance(spark, d):
    return M.pca_variance(table(spark, d, "embeddings"), k=8)


@register("m7_grid_select", None)
def m7_grid_select(spark, d):
    data = _pooled_groups(spark, d)
    train = data.filter(F.col("grp").isin("fr_train", "en_train"))
    valid = data.filter(F.col("grp").isin("fr_val", "en_eval"))
    fits, best = M.grid_search(train, valid, [0.0, 0.01, 0.1])
    return best


# ---------------------------------------------------------------- remaining inventory items
@register("p2_constant_label", q("SELECT subset, rid, 'Search' AS label FROM queries WHERE subset IN ('url', 'short')"))
def p2_constant_label(spark, d):
    """The subsets whose policy is the constant label get 'Search' without any labeller."""
    qv = V.queries(spark, d).filter(F.col("subset").isin(*R.constant_label_subsets()))
    return qv.select("subset", "rid", F.lit("Search").alias("label"))


@register("j7_token_vectors", q(f"""
SELECT g.doc_id, n.n_gathered, g.dim, {r4('sum(g.cnt * g.x)')} AS value
FROM (SELECT dv.doc_id, dv.cnt, unnest(e.embedding::DOUBLE[]) AS x, generate_subscripts(e.embedding, 1) - 1 AS dim FROM dv JOIN embeddings e ON e.vec_id = dv.vid) g
JOIN (SELECT dv.doc_id, sum(dv.cnt)::BIGINT AS n_gathered FROM dv JOIN embeddings e ON e.vec_id = dv.vid GROUP BY dv.doc_id) n USING (doc_id) GROUP BY g.doc_id, n.n_gathered, g.dim""", """
dt AS (SELECT doc_id, token, count(*) AS cnt FROM tokens GROUP BY doc_id, token),
dv AS (SELECT dt.doc_id, dt.cnt, CASE WHEN v.token_id < (SELECT count(*) FROM embeddings) THEN v.token_id ELSE 0 END AS vid
       FROM dt JOIN vocab v USING (token))"""))
def j7_token_vectors(spark, d):
    """Every token occurrence gathers its vector (by token id; ids past the table → 0); the sum of
    the gathered vectors per document, all dimensions."""
    from labelforge.plans.catalog_vectors import _pooled_ids
    emb = table(spark, d, "embeddings")
    blocks, ids = _pooled_ids(spark, d)
    dims = range(E.vector_dim(emb))
    s = E.gather(blocks, ids, emb, "doc_id", len(dims)).withColumnRenamed("n", "n_gathered")
    s = s.select("doc_id", "n_gathered", F.posexplode(F.array(*[F.col(f"_s{i}") for i in dims])).alias("dim", "value"))
    return s.select("doc_id", "n_gathered", F.col("dim").cast("long").alias("dim"), round4("value").alias("value"))


GEN_BATCH = 16
GEN_TEMPLATE = "Generate distinct queries for the {} subset."


@register("j10_generation_requests", q(
    f"SELECT source AS subset, r.round, replace('{GEN_TEMPLATE}', '{{}}', source) AS prompt FROM "
    "(SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source) s, "
    f"LATERAL (SELECT unnest(range(1, (n + {GEN_BATCH - 1}) // {GEN_BATCH} + 1)) AS round) r"))
def j10_generation_requests(spark, d):
    """One generation request per subset × round, as many rounds as the subset needs
    batches of GEN_BATCH (expanded with the two-level replicate, not a cartesian product)."""
    from labelforge.operators.split import replicate
    per = table(spark, d, "documents").groupBy("source").agg(F.countDistinct("text").alias("n"))
    rounds = F.floor((F.col("n") + GEN_BATCH - 1) / GEN_BATCH)
    r = replicate(per, rounds, name="round")
    return r.select(F.col("source").alias("subset"), "round", T.fill_template(GEN_TEMPLATE, "source").alias("prompt"))


@register("s8_corpus_jsonl", q("SELECT id, query AS text, grp FROM corpus"))
def s8_corpus_jsonl(spark, d):
    """The ordered corpus written as JSON lines {id, text} (with its group) and read back;
    the order is the ``id`` column, not the file."""
    out = scratch_path(spark, "s8-corpus")
    c = G.corpus_ids(V.groups(spark, d), V.GROUP_ORDER, key="doc_id").select("id", F.col("query").alias("text"), "grp")
    IO.write_jsonl(c, out)
    return IO.read_jsonl(spark, out, "id long, text string, grp string")


@register("s10_vector_table", q(f"SELECT vec_id, x.dim, {r4('x.v')} AS value FROM embeddings, "
                                "LATERAL (SELECT unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS dim) x"))
def s10_vector_table(spark, d):
    """The vector table read with its vectors cast to double, one row per (id, dim)."""
    from labelforge.functions.vectors import as_double
    e = table(spark, d, "embeddings").select("vec_id", as_double("embedding").alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), round4("value").alias("value"))


@register("a22_progress_counts", q("""
SELECT round, rows, new, (sum(new) OVER (ORDER BY round))::BIGINT AS collected FROM
(SELECT r.round, r.rows, coalesce(f.new, 0) AS new FROM
  (SELECT CAST(substr(source, 4) AS BIGINT) AS round, count(*) AS rows FROM documents GROUP BY 1) r
  LEFT JOIN (SELECT round, count(*) AS new FROM (SELECT text, min(CAST(substr(source, 4) AS BIGINT)) AS round
             FROM documents GROUP BY text) GROUP BY round) f USING (round))"""))
def a22_progress_counts(spark, d):
    """Per collection round, rows gathered, texts seen for the first time, and the running
    number of distinct texts collected."""
    from pyspark.sql import Window
    docs = table(spark, d, "documents").withColumn("round", F.substring("source", 4, 10).cast("long"))
    rows = docs.groupBy("round").agg(F.count(F.lit(1)).alias("rows"))
    new = (docs.groupBy("text").agg(F.min("round").alias("round"))
           .groupBy("round").agg(F.count(F.lit(1)).alias("new")))
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.join(new, "round", "left").fillna(0, ["new"])
            .withColumn("collected", F.sum("new").over(w)).select("round", "rows", "new", "collected"))


@register("a22_streamed_progress", REGISTRY["a22_progress_counts"][1])
def a22_streamed_progress(spark, d):
    """A22 as a stream: the rounds arrive in three lots, each taken in by a run of its own on the same state."""
    inbox, out, ck = (scratch_path(spark, f"a22-{x}") for x in ("inbox", "state", "ckpt"))
    docs = table(spark, d, "documents").select("text", F.substring("source", 4, 10).cast("long").alias("round"))
    for lo, hi in ((0, 7), (7, 14), (14, None)):
        lot = docs.where((F.col("round") >= lo) & (F.col("round") < hi if hi else F.lit(True)))
        lot.write.mode("append").parquet(inbox)
        progress = J.stream_rounds(spark, inbox, docs.schema, "text", "round", out, ck)
    return progress
