"""Registered queries of the vector side: vocabulary, token ids, pooling, IDF weights, cosine,
class shaping of the vector table and fixed-weight scoring (lifecycle D, A3, D4, W5, P7, F13,
J11, A19)."""
from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from labelforge.functions.vectors import (argmax, argmax2, as_double, dot, l2_norm, round4, sigmoid,
                                          sigmoid_two_logits)
from labelforge.operators import embed as E
from labelforge.operators import evaluate as EV
from labelforge.operators import split as S
from labelforge.operators.hot_join import hot_keys
from labelforge.operators.position import key_position
from labelforge.plans import views as V
from labelforge.plans.catalog import MAX_LEN, register
from labelforge.plans.oracle_sql import q, r4
from labelforge.session import written
from labelforge.sources.tables import table

# Fixed-weight scorer of the registered scoring queries: w_i = ((i mod 3) - 1) / 2, b = 0.1.
SCORE_BIAS = 0.1
QUANT_LEVELS = 127  # int8-style quantisation of the second scoring variant


def _score_weights(dim: int):
    return [((i % 3) - 1) * 0.5 for i in range(dim)]


def _dim(spark, d) -> int:
    return E.vector_dim(table(spark, d, "embeddings"))


# ---------------------------------------------------------------- vocabulary and weights
@register("a16_vocab", q(f"SELECT token, n, token_id, {r4('logp')} AS logp FROM vocab"))
def a16_vocab(spark, d):
    v = V.vocab(spark, d)
    return v.select("token", "n", "token_id", round4("logp").alias("logp"))


_IDF_SQL = """
idf0 AS (SELECT token, token_id, least(greatest(-ln(greatest(p, 1e-12)), 1.0), 15.0) AS raw FROM vocab),
idf AS (SELECT token, token_id, raw / (SELECT avg(raw) FROM idf0) AS idf FROM idf0)
"""


@register("a17_idf_weights", q(f"SELECT token, {r4('idf')} AS idf FROM idf", _IDF_SQL))
def a17_idf_weights(spark, d):
    w = E.idf_weights(V.vocab(spark, d))
    return w.select("token", round4("idf").alias("idf"))


@register("a18_weight_summary", q(f"SELECT {r4('min(idf)')} AS weight_min, {r4('max(idf)')} AS weight_max, "
                                  f"{r4('avg(idf)')} AS weight_mean FROM idf", _IDF_SQL))
def a18_weight_summary(spark, d):
    s = E.weight_summary(E.idf_weights(V.vocab(spark, d)))
    return s.select(*[round4(c).alias(c) for c in ("weight_min", "weight_max", "weight_mean")])


@register("f12_idf_scaled_vectors", q(
    f"SELECT e.vec_id, x.dim, {r4('x.v * i.idf')} AS value FROM embeddings e JOIN idf i ON i.token_id = e.vec_id, "
    "LATERAL (SELECT unnest(e.embedding::DOUBLE[]) AS v, generate_subscripts(e.embedding, 1) - 1 AS dim) x", _IDF_SQL))
def f12_idf_scaled_vectors(spark, d):
    from labelforge.functions.vectors import scale
    w = E.idf_weights(V.vocab(spark, d)).select(F.col("token_id").alias("vec_id"), "idf")
    v = table(spark, d, "embeddings").join(w, "vec_id")
    s = v.select("vec_id", scale(as_double("embedding"), F.col("idf")).alias("v"))
    return s.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("long").alias("dim"), round4("value").alias("value"))


# ---------------------------------------------------------------- token ids
_IDS_SQL = """
ti AS (SELECT t.doc_id, list(v.token_id ORDER BY t.pos) AS ids FROM tokens t JOIN vocab v USING (token) GROUP BY t.doc_id),
dids AS (SELECT d.doc_id, coalesce(ti.ids, []::BIGINT[]) AS ids FROM documents d LEFT JOIN ti USING (doc_id))
"""


def _doc_ids(spark, d, first: int | None = None):
    """(doc_id, ids in text order), of all tokens or of the ``first`` ones. Only the ends of a split text
    can be blank, so the first n tokens stand at places 0..n."""
    toks = V.doc_tokens(spark, d)
    toks = toks if first is None else toks.where(F.col("pos") <= first)
    j = E.attach_token_ids(toks, V.vocab(spark, d))
    per = j.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("_l"))
    per = per.select("doc_id", F.transform("_l", lambda x: x["token_id"]).alias("ids"))
    docs = table(spark, d, "documents").select("doc_id")
    return docs.join(per, "doc_id", "left").withColumn(
        "ids", F.coalesce(F.col("ids"), F.array().cast("array<bigint>")))


@register("f7_token_ids", q("SELECT doc_id, len(ids)::BIGINT AS n_tokens, array_to_string(ids, ' ') AS ids FROM dids", _IDS_SQL))
def f7_token_ids(spark, d):
    t = _doc_ids(spark, d)
    return t.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.concat_ws(" ", "ids").alias("ids"))


@register("f8_pad_and_mask", q(
    f"SELECT doc_id, array_to_string(list_concat(s, list_transform(range({MAX_LEN} - len(s)), lambda x: 0)), ' ') AS ids, "
    f"array_to_string(list_transform(range(1, {MAX_LEN} + 1), lambda i: CASE WHEN i > len(s) THEN 0 ELSE 1 END), '') AS attention "
    f"FROM (SELECT doc_id, CASE WHEN len(ids) = 0 THEN [0::BIGINT] ELSE ids[1:{MAX_LEN}] END AS s FROM dids)", _IDS_SQL))
def f8_pad_and_mask(spark, d):
    """F8 + F9: model input of ``MAX_LEN`` ids (the model's fixed input size), and its mask."""
    ids, mask = E.pad_ids("ids", MAX_LEN)
    t = _doc_ids(spark, d, MAX_LEN).select("doc_id", ids.alias("p"), mask.alias("m"))
    return t.select("doc_id", F.concat_ws(" ", "p").alias("ids"),
                    F.concat_ws("", E.attention_mask("m")).alias("attention"))


@register("j8_token_logprob", q("""
SELECT subset, rid, count(*) AS n_tokens, count(*) FILTER (WHERE v.token IS NULL) AS n_unknown,
       """ + r4("sum(coalesce(v.logp, 0.0))") + """ AS logp_sum, sum(coalesce(v.token_id, 0))::BIGINT AS id_sum
FROM qt LEFT JOIN vocab v USING (token) GROUP BY subset, rid""",
    """qt0 AS (SELECT subset, rid, unnest(string_split_regex(lower(query), '[\\t\\n\\x0B\\f\\r ]+')) AS token FROM queries),
qt AS (SELECT * FROM qt0 WHERE token <> '')"""))
def j8_token_logprob(spark, d):
    toks = E.tokenize(V.queries(spark, d), ["subset", "rid"], "query")
    j = E.attach_token_ids(toks, V.vocab(spark, d), hot=hot_keys(toks, "token"))
    return j.groupBy("subset", "rid").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count_if(F.col("token_id").isNull()).alias("n_unknown"),
        round4(F.sum(F.coalesce(F.col("logp"), F.lit(0.0)))).alias("logp_sum"),
        F.sum("vid").alias("id_sum"))


# ---------------------------------------------------------------- pooling
def _pool_sql(weight: str, l2: bool) -> str:
    final = "CASE WHEN nr > 0 THEN m / nr ELSE m END" if l2 else "m"
    return q(f"SELECT doc_id, dim, {r4(final)} AS value FROM s JOIN nrm USING (doc_id)", f"""
dt AS (SELECT doc_id, token, count(*) AS cnt FROM tokens GROUP BY doc_id, token),
dv AS (SELECT dt.doc_id, dt.cnt, v.logp,
              CASE WHEN v.token_id < (SELECT count(*) FROM embeddings) THEN v.token_id ELSE 0 END AS vid
       FROM dt JOIN vocab v USING (token)),
j AS (SELECT dv.doc_id, dv.cnt * {weight} AS w, e.embedding::DOUBLE[] AS v FROM dv JOIN embeddings e ON e.vec_id = dv.vid),
ex AS (SELECT doc_id, w, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM j),
s AS (SELECT doc_id, dim, CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE sum(w * x) END AS m FROM ex GROUP BY doc_id, dim),
nrm AS (SELECT doc_id, sqrt(sum(m * m)) AS nr FROM s GROUP BY doc_id)""")


def _pooled_ids(spark, d):
    """The documents as token blocks, and (block, place, token, cnt, logp, vid): the tokens of each block
    with their log-probability and vector id (rank below the vector-table size, else 0)."""
    size = table(spark, d, "embeddings").agg(F.count(F.lit(1))).scalar()
    blocks = V.doc_blocks(spark, d)
    tokens = E.block_tokens(blocks)
    return blocks, E.attach_token_ids(tokens, E.build_vocab(tokens), size, folded=True)


def _pooled(spark, d, sif: bool, l2: bool):
    emb = table(spark, d, "embeddings")
    blocks, ids = _pooled_ids(spark, d)
    w = E.sif_weight("logp") if sif else None
    p = E.pool(ids, emb, "doc_id", _dim(spark, d), weight=w, l2=l2, blocks=blocks)
    return p.select("doc_id", F.posexplode("vector").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), round4("value").alias("value"))


@register("a14_sif_pool", _pool_sql("(0.001 / (0.001 + exp(dv.logp)))", True))
def a14_sif_pool(spark, d):
    """SIF-weighted mean of token vectors per document, L2-normalised (J7 gather inside)."""
    return _pooled(spark, d, sif=True, l2=True)


@register("a15_mean_pool", _pool_sql("1.0", False))
def a15_mean_pool(spark, d):
    return _pooled(spark, d, sif=False, l2=False)


# ---------------------------------------------------------------- vectors
@register("f10_vector_norms", q(f"SELECT vec_id, {r4('sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))')} AS norm FROM embeddings"))
def f10_vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", round4(l2_norm(as_double("embedding"))).alias("norm"))


_EV_SQL = """
ev AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
cen AS (SELECT label, dim, avg(x) AS c FROM ev GROUP BY label, dim),
cs AS (SELECT ev.vec_id, ev.label, sum(x * c) AS dt, sqrt(sum(x * x)) AS na, sqrt(sum(c * c)) AS nb
       FROM ev JOIN cen USING (label, dim) GROUP BY ev.vec_id, ev.label)
"""


@register("j9_centroid_cosine", q(f"SELECT vec_id, label, {r4('CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE dt / (na * nb) END')} AS cosine FROM cs", _EV_SQL))
def j9_centroid_cosine(spark, d):
    c = E.centroid_cosine(table(spark, d, "embeddings"), "label")
    return c.select("vec_id", "label", round4("cosine").alias("cosine"))


def _cos_sql(x: str, y: str) -> str:
    norm = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
    return r4(f"CASE WHEN {norm(x)} = 0 OR {norm(y)} = 0 THEN 0.0 ELSE list_sum(list_transform(list_zip({x}, {y}), lambda t: t[1] * t[2])) / ({norm(x)} * {norm(y)}) END")


@register("j9_probe_pairs", q(f"SELECT a.token_id AS id_a, b.token_id AS id_b, {_cos_sql('a.v', 'b.v')} AS cosine FROM pr a JOIN pr b ON a.token_id < b.token_id", """
top AS (SELECT DISTINCT arg_min(token, {'n': -cnt, 't': token}) AS token FROM (SELECT doc_id, token, count(*) AS cnt FROM tokens GROUP BY doc_id, token) GROUP BY doc_id),
pr AS (SELECT v.token_id, e.embedding::DOUBLE[] AS v FROM top JOIN vocab v USING (token) JOIN embeddings e ON e.vec_id = v.token_id)"""))
def j9_probe_pairs(spark, d):
    """Cosine of the unique pairs of a probe list: every document's most frequent word (of equally
    frequent ones the first), as far as the word has a vector."""
    blocks = V.doc_blocks(spark, d)
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), "embedding")
    vocab = E.build_vocab(E.block_tokens(blocks)).select("token", "token_id")
    probes = written(vocab.join(E.top_tokens(blocks, "doc_id"), "token", "left_semi").join(vecs, "token_id"), "probes")
    p = E.cosine_matrix(probes, pid="token_id")
    return p.select("id_a", "id_b", round4("cosine").alias("cosine"))


@register("j9_centroid_matrix", q(f"SELECT c.label, e.vec_id, {_cos_sql('c.v', 'e.embedding::DOUBLE[]')} AS cosine FROM cen c, embeddings e", """
dims AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
cen AS (SELECT label, list(x ORDER BY dim) AS v FROM (SELECT label, dim, avg(x) AS x FROM dims GROUP BY label, dim) GROUP BY label)"""))
def j9_centroid_matrix(spark, d):
    """Cosine of every class centroid with every vector."""
    emb = table(spark, d, "embeddings")
    p = E.cosine_matrix(E.class_centroids(emb, "label"), emb, pid="label", vid="vec_id")
    return p.select(F.col("id_a").alias("label"), F.col("id_b").alias("vec_id"), round4("cosine").alias("cosine"))


# ---------------------------------------------------------------- class shaping
@register("a3_class_counts", q("SELECT label, count(*) AS n, max(count(*)) OVER () AS max_n FROM embeddings GROUP BY label"))
def a3_class_counts(spark, d):
    emb = table(spark, d, "embeddings")
    c = emb.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("max_n", c.agg(F.max("n")).scalar())


@register("w5_class_position", q("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings"))
def w5_class_position(spark, d):
    return key_position(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id",
                        partition_by=["label"]).select("vec_id", "label", "pos")


_UP_SQL = """
cp AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cpos,
              count(*) OVER (PARTITION BY label) AS cnt FROM embeddings),
mx AS (SELECT max(cnt) AS m FROM cp),
whole AS (SELECT vec_id, label, c.copy, NULL::BIGINT AS draw FROM cp, mx,
          LATERAL (SELECT unnest(range(1, m // cnt + 1)) AS copy) c),
dr AS (SELECT label, cpos + 1 AS draw, cnt FROM cp, mx WHERE cpos < m % cnt),
drawn AS (SELECT cp.vec_id, cp.label, 0::BIGINT AS copy, dr.draw FROM dr JOIN cp ON cp.label = dr.label
          AND cp.cpos = ((('0x' || substr(md5('42:' || dr.label || ':' || dr.draw), 1, 15))::BIGINT) % dr.cnt))
"""


@register("d4_upsample_classes", q("SELECT * FROM whole UNION ALL SELECT * FROM drawn", _UP_SQL))
def d4_upsample_classes(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", "label")
    return S.upsample_classes(emb, "label", "vec_id", seed=42).select("vec_id", "label", "copy", "draw")


_KEYS = [int(hashlib.md5(f"42:key:{r}".encode()).hexdigest()[:15], 16) for r in range(S.SHUFFLE_ROUNDS)]
_SHUFFLE_SQL = _UP_SQL + f""",
nn AS (SELECT max(cnt) AS m, max(cnt) * count(DISTINCT label) AS n FROM cp),
cr AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS rank FROM (SELECT DISTINCT label FROM cp)),
pl AS (SELECT DISTINCT vec_id, label, cpos, cnt FROM cp),
ix AS (SELECT u.*, cr.rank * nn.m + CASE WHEN u.draw IS NULL THEN (u.copy - 1) * pl.cnt + pl.cpos ELSE (nn.m // pl.cnt) * pl.cnt + u.draw - 1 END AS i, nn.n
       FROM (SELECT * FROM whole UNION ALL SELECT * FROM drawn) u JOIN pl USING (vec_id, label) JOIN cr USING (label), nn),
ks AS (SELECT {_KEYS}::BIGINT[] AS k)
"""


@register("d4_upsample_shuffled", q("""SELECT vec_id, label, copy, draw, list_reduce(list_concat([i], range(0, 48)), lambda a, r:
  CASE WHEN substr(md5('42:' || r || ':' || greatest(a, (((k[r + 1] % n) - a) % n + n) % n)), 1, 1) >= '8' THEN (((k[r + 1] % n) - a) % n + n) % n ELSE a END) AS position
FROM ix, ks""", _SHUFFLE_SQL))
def d4_upsample_shuffled(spark, d):
    """The upsampled set with each row's place in the final seeded shuffle."""
    emb = table(spark, d, "embeddings").select("vec_id", "label")
    return S.upsampled_shuffle(emb, "label", "vec_id", seed=42).select("vec_id", "label", "copy", "draw", "position")


@register("d4_upsampled_counts", q("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS n_distinct FROM "
                                   "(SELECT * FROM whole UNION ALL SELECT * FROM drawn) GROUP BY label", _UP_SQL))
def d4_upsampled_counts(spark, d):
    emb = table(spark, d, "embeddings").select("vec_id", "label")
    u = S.upsample_classes(emb, "label", "vec_id", seed=42)
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_distinct"))


@register("p7_argmax", q("SELECT vec_id, CASE WHEN embedding[2] > embedding[1] THEN 1 ELSE 0 END AS pred2, "
                         "(list_position(embedding, list_max(embedding)) - 1)::BIGINT AS argmax FROM embeddings"))
def p7_argmax(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", argmax2(F.col("embedding")[0], F.col("embedding")[1]).alias("pred2"),
                    argmax("embedding").cast("long").alias("argmax"))


# ---------------------------------------------------------------- fixed-weight scoring
def _scores(spark, d):
    e = table(spark, d, "embeddings")
    dim = _dim(spark, d)
    w = F.array(*[F.lit(x) for x in _score_weights(dim)])
    x = as_double("embedding")
    xq = F.transform(x, lambda t: F.round(t * QUANT_LEVELS) / QUANT_LEVELS)
    return e.select("vec_id", (dot(x, w) + SCORE_BIAS).alias("z"), (dot(xq, w) + SCORE_BIAS).alias("zq"))


_Z_SQL = f"""
zx AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
zs AS (SELECT vec_id, sum(x * (((dim % 3) - 1) * 0.5)) + {SCORE_BIAS} AS z,
              sum(round(x * {QUANT_LEVELS}) / {QUANT_LEVELS} * (((dim % 3) - 1) * 0.5)) + {SCORE_BIAS} AS zq FROM zx GROUP BY vec_id)
"""


@register("m5_fixed_weight_scores", q(f"SELECT vec_id, {r4('z')} AS z, {r4('1 / (1 + exp(-z))')} AS prob, "
                                      f"{r4('1 / (1 + exp(-((z / 2) - (-z / 2))))')} AS prob2 FROM zs", _Z_SQL))
def m5_fixed_weight_scores(spark, d):
    """M5 + F13: sigmoid(w·x + b); the two-logit form [−z/2, z/2] gives the same probability."""
    s = _scores(spark, d)
    return s.select("vec_id", round4("z").alias("z"), round4(sigmoid("z")).alias("prob"),
                    round4(sigmoid_two_logits(-F.col("z") / 2, F.col("z") / 2)).alias("prob2"))


@register("j11_variant_scores", q(f"SELECT vec_id, {r4('1 / (1 + exp(-z))')} AS p_fp, {r4('1 / (1 + exp(-zq))')} AS p_q8 FROM zs", _Z_SQL))
def j11_variant_scores(spark, d):
    """Two variants of one scorer (full precision, 8-bit-quantised inputs) side by side."""
    s = _scores(spark, d)
    return s.select("vec_id", round4(sigmoid("z")).alias("p_fp"), round4(sigmoid("zq")).alias("p_q8"))


@register("a19_score_parity", q(f"SELECT {r4('max(abs(1 / (1 + exp(-z)) - 1 / (1 + exp(-zq))))')} AS max_abs_diff, count(*) AS n, "
                                f"max(abs(1 / (1 + exp(-z)) - 1 / (1 + exp(-zq)))) < 1e-4 AS pass FROM zs", _Z_SQL))
def a19_score_parity(spark, d):
    s = _scores(spark, d).select(sigmoid("z").alias("a"), sigmoid("zq").alias("b"))
    p = EV.parity(s, "a", "b", 1e-4)
    return p.select(round4("max_abs_diff").alias("max_abs_diff"), "n", "pass")
