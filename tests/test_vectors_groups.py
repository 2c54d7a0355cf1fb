import math

from pyspark.sql import functions as F

from labelforge.functions import vectors as VF
from labelforge.operators import embed as E
from labelforge.operators import groups as G


def test_cosine_zero_vector_and_symmetry(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(VF.cosine("a", "b").alias("ab"), VF.cosine("b", "a").alias("ba")).collect()
    assert r[0].ab == 0.0
    assert abs(r[1].ab - 0.8) < 1e-12 and r[1].ab == r[1].ba


def test_normalize_keeps_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r[0] for r in df.select(VF.normalize("v")).collect()] == [[0.0, 0.0], [0.6, 0.8]]


def test_f8_pad_mask_empty_list(spark):
    df = spark.createDataFrame([([],), ([5, 6, 7, 8],)], "ids array<bigint>")
    ids, mask = E.pad_ids("ids", 3)
    r = df.select(ids.alias("i"), mask.alias("m"), E.attention_mask(mask).alias("a")).collect()
    assert r[0].i == [0, 0, 0] and r[0].m == [False, True, True] and r[0].a == [1, 0, 0]
    assert r[1].i == [5, 6, 7] and r[1].m == [False, False, False]


def test_argmax_ties(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.5],)], "v array<double>")
    r = df.select(VF.argmax("v"), VF.argmax2(F.col("v")[0], F.col("v")[1])).collect()[0]
    assert tuple(r) == (0, 0)


def test_vocab_pool_and_sif(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id long, text string")
    toks = E.tokenize(docs, "doc_id", "text")
    vocab = {r.token: r for r in E.build_vocab(toks).collect()}
    assert vocab["a"].token_id == 0 and vocab["b"].token_id == 1 and vocab["c"].token_id == 2
    assert abs(vocab["a"].p - 2 / 5) < 1e-12
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    ids = E.attach_token_ids(E.token_counts(toks, "doc_id"), E.build_vocab(toks))
    got = {r.doc_id: r.vector for r in E.pool(ids, vec, "doc_id", 2, l2=False).collect()}
    assert got[1] == [2 / 3, 1 / 3]
    sif = {r.doc_id: r.vector for r in E.pool(ids, vec, "doc_id", 2, weight=E.sif_weight("logp")).collect()}
    wa, wb = 1e-3 / (1e-3 + 0.4), 1e-3 / (1e-3 + 0.4)
    x = [2 * wa / (2 * wa + wb), wb / (2 * wa + wb)]
    n = math.hypot(*x)
    assert all(abs(a - b / n) < 1e-12 for a, b in zip(sif[1], x))


def test_ids_beyond_vector_table_fall_back(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    toks = E.tokenize(docs, "doc_id", "text")
    ids = E.attach_token_ids(toks, E.build_vocab(toks), n_vectors=2)
    assert sorted(r.vid for r in ids.collect()) == [0, 0, 0, 1]


def test_idf_mean_is_one(spark):
    docs = spark.createDataFrame([(1, "a a a b"), (2, "c a")], "doc_id long, text string")
    w = E.idf_weights(E.build_vocab(E.tokenize(docs, "doc_id", "text")))
    vals = [r.idf for r in w.collect()]
    assert abs(sum(vals) / len(vals) - 1) < 1e-12


def test_cosine_matrix_of_a_probe_list_and_of_two_tables(spark, monkeypatch):
    monkeypatch.setattr(E, "PROBE_BLOCK", 3)
    monkeypatch.setattr(E, "VECTOR_BLOCK", 5)

    def cos(x, y):
        n = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
        return sum(a * b for a, b in zip(x, y)) / n if n else 0.0
    vs = {f"p{i:02d}": [float(i % 4), 1.0 * (i % 3), -0.5 * i] for i in range(11)}
    vs["zero"] = [0.0, 0.0, 0.0]
    probes = spark.createDataFrame([*vs.items(), ("none", None)], "id string, embedding array<double>").repartition(4)
    got = {(r.id_a, r.id_b): r.cosine for r in E.cosine_matrix(probes).collect()}
    names = sorted(vs)
    assert set(got) == {(a, b) for i, a in enumerate(names) for b in names[i + 1:]}
    assert all(abs(c - cos(vs[a], vs[b])) < 1e-12 for (a, b), c in got.items())
    ws = {k: [1.0, float(k), 2.0] for k in range(23)}
    table = spark.createDataFrame(list(ws.items()), "id long, embedding array<float>")
    got = E.cosine_matrix(probes, table).collect()
    assert len(got) == 12 * 23 and all(abs(r.cosine - cos(vs[r.id_a], ws[r.id_b])) < 1e-6 for r in got)
    assert E.cosine_matrix(probes.limit(0), table).count() == 0 and E.cosine_matrix(probes, table.limit(0)).count() == 0 and E.cosine_matrix(probes.limit(0)).count() == 0


def test_centroid_cosine(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "vec_id long, label int, embedding array<float>")
    r = {x.vec_id: x.cosine for x in E.centroid_cosine(v, "label").collect()}
    assert abs(r[1] - math.sqrt(0.5)) < 1e-12


def test_group_offsets_range_join_and_chunks(spark):
    rows = [(i, "b" if i < 7 else "a", i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, grp string, y int")
    offs = {r.grp: (r.ord, r.n, r.off) for r in G.group_offsets(df, ["a", "b", "empty"]).collect()}
    assert offs == {"a": (0, 3, 0), "b": (1, 7, 3), "empty": (2, 0, 10)}
    ids = G.corpus_ids(df, ["a", "b", "empty"], key="k")
    back = G.range_join(ids.select("id", F.col("grp").alias("g0")), "id", G.group_offsets(df, ["a", "b", "empty"]), bins=4)
    assert back.filter("g0 <> grp").count() == 0 and back.count() == 10
    ch = {(r.grp, r.chunk): r.labels for r in G.label_chunks(ids, "grp", "gpos", "y", chunk=4).collect()}
    assert ch == {("a", 0): "101", ("b", 0): "0101", ("b", 1): "010"}


def test_vector_ids_beyond_the_vector_table_fall_to_the_unknown_one(spark):
    docs = spark.createDataFrame([(1, "a b a c d d d e"), (2, "b c c f g h")], "doc_id long, text string")
    toks = E.tokenize(docs, "doc_id", "text")
    vocab = E.build_vocab(toks)
    full = {r.token: r.token_id for r in vocab.collect()}
    assert full == {t: i for i, t in enumerate(["c", "d", "a", "b", "e", "f", "g", "h"])}
    for k in (1, 3, 5, 100):
        got = {(r.token, r.vid) for r in E.attach_token_ids(toks, vocab, k).collect()}
        assert got == {(t, i if i < k else 0) for t, i in full.items()}
