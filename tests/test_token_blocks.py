"""Texts folded in blocks: the same pooled vectors and top words, from joins per token of a block."""
import pytest
from pyspark.sql import functions as F

from labelforge.functions import vectors as VF
from labelforge.operators import embed as E

DOCS = [(1, "the cat the dog"), (2, " a cat\n"), (2, "dog dog The"), (None, "cat x"), (None, "x y"), (3, None), (4, ""), (5, "  "),
        (6, "Été été cat"), (7, "z2 z1"), (8, "the " * 40 + "cat")]
VECTORS = [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (1, [3.0, None]), (2, None), (4, [2.0, 2.0]), (5, [0.0, 1.0]), (9, [7.0, 7.0])]


@pytest.fixture(params=[2, 10_000])  # rows of a block
def docs(spark, request):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, request.param)
    yield spark.createDataFrame(DOCS, "doc_id bigint, text string").coalesce(1)
    spark.conf.unset(key)


def rows(df):
    return sorted(((r[0], [None if x is None else round(x, 9) for x in r[1]]) for r in df.collect()), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pooling_by_blocks_equals_pooling_by_rows(spark, docs, kind):
    vec = spark.createDataFrame(VECTORS, f"vec_id bigint, embedding array<{kind}>")
    tokens = E.tokenize(docs, "doc_id", "text")
    vocab = E.build_vocab(tokens)
    plain = E.attach_token_ids(E.token_counts(tokens, "doc_id"), vocab, 7, folded=True)
    blocks = E.token_blocks(docs, "doc_id", "text")
    mine = E.build_vocab(E.block_tokens(blocks))
    assert sorted(mine.collect()) == sorted(vocab.collect())
    held = E.attach_token_ids(E.block_tokens(blocks), mine, 7, folded=True)
    for weight in (None, E.sif_weight("logp")):
        for l2 in (False, True):
            want = rows(E.pool(plain, vec, "doc_id", 2, weight=weight, l2=l2))
            assert want and rows(E.pool(held, vec, "doc_id", 2, weight=weight, l2=l2, blocks=blocks)) == want
    found = plain.join(vec.withColumnRenamed("vec_id", "vid"), "vid").groupBy("doc_id").agg(F.sum("cnt").alias("n"))
    got = E.gather(blocks, held, vec, "doc_id", 2).select("doc_id", "n")
    assert sorted(got.collect(), key=str) == sorted(found.collect(), key=str)


def test_top_tokens_by_blocks(spark, docs):
    per = E.token_counts(E.tokenize(docs, "doc_id", "text"), "doc_id")
    want = per.groupBy("doc_id").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "token")).alias("m")).select("m.token").distinct()
    assert sorted(E.top_tokens(E.token_blocks(docs, "doc_id", "text"), "doc_id").collect()) == sorted(want.collect())


def test_no_rows(spark):
    blocks = E.token_blocks(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), "doc_id", "text")
    vec = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>")
    tokens = E.block_tokens(blocks)
    held = E.attach_token_ids(tokens, E.build_vocab(tokens), 7, folded=True)
    assert E.pool(held, vec, "doc_id", 2, blocks=blocks).collect() == [] and E.top_tokens(blocks, "doc_id").collect() == []


def test_joined_rows_grow_with_the_tokens_of_a_block(spark):
    docs = spark.range(0, 500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"))
    assert E.block_tokens(E.token_blocks(docs, "doc_id", "text")).count() == 5  # 2500 (document, token) rows before


def test_the_norm_is_not_computed_for_every_element(spark):
    df = spark.range(1).select(F.array(F.lit(3.0), F.col("id") + 4.0).alias("v")).select(VF.normalize("v").alias("v"))
    assert [r.v for r in df.collect()] == [[0.6, 0.8]]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "array_repeat(" in plan


@pytest.mark.parametrize("words, texts", [(1 << 24, 1 << 15), (6, 100), (100, 3), (1, 1)])
def test_blocks_go_on_from_batch_to_batch(spark, docs, words, texts):
    """A block's size depends on its words and texts, not on the Arrow batches: fewer blocks name a token again."""
    blocks = E.token_blocks(docs, "doc_id", "text", words, texts)
    per = blocks.where("tokens IS NULL").groupBy("block").agg(F.count("*").alias("n"), F.sum(F.aggregate("counts", F.lit(0), lambda a, x: a + x)).alias("w")).collect()
    assert all(r.n <= texts and (r.w <= words or r.n == 1) for r in per)
    if words > 100:
        assert len(per) == 1  # one for every two rows before, with batches of two
        assert E.block_tokens(blocks).count() == E.tokenize(docs, "doc_id", "text").select("token").distinct().count()
    z = blocks.where("tokens IS NULL").select("block", "doc_id", F.explode(F.arrays_zip("places", "counts")).alias("z"))
    z = z.select("block", "doc_id", F.col("z.places").alias("place"), F.col("z.counts").alias("n"))
    got = z.join(E.block_tokens(blocks), ["block", "place"]).groupBy("doc_id", "token").agg(F.sum("n").alias("n"))
    want = E.token_counts(E.tokenize(docs, "doc_id", "text"), "doc_id")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    vec = spark.createDataFrame(VECTORS, "vec_id bigint, embedding array<float>")
    held = E.attach_token_ids(E.block_tokens(blocks), E.build_vocab(E.block_tokens(blocks)), 7, folded=True)
    tokens = E.tokenize(docs, "doc_id", "text")
    plain = E.attach_token_ids(want, E.build_vocab(tokens), 7, folded=True)
    assert rows(E.pool(held, vec, "doc_id", 2, blocks=blocks)) == rows(E.pool(plain, vec, "doc_id", 2))


def test_the_tokens_of_a_large_block_come_in_rows_of_bounded_size(spark):
    n = E.NAMES_ROW + 100
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))))
    blocks = E.token_blocks(spark.range(0, 2, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")), "doc_id", "text")
    assert blocks.agg(F.max(F.size("tokens"))).first()[0] <= E.NAMES_ROW
    t = E.block_tokens(blocks)
    assert t.agg(F.count("*"), F.countDistinct("place"), F.max("place"), F.min("cnt"), F.max("cnt")).first() == (n, n, n - 1, 2, 2)


@pytest.mark.parametrize("large", [False, True])
def test_a_vector_goes_to_runs_of_blocks_and_not_to_every_block(spark, monkeypatch, large):
    """Blocks grow with the documents and vectors with the table: rows of (block, vector) would grow with their product."""
    if large:
        monkeypatch.setattr(E, "HELD_VECTORS", 3)  # more vectors than a run may hold: every block is one
    n = 100
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id").cast("string")).alias("text"))
    blocks = E.token_blocks(docs, "doc_id", "text", texts=1)
    tokens = E.block_tokens(blocks)
    held = E.attach_token_ids(tokens, E.build_vocab(tokens), 7, folded=True)
    vec = spark.createDataFrame([(i, [1.0 + i, -2.0 * i]) for i in range(7)], "vec_id bigint, embedding array<float>")
    got = E.gather(blocks, held, vec, "doc_id", 2)
    assert got.count() == n and got.agg(F.min("n"), F.max("n")).first() == (4, 4)
    runs, run = E._block_runs(blocks, vec)
    sent = blocks.select(run.alias("run")).distinct().count()
    assert sent == runs == (n if large else min(n, E.GATHER_WAVES * spark.sparkContext.defaultParallelism))
    words = E.tokenize(docs, "doc_id", "text")
    plain = E.attach_token_ids(E.token_counts(words, "doc_id"), E.build_vocab(words), 7, folded=True)
    for weight in (None, E.sif_weight("logp")):
        assert rows(E.pool(held, vec, "doc_id", 2, weight=weight, blocks=blocks)) == rows(E.pool(plain, vec, "doc_id", 2, weight=weight))
