"""The Merkle manifest against a plain recomputation, and its defined cases."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from labelforge.llm import merkle
from labelforge.llm.queries import REGISTRY

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, idx bigint, n bigint, tree bigint, leaf string, path string, node string"
SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(one(v) for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """(root, siblings of each digest level by level with the place in the run)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        runs = [level[i:i + 8] for i in range(0, len(level), 8)]
        for k, i in enumerate(at):
            run, j = runs[i // 8], i % 8
            paths[k].append((run[:j], run[j + 1:]))
        at, level = [i // 8 for i in at], [sha("".join(r)) for r in runs]
    return level[0], paths


def plain(rows):
    """rows of (doc_id, text, lang, source, n_chars) → the query's rows, by the contract's words."""
    def asc(v):
        return (v is not None, v.encode() if isinstance(v, str) else v or 0)
    by = {}
    for doc_id, text, lang, source, n_chars in rows:
        by.setdefault(lang, []).append((doc_id, leaf_of(doc_id, source, lang, n_chars, text), text, source, n_chars))
    langs = sorted(by, key=asc)
    trees = {}
    for g in langs:
        by[g].sort(key=lambda r: (asc(r[0]), r[1]))
        trees[g] = tree([r[1] for r in by[g]])
    root, tops = tree([trees[g][0] for g in langs]) if langs else (None, [])
    out = []
    for g, top in zip(langs, tops):
        for (doc_id, leaf, text, source, n_chars), path in zip(by[g], trees[g][1]):
            steps = path + top
            low = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf_of(doc_id, source, g, n_chars, low) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else leaf
            for left, right in steps:
                fold = sha("".join([*left, fold, *right]))
            out.append((doc_id, leaf, trees[g][0], root, sha("".join(x for a, b in steps for x in (*a, *b))), fold, fold == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))


def got(df):
    m = merkle.audit(df).drop("position", "path")
    assert m.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return order([tuple(r) for r in m.collect()])


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "l", "p", "n") for r in rows], SCHEMA)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, "fr": 1}, {"en": 65, None: 3, "de": 8, "": 1}, {f"l{i:02d}": 1 + i % 3 for i in range(70)}, {"en": 600, "é": 17, "z": 64}])
def test_equals_a_plain_recomputation(spark, sizes):
    rnd = random.Random(str(sizes))
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            k += rnd.randrange(1, 5)
            text = rnd.choice([None, "", "ABC é Ü", "plain lower", f"Doc {k} Ω", "x" * rnd.randrange(200)])
            rows.append((k, text, lang, rnd.choice([None, "s1", "s2"]), rnd.choice([None, 7, 12345])))
    rnd.shuffle(rows)
    want = order(plain(rows))
    assert got(table(spark, rows)) == want
    assert any(r[6] for r in want) or len(rows) < 3


def test_null_ids_repeated_rows_and_ties(spark):
    rows = [(None, "A", "en", None, None), (None, None, None, "s", 1), (5, "Same", "en", "s", 4), (5, "Same", "en", "s", 4),
            (5, "other", "en", "s", 5), (-3, "Neg", "en", "s", 3), *[(10 + i, f"T{i}", "en", "s", i) for i in range(20)]]
    assert got(table(spark, rows)) == order(plain(rows))


def test_long_text_and_empty_table(spark):
    rows = [(1, "Ab " * 1_000_000, "en", "s", 1), (2, "b", "en", "s", 1)]
    assert got(table(spark, rows)) == order(plain(rows))
    assert got(table(spark, rows).limit(0)) == []


def test_one_group_of_most_rows_on_few_partitions(spark):
    rows = [(i, f"T {i}", "en" if i % 10 else "fr", "s", i) for i in range(4200)]
    assert got(table(spark, rows).repartition(3)) == order(plain(rows))


def test_the_proof_of_each_row_leads_to_the_root(spark):
    rows = [(i, f"text {i}", f"l{i % 3}", "s", i) for i in range(500)]
    m = merkle.manifest(table(spark, rows))
    assert m.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert m.where(merkle.folded(F.sha2(F.col("leaf"), 256), F.col("path")) == F.col("root")).count() == 0


def test_registered_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    q = REGISTRY["op13_merkle_manifest"][0](spark, SF)
    assert order([tuple(r) for r in q.collect()]) == order(plain(rows))
