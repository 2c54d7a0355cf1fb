"""Every operator on the awkward table: null ids and texts, empty and long texts, repeated rows,
clashing extra columns, and no rows at all."""
import random

import pytest

from labelforge.llm import (bloom_cascade, chosen_path, decontaminate, html_template, lattice, licenses, packing,
                            quality_cascade, secrets, sentence_spans)
from labelforge.llm.queries import pieces_path, ranks_path

DOCS = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, kept boolean, hash bigint, key string, "
        "id bigint, component_id bigint, words string, spans string, base string, rank bigint, length bigint, start bigint, h bigint, n bigint, word string")


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron rho sigma tau".split()) + str(r.randrange(60)) + ("." if i % 9 == 8 else "") for i in range(n))


LONG = prose(30_000, 5)
ROWS = [(1, prose(120, 1)), (2, None), (3, ""), (4, " \n\t "), (5, prose(120, 1)), (6, prose(300, 2)), (6, prose(300, 2)), (None, prose(90, 3)), (None, None), (7, LONG), (8, "one two"), (9, "x" * 70_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "en", "s", 1, 2, False, 3, "k", 4, 5, "w", "s", "b", 6, 7, 8, 9, 10, "w") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(120, 1)[:400], 9), (2, None, 9), (None, "a b c d e f g", 9), (3, "", 9)], "item_id bigint, text string, doc_id bigint")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_quality(docs, none):
    rows = by_id(quality_cascade.assess(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[2][0].n_words == 0 and not rows[2][0].kept and rows[3][0].base_failed and rows[4][0].n_words == 0
    assert rows[7][0].n_words == 30_000 and rows[9][0].word_chars == 70_000
    assert quality_cascade.keep_good(docs).columns == docs.columns
    kept = {r["doc_id"] for r in quality_cascade.keep_good(docs).collect()}
    assert kept == {i for i, rs in rows.items() if any(r.kept for r in rs)}
    assert quality_cascade.assess(none).count() == 0 and quality_cascade.keep_good(none).count() == 0


def test_secrets(docs, none):
    assert secrets.scan(docs.select("doc_id", "text")).count() == len(ROWS)
    assert secrets.redact(docs).columns == docs.columns
    same = {(r.doc_id, r.text) for r in secrets.redact(docs).collect()}
    assert same == set(ROWS)
    assert secrets.redact(none).count() == 0


def test_near_duplicates(docs, none):
    rows = by_id(chosen_path.near_duplicates(docs))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[5][0].component_id == 1 and not rows[5][0].kept and rows[1][0].kept
    assert rows[2][0].n_shingles == 0 and rows[2][0].component_id == 2 and rows[3][0].kept and rows[8][0].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in rows[None])
    left = chosen_path.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert chosen_path.near_duplicates(none).count() == 0


def test_decontamination(docs, none, bench):
    rows = decontaminate.overlaps(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (5, 1)}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == len(ROWS) - 2
    assert decontaminate.overlaps(none, bench).count() == 0 and decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_sentence_spans(docs, none):
    rows = by_id(sentence_spans.repeated_spans(docs))
    assert set(rows) == {5} and rows[5][0].first_doc_ids == [1]
    out = sentence_spans.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert sentence_spans.repeated_spans(none).count() == 0


def test_packing(docs, none, spark):
    p = packing.pack(packing.tokenize(docs, ranks_path(spark)))
    rows = p.collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        end = 0
        for o, n in sorted(pieces):
            assert o == end
            end += n
        assert end <= packing.SIZE
    assert {r.doc_tokens for r in rows if r.doc_id == 2} == {1}
    assert sum(r.length for r in rows if r.doc_id == 6) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 6)
    assert packing.pack(packing.tokenize(none, ranks_path(spark))).count() == 0


def test_lattice(docs, none, spark):
    rows = by_id(lattice.score(docs, pieces_path(spark), rounds=1))
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[2][0].n_tokens == 1 and rows[7][0].n_tokens == 30_001 and rows[9][0].n_tokens == 2
    assert all(r.score < 0 and r.base_score < 0 for rs in rows.values() for r in rs)
    assert rows[6][0].score == rows[6][1].score and not rows[None][0].held_out
    assert lattice.score(none, pieces_path(spark)).count() == 0


def test_licenses(docs, none):
    rows = by_id(licenses.scan(docs))
    assert sum(map(len, rows.values())) == len(ROWS) and rows[2][0].n_words == 0 and rows[2][0].first_word is None and rows[7][0].n_words == 30_000
    assert licenses.scan(none).count() == 0


def test_pages(spark):
    kind = "page_id bigint, url string, html string, host string, text string, tree bigint, rule string, path string, listed boolean"
    pages = spark.createDataFrame([(i, u, h, "h", "t", 1, "r", "p", True) for i, u, h in [
        (1, "http://A.org/x?q", "<p>a &amp;  b"), (2, None, None), (3, "no scheme", ""), (None, "http://b.com", "<div><script>x</script>" + "w " * 40_000 + "</div>"),
        (1, "http://A.org/x?q", "<p>a &amp;  b")]], kind)
    got = sorted((r.page_id or 0, r.text) for r in html_template.extract(pages).collect())
    assert got[1:] == [(1, "a & b"), (1, "a & b"), (2, ""), (3, "")] and got[0][1].startswith("w w") and len(got[0][1]) == 79_999
    assert html_template.extract(pages.limit(0)).count() == 0
    rules = [bloom_cascade.UrlRule("block", "org", "/x")]
    for listed in (spark.createDataFrame([("b.com",)], "x string"), spark.createDataFrame([], "x string")):
        rows = {r.page_id: r for r in bloom_cascade.judge(pages, rules, listed).collect()}
        assert rows[1].verdict == "block" and rows[1].rule == "org/x" and rows[1].host == "a.org" and rows[2].host == rows[2].path == rows[3].host == ""
        assert rows[None].verdict == ("block" if listed.count() else "allow") and rows[None].rule is None
    assert bloom_cascade.judge(pages.limit(0), rules, listed).count() == 0
