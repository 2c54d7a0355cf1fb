"""The whole job of the training-data operators, against brute force or planted cases."""
import random

import pytest
from pyspark.sql import functions as F

from labelforge.llm import chosen_path, decontaminate, row_keys, secrets, sentence_spans


def said(r: random.Random, n: int) -> str:
    return " ".join(f"{r.choice('alpha beta gamma delta'.split())}{r.randrange(10**6)}" for _ in range(n)) + "."


def all_runs(texts: dict[int, str], min_sentences: int, min_words: int) -> dict[int, set[int]]:
    """The sentences that a later place of any run covers, every run of every length compared."""
    first, gone = {}, {}
    for d in sorted(texts):
        s = sentence_spans.sentences(texts[d])
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                if sum(x[3] for x in s[i:j]) >= min_words and (j - i >= min_sentences or j - i == 1):
                    if first.setdefault(tuple(x[2] for x in s[i:j]), (d, i)) != (d, i):
                        gone.setdefault(d, set()).update(range(i, j))
    return gone


@pytest.mark.parametrize("min_sentences", [2, 3])
def test_sentence_spans_equal_all_runs(spark, min_sentences):
    r = random.Random(11)
    passage = [said(r, n) for n in (25, 12, 5, 5, 5)]
    line, short = said(r, 40), [said(r, n) for n in (14, 5, 14)]
    parts = [[said(r, r.choice((3, 6, 11, 20, 34))) for _ in range(r.randrange(1, 5))] for _ in range(12)]
    texts = [[said(r, 9), *passage, said(r, 50)], [said(r, 8), *passage, said(r, 45)], passage, [line], [line], [said(r, 7), *short], [*short, said(r, 4)]]
    texts += [[x for _ in range(r.randrange(1, 5)) for x in [*r.choice(parts), said(r, r.randrange(1, 30))]] for _ in range(60)]
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    want = all_runs(texts, min_sentences, 30)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {x.doc_id: x for x in sentence_spans.repeated_spans(docs, min_sentences=min_sentences).collect()}
    got = {d: {k for k, s in enumerate(sentence_spans.sentences(texts[d])) for c in x.removed if c.start <= s[0] < c.end} for d, x in rows.items()}
    assert got == want and {1, 2, 4, 6} <= set(want) and want[1] == {1, 2, 3, 4, 5}
    assert all(x.n_removed == len(want[d]) for d, x in rows.items())


def test_stages_judge_rows_and_not_ids(spark):
    r = random.Random(3)
    a, b, c, d, e, f, g = [said(r, 120) for _ in range(7)]
    near = c[:-1] + " more."
    rows = [(1, a), (1, b), (None, a), (None, c), (None, near), (None, c), (2, d), (2, d), (3, d), (None, ""), (None, ""), (4, e), (4, None), (4, "")]
    docs = spark.createDataFrame([(*x, i) for i, x in enumerate([*rows, *[(None, f)] * 40])], "doc_id bigint, text string, n int")
    left = chosen_path.keep_one(docs)
    got = sorted(((x.doc_id, x.text) for x in left.collect()), key=str)
    named = [x for x in got if x[1] not in (c, near)]
    assert left.columns == docs.columns and len(got) == len(named) + 1
    assert named == sorted([(1, a), (1, b), (2, d), (None, ""), (None, ""), (4, e), (4, None), (4, ""), (None, f)], key=str)
    bench = spark.createDataFrame([(1, " ".join(f.split()[20:60])), (2, " ".join(e.split()[50:90]))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, a), (None, f), (None, b), (4, e), (4, d), (None, None), (5, g)], "doc_id bigint, text string")
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(((x.doc_id, x.text) for x in clean.collect()), key=str) == sorted([(1, a), (None, b), (4, d), (None, None), (5, g)], key=str)


def test_row_keys_part_rows_that_meet(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (1, None), (1, "")], "doc_id bigint, text string")
    real, salts = row_keys._hashed, []

    def meets(ident, text, salt):
        salts.append(salt)
        return F.lit(7) if salt == 0 else real(ident, text, salt)

    monkeypatch.setattr(row_keys, "_hashed", meets)
    _, keys = row_keys.row_keys(docs)
    assert sorted(x.n for x in keys.collect()) == [1, 1, 1, 1, 2] and salts == [0, 1, 2, 3]


def test_secrets_behind_paths_of_all_classes_and_short(spark):
    key = "Zk3q9XvB7wLm2RtY8pHs4NcD"
    held = [("net/api/keys/", key, ""), ("net/services/T0/B0/", key, ""), ("/net/api/keys/", key + "/list", ""), ("see ", "Zk3q9sampleXvB7wLm2RtY8pHs4Nc", " x"),
            ("id ", "k3q9xzvb7wlm2rty8phs4ncd5fg6", "."), ("ID ", "K3Q9XZVB7WLM2RTY6PHS4NCD5FG7", "."), ("pw ", "Zk3q9XvB7wLm2RtY", ""), ("pw ", "k3q9xzvb7wlm2rty8p", ""),
            ("pw ", "K3Q9XZVB7WLM2RTY6P", ""), ("x ", "9f3a17c0be52d846", " x"), ("net/api/keys/", "Zk3q9XvB7wLm2RtY8p", "")]
    free = ["usr/local/share/doc/manuals/english/Readme2", "id 123e4567-e89b-12d3-a456-426614174000", "your-api-key-example-0123456789-ABCDEF", "internationalization2024",
            "ThingsAboutTheHouse24", "SEPTEMBERMEETING2024", "an ordinary sentence of 2024", "x" * 5000 + "X1", "a/" * 9000 + "B1", "=-" * 9000 + "aB1"]
    texts = [a + b + c for a, b, c in held] + free
    rows = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, (a, b, _) in enumerate(held):
        at = len(a) - len("T0/B0/") if "T0" in a else len(a)
        assert (at, len(a + b)) in {(s.start, s.end) for s in rows[i].found}, texts[i]
    assert [t[:60] for i, t in enumerate(texts) if i >= len(held) and rows[i].found] == []


@pytest.mark.parametrize("c", secrets.CLASSES, ids=lambda c: c.kind)
def test_random_keys_are_found(spark, c):
    r = random.Random(8)
    chars = [x for x in c.chars if c.kind != "entropy_hex" or not x.isupper()]
    keys = ["".join(r.choice(chars) for _ in range(n)) for n in (16, 19, 23, 24, 40) for _ in range(60)]
    keys = [k for k in keys if any(x.isdigit() for x in k) and (c.kind != "entropy_base64" or any(x.isupper() for x in k) and any(x.islower() for x in k))]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(keys)), "doc_id bigint, text string")).collect()
    assert sum(bool(x.found) for x in rows) >= 0.97 * len(keys) > 200


def test_items_without_an_id_still_clean_the_documents(spark):
    r = random.Random(12)
    item, other = (" ".join(f"w{r.randrange(500)}" for _ in range(40)) for _ in range(2))
    docs = spark.createDataFrame([(1, f"before it {item} behind it"), (2, " ".join(f"v{r.randrange(500)}" for _ in range(60))), (3, f"{other} end")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, item), (None, item), (4, other), (4, None), (None, None)], "item_id bigint, text string")
    assert [x.doc_id for x in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
    assert [(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, bench).collect()] == [(3, 4)]


@pytest.mark.parametrize("max_bits", [64, 400, 2000])
def test_urls_are_judged_alike_beyond_the_cascades_bound(spark, max_bits):
    from labelforge.llm import bloom_cascade as B
    from labelforge.llm.queries import URL_RULES
    r = random.Random(4)
    urls = [f"http://{r.choice(['', 'a.', 'b.c.'])}{r.choice(['x', 'bad', 'spam'])}{r.randrange(40)}.{r.choice(['com', 'org', 'net', 'example.org'])}{r.choice(['/', '/fr/1', '/de/2', '/en/17', '/es/', ''])}?q" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate([*urls, None, "no scheme"])), "page_id bigint, url string")
    blocked = spark.createDataFrame([(f"{w}{k}.{t}",) for w in ("bad", "spam") for k in range(40) for t in ("com", "net")], "host string")
    want = sorted(map(str, B.judge(pages, URL_RULES, blocked).collect()))
    assert sorted(map(str, B.judge(pages, URL_RULES, blocked, max_bits=max_bits).collect())) == want
    assert sum("verdict='block'" in x for x in want) > 50
