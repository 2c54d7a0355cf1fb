"""Sentence spans by row, and the secret scan on very long runs and very many matches."""
import base64
import hashlib
import math
import random
import re
import time

import pytest

from labelforge.llm import secrets, sentence_spans

from test_whole_job import said


def by_text(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect())


def test_different_texts_under_one_id_and_rows_without_id(spark):
    r = random.Random(4)
    passage = " ".join(said(r, n) for n in (20, 18))
    clean = [" ".join(said(r, 12) for _ in range(4)) for _ in range(4)]
    rows = [(5, f"{clean[0]} {passage}"), (5, clean[1]), (3, f"{passage} {clean[2]}"), (None, f"{clean[3]} {passage}"), (None, clean[3] + " x."),
            (9, passage), (9, passage), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {(x.doc_id, x.text) for x in sentence_spans.repeated_spans(docs).collect()}
    # row 3 is the first that holds the passage; whoever repeats it loses it, the others keep every byte
    assert {(5, f"{clean[0]} "), (9, "")} <= found and not any(d == 3 for d, _ in found)
    out = sentence_spans.deduplicated(docs)
    kept = [(d, t) for d, t in rows if (d, t) not in {(5, f"{clean[0]} {passage}"), (9, passage), (None, f"{clean[3]} {passage}"), (None, clean[3] + " x.")}]
    got = [(x.doc_id, x.text) for x in out.collect()]
    assert len(got) == len(rows) and all(k in got for k in kept) and got.count((9, "")) == 2 and (5, f"{clean[0]} ") in got
    assert sum(passage in (t or "") for _, t in got) == 1
    # of the two rows without id, one keeps the sentences that both hold
    assert sum(clean[3] in (t or "") for d, t in got if d is None) == 1


def test_a_passage_in_two_texts_of_one_id_goes_from_one(spark):
    r = random.Random(5)
    passage, a, b = (" ".join(said(r, 20) for _ in range(2)) for _ in range(3))
    docs = spark.createDataFrame([(1, f"{a} {passage}"), (1, f"{passage} {b}")], "doc_id bigint, text string")
    texts = [x.text for x in sentence_spans.deduplicated(docs).collect()]
    assert sum(passage in t for t in texts) == 1 and len(texts) == 2


def windows(run, w):
    best, n = 0.0, {}
    for i, ch in enumerate(run):
        n[ch] = n.get(ch, 0) + 1
        if i >= w:
            n[run[i - w]] -= 1
        if i >= w - 1:
            best = max(best, -sum(k / w * math.log2(k / w) for k in n.values() if k))
    return best


def test_one_run_of_a_megabyte_and_a_hundred_thousand_hashes(spark):
    r = random.Random(6)
    run = base64.b64encode(r.randbytes(786_432)).decode()
    hashes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(100_000)]
    rows = [(1, f"é {run} end"), (2, " é ".join(hashes))]
    for one, limit in ((rows[:1], 30), (rows[1:], 30)):
        df = spark.createDataFrame(one, "doc_id bigint, text string")
        start = time.time()
        got = secrets.scan(df).collect()[0]
        assert time.time() - start < limit
        text = one[0][1]
        if got.doc_id == 1:
            whole = next(m for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text))
            path = re.match(secrets.PATH, whole[0])
            assert [(s.start, s.end) for s in got.found if s.kind == "entropy_base64"] == [(whole.start() + (path.end() if path else 0), whole.end())]
            low = [m.span() for m in re.finditer(r"[a-z0-9]{16,}", text) if re.search("[0-9]", m[0]) and re.search("[g-z]", m[0])
                   and (windows(m[0], 24) >= 3.4 if len(m[0]) >= 24 else windows(m[0], 16) >= 3.0)]
            assert [(s.start, s.end) for s in got.found if s.kind == "entropy_lower"] == low
        else:
            assert got.n_hex == 100_000 and [(s.start, s.end) for s in got.base] == [(i * 35, i * 35 + 32) for i in range(100_000)]
            few = spark.createDataFrame([(2, " é ".join(hashes[:10_000]))], "doc_id bigint, text string")
            start = time.time()
            assert secrets.redact(few).collect()[0].text == " é ".join(["[SECRET]"] * 10_000)
            assert time.time() - start < limit


@pytest.mark.parametrize("seed", range(3))
def test_redaction_by_slices_equals_plain_cutting(spark, monkeypatch, seed):
    monkeypatch.setattr(secrets, "SLICE", 7)
    monkeypatch.setattr(secrets, "BATCH", 2)
    r = random.Random(seed)
    texts = []
    for _ in range(30):
        parts = [r.choice(["é" * r.randrange(9), "plain words", "secret=" + "k" * r.randrange(4, 30), hashlib.md5(str(r.random()).encode()).hexdigest(),
                           "password: AKIA" + "Z9" * r.randrange(4, 12), "\n😀"]) for _ in range(r.randrange(12))]
        texts.append(r.choice([" ", ""]).join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {x.doc_id: x.found for x in secrets.scan(df).collect()}
    for x in secrets.redact(df).collect():
        t, out, at = texts[x.doc_id], "", 0
        merged = []
        for s in spans[x.doc_id]:
            if merged and s.start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s.end)
            else:
                merged.append([s.start, s.end])
        for a, e in merged:
            out, at = out + t[at:a] + "[SECRET]", e
        assert x.text == out + t[at:]
