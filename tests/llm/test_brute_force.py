"""The operators against brute force, exact round trips and held-out likelihood on small tables."""
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from labelforge.llm import bloom_cascade, chosen_path, decontaminate, html_template, lattice, licenses, packing, quality_cascade, secrets
from labelforge.llm.components import components
from labelforge.llm.queries import REGISTRY, pieces_path

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ka lo mi ne ru ta vo zi".split() for b in "da fe gi ho lu pa ri so".split()]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def joined(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in itertools.combinations(sorted(i for i in sets if sets[i]), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("work", [chosen_path.WORK, 2000])
def test_chosen_path(spark, monkeypatch, work):
    """Chains and clusters of edited copies; with little ``WORK`` nodes branch and end in blocks."""
    monkeypatch.setattr(chosen_path, "WORK", work)
    monkeypatch.setattr(chosen_path, "MAX_DEPTH", 6)
    monkeypatch.setattr(chosen_path, "BLOCK_ROWS", 10)
    r = random.Random(3)
    docs, i = {}, 0
    for _ in range(12):
        w = [r.choice(WORDS) for _ in range(r.randrange(40, 160))]
        for _ in range(r.choice([1, 2, 12])):
            docs[i] = " ".join(w)
            i += 1
            if r.random() < 0.7:
                w = list(w)
                w[r.randrange(len(w))] = r.choice(WORDS)
    got = chosen_path.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == joined(docs)


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 5), (30, 31)]
    got = {r.id: r.component for r in components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 20: 1, 7: 7, 8: 7, 9: 7, 30: 30, 31: 30}


def test_decontamination_tolerates_substitutions(spark):
    r = random.Random(1)
    item = [r.choice(WORDS) for _ in range(40)]
    swapped = ["xxxx" if i % 6 == 5 else w for i, w in enumerate(item)]
    clean = [r.choice(WORDS) for _ in range(300)]
    docs = spark.createDataFrame([(1, " ".join(clean[:100] + swapped + clean[100:])), (2, " ".join(clean)), (3, ("; ".join(clean[:60] + item[:20])).upper())], "doc_id bigint, text string")
    rows = {x.doc_id: x for x in decontaminate.overlaps(docs, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()}
    assert set(rows) == {1, 3} and rows[1].doc_start == 100 and rows[1].matches == 34 and rows[3].doc_start == 60 and rows[3].overlap == 20


def test_secrets_match_regexes(spark, texts):
    rows = {r.doc_id: r for r in REGISTRY["op3_secret_entropy"][0](spark, SF).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    for i, t in texts.items():
        s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 8]
        s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        w = [f"{k}:{a}:{b}" for a, _, b, k in sorted(s)]
        assert rows[i].base_sha256 == hashlib.sha256(",".join(w).encode()).hexdigest() and set(w) <= set(rows[i].spans.split(",")) | {""}


def test_entropy_window_and_allow_list(spark):
    key, r = "Zk3q9XvB7wLm2RtY8pHs4NcD", random.Random(2)
    uuid = "123e4567-e89b-12d3-a456-426614174000"
    docs = spark.createDataFrame([(1, f"é {key} é"), (2, "a" * 30 + "B1" + " thing " + "Abc1" * 8), (3, f"id {uuid}"), (4, "token: abc secret=token=abcdefgh")], "doc_id bigint, text string")
    rows = {x.doc_id: x for x in secrets.scan(docs).collect()}
    assert [(s.start, s.end, s.kind) for s in rows[1].found] == [(2, 26, "entropy_base64")]
    assert rows[2].found == [] and rows[3].found == [] and [s.start for s in rows[4].base] == [11]
    red = {x.doc_id: x.text for x in secrets.redact(docs).collect()}
    assert red[1] == "é [SECRET] é" and red[4] == "token: abc [SECRET]"
    run = "".join(r.choice(secrets.CLASSES[1].chars) for _ in range(60))
    got = spark.range(1).select(secrets.best_window_bits(F.lit(run), secrets.CLASSES[1]).alias("x")).first().x
    h = lambda s: -sum(c / len(s) * math.log2(c / len(s)) for c in collections.Counter(s).values())
    assert got == pytest.approx(max(h(run[i:i + 24]) for i in range(37)))


def test_cascade_is_exact_and_equals_the_join(spark):
    keys = [f"k{i}" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys[::7]], "k string")
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    c = bloom_cascade.build(listed, rows, "t")
    got = {r.k for r in c.attach(rows).where(c.contains(F.col("k"))).collect()}
    assert got == set(keys[::7]) and len(c.levels) >= 2
    assert {r.k for r in bloom_cascade.member_by_join(rows, "k", listed, "y").where("y").collect()} == got
    with pytest.raises(ValueError):
        bloom_cascade.build(listed, rows, "t", max_bits=64)


def test_cascade_order_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").withColumn("ws", quality_cascade.words(F.col("text")))
    rules = quality_cascade.text_rules(F.col("text"), F.col("ws"))
    a, b = (docs.where(quality_cascade.verdict(x).isNull()).count() for x in (rules, rules[::-1]))
    assert a == b > 0
    R = quality_cascade.Rule
    assert [x.name for x in quality_cascade.order_rules([(R("slow", None), 0.5, 1.0), (R("fast", None), 0.4, 0.1), (R("never", None), 0.0, 0.1)])] == ["fast", "slow", "never"]


def test_packing_round_trip_and_fill(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    odd = {**texts, -1: "  two  spaces\n\n\tand tabs ", -2: " lead", -3: "it's I'll 12 ab12 <|endoftext|>  x \U0001F600"}
    r, parts = random.Random(8), ["<|endoftext|>", " ", "  ", "\n", "a", " b", "it's", "<|end", "oftext|>", "é", "<|EndOfText|>"]
    odd |= {-10 - i: "".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for i in range(300)}
    enc = packing.encoder(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    for x in odd.values():
        assert np.frombuffer(enc.ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    rows = REGISTRY["op8_shortest_pack_first"][0](spark, SF).collect()
    for r in rows:
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())
    assert sum(r.length for r in rows) >= 0.97 * 2048 * len({r.sequence_id for r in rows}) - 2048


def test_plan_places_every_piece():
    r = random.Random(4)
    counts = {n: r.randrange(1, 50) for n in r.sample(range(1, 2049), 300)}
    plan = packing.plan(counts)
    used = collections.Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += n
    assert used == counts
    assert packing.plan({100: 40}) == [((100,) * 20, 2)]


def test_lattice_sums_all_segmentations(spark):
    pieces, logp = lattice.load_pieces(pieces_path(spark))
    lat = lattice.Lattice(pieces, logp)
    words = [b"the", b"thheha", "éon".encode(), b"x" * 60]
    data, off = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0] + [len(w) for w in words])
    got = lat.score(data, off[:-1], off[1:])

    def total(w):
        a = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            a[j] = sum(a[i] * math.exp(logp[lat.where[w[i:j]]]) for i in range(j) if w[i:j] in lat.where)
        return math.log(a[-1])
    assert got == pytest.approx([total(b" " + w) for w in words])
    soft = lat.expect(data, off[:-1], off[1:], np.ones(4))
    assert soft @ np.array([len(p) for p in pieces]) == pytest.approx(sum(len(w) + 1 for w in words))


def test_lattice_training_helps_held_out(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = (lattice.score(docs, pieces_path(spark), rounds=n).where("held_out").agg(F.sum("score").alias("s")).first().s for n in (1, 2))
    assert b > a
    c = collections.Counter(x for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for x in [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), "\0"])
    n, v = sum(c.values()), len(c)
    for r in REGISTRY["op9_subword_lattice"][0](spark, SF).collect():
        w = [*re.findall(r"[^\x20\x09-\x0D]+", lower(texts[r.doc_id])), "\0"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))


def test_license_templates(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "licensed under the apache licence 2"), (3, "LICENSED under CC BY-NC-SA 4.0"),
                                  (4, "under the GNU General Public License"), (5, "licensed under the GNU General Public License version 3 or any later version")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert rows[1].labels == "apache,apache-2.0-notice" and rows[1].first_word == 3 and rows[1].score == 0.8
    assert rows[2].labels == "" and rows[3].labels == "cc-by,cc-by-notice" and rows[4].labels == "gpl" and rows[4].score == 0.5
    assert (rows[5].spans[0].first, rows[5].spans[0].last) == (0, 13)
    a = licenses.compile_template("x", "one two [[three [[four]]]] {{2}} end")
    ok = lambda t: a.accepts(lambda i: t.split()[i], 0, len(t.split())) == len(t.split())
    assert ok("one two end") and ok("one two three four a b end") and ok("one two three a end") and not ok("one two four x y end") and not ok("one two a b c end")


def test_template_removal(spark):
    r = random.Random(6)
    text = lambda: " ".join(r.choice(WORDS) for _ in range(20))
    own = {i: text() for i in range(30)}
    page = "<html><head><title>t</title></head><body><header>site</header><nav><a>x</a></nav><article><h1>T{i}</h1><p>{own}<div class='x1'><p>Please support us</div><div class=comments><p>me too</div></article><aside>y</aside></body>"
    rows = [(i, "http://h.org/", page.format(i=i, own=own[i])) for i in own]
    rows += [(100 + i, "http://h.org/", page.format(i=1, own=own[1])) for i in range(40)]
    got = {x.page_id: x.text for x in html_template.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"T{i}\n{own[i]}" for i in own} | {100 + i: f"T1\n{own[1]}" for i in range(40)}


def test_sql_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, (fn, sql) in REGISTRY.items():
        if sql:
            got = fn(spark, SF)
            cols = sorted(got.columns)
            exp = con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
            assert sorted(map(str, got.select(*cols).toArrow().to_pylist())) == sorted(str(dict(zip(cols, r))) for r in exp), name


def test_pipeline(spark, texts):
    """The stages' decisions by brute force: what is packed is exactly what no stage rejects."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secrets", "packing"] and "pipeline" in E.queries()
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_cascade.assess(docs).collect() if r.kept}
    comp = joined({i: t for i, t in texts.items() if i in good})
    one = {i for i in good if comp[i][1] == i}
    bench = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(t)) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    grams = {tuple(w[i:i + 12]) for w in bench for i in range(len(w) - 11)}
    clean = set()
    for i in one:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower(texts[i]))
        if not any(tuple(w[k:k + 12]) in grams for k in range(len(w) - 11)):
            clean.add(i)
    assert {r.doc_id for r in out} == clean and len(clean) > 50
