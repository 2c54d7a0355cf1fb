"""Licence templates: base columns against plain search on the whole table, acceptance against every way
of filling the markup, and whole texts, altered texts, notices and denials."""
import itertools
import random
import re

import pytest

from labelforge.llm import licenses as L
from labelforge.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scan(spark, *texts, **kw):
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), **kw).collect()
    return [r for r in sorted(rows, key=lambda r: r.doc_id)]


def test_base_columns_equal_plain_search(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in REGISTRY["op10_license_templates"][0](spark, SF).collect():
        w = WORD.findall(L.lower(texts[r.doc_id] or ""))
        at, labels = [], set()
        for phrase, label in L.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and (r.score > 0) == bool(r.labels)


def fillings(text, alphabet):
    """All word sequences a template accepts, replaceable words taken from ``alphabet``."""
    tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\w+", text)

    def parse(i):
        out = [()]
        while i < len(tokens) and tokens[i] != "]]":
            t = tokens[i]
            if t == "[[":
                inner, i = parse(i + 1)
                out = [a + b for a in out for b in [(), *inner]]
            elif t.startswith("{{"):
                some = [f for n in range(int(t[2:-2]) + 1) for f in itertools.product(alphabet, repeat=n)]
                out = [a + b for a in out for b in some]
            else:
                out = [(*a, t) for a in out]
            i += 1
        return out, i
    return {" ".join(x) for x in parse(0)[0]}


@pytest.mark.parametrize("text", ["a b [[c [[d]]]] {{2}} e", "a b {{1}} [[b]] a", "a b [[{{1}} c]] [[c]]", "b a a [[a]] [[a b]]"])
def test_acceptance_equals_every_filling(text):
    auto, ok = L.compile_template("x", text), fillings(text, "abcde")
    for n in range(2, 7):
        for words in itertools.product("abcde", repeat=n) if n < 5 else [tuple(random.Random(k).choices("abcde", k=n)) for k in range(3000)]:
            want = max((m for m in range(2, n + 1) if " ".join(words[:m]) in ok), default=-1)
            assert auto.accepts(words.__getitem__, 0, n) == want


def test_whole_texts_score_one_and_altered_ones_do_not(spark):
    whole = [t for t in L.catalogue() if t.score == L.TEXT]
    fill = [re.sub(r"\[\[[^\[\]]*\]\]", "", re.sub(r"\{\{(\d+)\}\}", lambda m: "holders " * int(m[1]), t.wording)) for t in whole]
    got = scan(spark, *[f"Copyright (c) somebody.\n\n{x}\nbehind it" for x in fill])
    assert len(whole) >= 10
    for t, r in zip(whole, got):
        assert t.label in r.labels.split(",") and r.score == 1.0
    # one mandatory word changed, and the last words cut off
    changed = [re.sub(r"(?i)\b(software|program|library|license|file)\b", "thing", x) for x in fill]
    cut = [" ".join(x.split()[:-6]) for x in fill]
    for t, r in zip(whole * 2, scan(spark, *changed, *cut)):
        assert t.label not in r.labels.split(",") and r.score < 1.0


def test_notices_mentions_and_denials(spark):
    got = scan(spark, "Released under the MIT License.", "We are not released under the MIT license at all", "it isn't licensed under CC BY-SA 4.0", "about the mit license",
               "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, but only on Sundays.",
               "nothing", "Licensed under CC BY-NC 4.0", None, "not so. But some words later it is released under the MIT license")
    assert [(r.labels, r.score) for r in got] == [("mit,mit-notice", 0.8), ("mit", 0.5), ("cc-by", 0.5), ("mit", 0.5), ("", 0.0), ("", 0.0),
                                                  ("cc-by,cc-by-notice", 0.8), ("", 0.0), ("mit,mit-notice", 0.8)]


def test_a_caller_brings_own_templates(spark, tmp_path):
    f = tmp_path / "own.txt"
    f.write_text("# ours\n== house text\nThis text may be {{2}} freely [[and gladly]].\n== house-line notice\nhouse licence {{1}} applies\n")
    got = scan(spark, "this text may be shared very freely and gladly", "House licence 2 applies", "all rights reserved", templates=L.catalogue(f))
    assert [(r.labels, r.score) for r in got] == [("house", 1.0), ("house-line", 0.8), ("", 0.0)]
    f.write_text("== broken\nno kind\n")
    with pytest.raises(ValueError, match="no label and kind"):
        L.catalogue(f)
