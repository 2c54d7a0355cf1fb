"""Substring de-duplication by sliding sentence spans.

A text is cut into sentences (after ., ! or ? and the white space behind them, and at line breaks).
A run has at least ``min_sentences`` sentences and ``min_words`` words together. Two are hashed per
sentence: the shortest one that starts there and the shortest one that ends there. What they hold
depends on their sentences alone, so a repeated passage gives the same ones wherever it stands, and
they cover each of its sentences: if neither the rest of the passage from a sentence on nor its part
up to there is long enough, the shortest run from the passage's start reaches over it. So all runs of
any length are found, as if each were compared. A single sentence of ``min_words`` words is a run too,
and so is a whole text of that many words that has fewer sentences than a run.

Runs are hashed (64 bits, of the words lower-cased) and joined globally. Rows are judged, not ids: every
row has a key of its own (``row_keys``), and rows are ordered by doc_id (null last), then key. The
first place of a run is that in the first row that holds it, and the first one there. All sentences
that any other place of a run covers are removed.

The global step sees one slim row per run, at most three a sentence. A run that many documents share is one aggregate of the
smallest and the largest id, combined before the shuffle, and the join that finds the later places
lets Spark split a hot run.

Edge cases: null and empty texts have no sentences; texts are read whole; a repeat within one
document counts as well; rows with equal doc_id and text are one row and don't remove each other; different
texts under one doc_id, and rows without doc_id, are judged like all others; a row that loses nothing
keeps its text byte for byte; an empty table gives an empty result; other columns are not read.
doc_id is an integer column (or one whose values cast to long).
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.row_keys import row_keys
from labelforge.llm.store import materialize

MIN_SENTENCES = 2
MIN_WORDS = 30

_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?![\s])[^.!?\n]*)*(?:[.!?]+\s+|[.!?]*\n\s*|[.!?]*\Z)")


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised words, number of words) of each sentence that has a word; the ranges
    take in the white space behind."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = m.group().lower().split()
        if words:
            out.append((m.start(), m.end(), " ".join(words).encode(), len(words)))
    return out


def runs(sents: list[tuple[int, int, bytes, int]], min_sentences: int, min_words: int) -> list[tuple[int, int, int]]:
    """(hash, first sentence, one past the last), by place, of the shortest runs that start and that
    end at each sentence, of long single sentences, and of a whole text with too few sentences."""
    n = len(sents)
    words, at = [0], [0]  # sums up to each sentence, and where it starts in all of them joined
    for s in sents:
        words.append(words[-1] + s[3])
        at.append(at[-1] + len(s[2]) + 1)
    places = {(i, i + 1) for i in range(n) if sents[i][3] >= min_words}
    if 0 < n < min_sentences and words[n] >= min_words:
        places.add((0, n))
    j = 0
    for i in range(n):  # the shortest one from i on
        while j <= n and (j - i < min_sentences or words[j] - words[i] < min_words):
            j += 1
        if j > n:
            break
        places.add((i, j))
    i = n
    for j in range(n, 0, -1):  # the shortest one up to j
        while i >= 0 and (j - i < min_sentences or words[j] - words[i] < min_words):
            i -= 1
        if i < 0:
            break
        places.add((i, j))
    joined, out = b"\n".join(s[2] for s in sents), []
    for i, j in sorted(places):
        h = xxhash.xxh3_64_intdigest(joined[at[i]:at[j] - 1])
        out.append((h - (1 << 64) if h >> 63 else h, i, j))
    return out


def _run_rows(batches: Iterator[pa.RecordBatch], min_sentences: int, min_words: int) -> Iterator[pa.RecordBatch]:
    """(hash, key, doc_id, sentence, stop, later): later if the row holds the run further up too."""
    for batch in batches:
        keys, ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        h, y, d, s, e, z = [], [], [], [], [], []
        for key, doc, t in zip(keys, ids, texts):
            seen = set()
            for x, i, j in runs(sentences(t.as_py() or ""), min_sentences, min_words):
                h.append(x)
                y.append(key)
                d.append(doc)
                s.append(i)
                e.append(j)
                z.append(x in seen)
                seen.add(x)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(y, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(z, pa.bool_())],
                                         names=["hash", "key", "doc_id", "sentence", "stop", "later"])


OUT = "n_sentences bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = []
        for key, doc, text, places, first in zip(*[batch.column(i).to_pylist() for i in range(5)]):
            sents = sentences(text)
            gone = sorted({k for p in places for k in range(p["sentence"], p["stop"])})
            cuts: list[list[int]] = []
            for k in gone:
                if cuts and cuts[-1][1] == sents[k][0]:
                    cuts[-1][1] = sents[k][1]
                else:
                    cuts.append([sents[k][0], sents[k][1]])
            at, kept = 0, []
            for a, b in cuts:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((key, doc, len(sents), len(gone), [{"start": a, "end": b} for a, b in cuts], "".join(kept), sorted(first)))
        cols = list(zip(*rows)) or [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "doc_id", "n_sentences", "n_removed", "removed", "text", "first_doc_ids"])


ID_STEP = 10**19  # doc_id * ID_STEP + key / 2 orders rows by (doc_id, key); 38 digits hold both. Whole keys span 2 ** 64, more than a step


def _order(doc_id: Column, key: Column) -> Column:
    """A row's place among all rows, as one fixed-size number: by doc_id, null last, then key."""
    wide = "decimal(38,0)"
    ident = F.coalesce(doc_id.cast("decimal(19,0)"), F.lit(Decimal(93 * 10**17)))
    return ((ident * F.lit(Decimal(ID_STEP))).cast(wide) + F.shiftright(key, 1).cast("decimal(19,0)")).cast(wide)


def _repeats(docs: DataFrame, doc_id: str, text: str, min_sentences: int, min_words: int) -> tuple[Column, DataFrame]:
    """The key of a row of ``docs`` and, for the keys that lose a sentence, what is cut."""
    key, _ = row_keys(docs, doc_id, text)
    slim = docs.select(key.alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(slim.mapInArrow(lambda bs: _run_rows(bs, min_sentences, min_words), "hash bigint, key bigint, doc_id bigint, sentence int, stop int, later boolean"), "sentence-runs")
    at = _order(F.col("doc_id"), F.col("key"))
    shared = (rows.groupBy("hash").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.max(F.col("later").cast("int")).alias("twice"),
                                       F.min("doc_id").alias("first_id"))
              .where("first < last or twice = 1").select("hash", "first", "first_id"))
    places = rows.join(materialize(shared, "shared-runs"), "hash").where((at > F.col("first")) | F.col("later"))
    per_row = places.groupBy("key").agg(F.collect_set(F.struct("sentence", "stop")).alias("places"), F.collect_set("first_id").alias("firsts"))
    per_row = materialize(per_row, "repeats")
    hit = slim.join(per_row, "key").select("key", "doc_id", "text", "places", "firsts")
    return key, hit.mapInArrow(_cut, f"key bigint, doc_id bigint, {OUT}, first_doc_ids array<bigint>")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES,
                   min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row that loses a sentence: doc_id, n_sentences, n_removed, removed (code
    point ranges), the text that stays, and the documents that hold the first places."""
    return _repeats(docs, doc_id, text, min_sentences, min_words)[1].drop("key")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_sentences: int = MIN_SENTENCES,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, the repeated sentences cut out of the texts."""
    key, cut = _repeats(docs, doc_id, text, min_sentences, min_words)
    cut = materialize(cut.select(F.col("key").alias("__key"), F.col("text").alias("__text")).dropDuplicates(["__key"]), "cut-texts")
    both = docs.join(cut, key == F.col("__key"), "left")
    return both.select(*[(F.coalesce("__text", docs[text]) if c == text else docs[f"`{c}`"]).alias(c) for c in docs.columns])
