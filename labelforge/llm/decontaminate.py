"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; only the positions the mask cares for are hashed, so
a substituted word under an ignored position leaves the hash unchanged. All seeds of the benchmark
items are hashed; a Bloom filter of them (bounded size) goes to the tasks and lets through the few
document positions that may match. Those are joined with the test hashes exactly, and every hit is
verified on the words themselves: item and document are laid over each other along the hit, and
the best stretch (a match counts +1, a substitution -2) must hold at least ``min_matches`` equal
words, or four fifths of a shorter item.

Only document positions that pass the filter leave the scan, with the words around them; hits of
one passage travel together, so a hot passage costs one row per document that has it.

Edge cases: words are runs of letters and digits, A-Z lower-cased; null or empty texts and items
shorter than the shortest seed match nothing; texts are read whole; repeated documents are each
reported (repeated rows of one doc_id once); a document without an id can't be named and is not
reported; empty tables give an empty result; other columns are not read. ``drop_contaminated`` goes
by row instead: each text is checked, whatever its doc_id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm import tokens as T
from labelforge.llm.row_keys import row_keys
from labelforge.llm.store import materialize

# Masks as the offsets they look at: six words each, spans of 6 to 10.
SEEDS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 5, 6), (0, 1, 3, 4, 7, 8), (0, 2, 4, 5, 7, 9))
SPAN = max(max(s) for s in SEEDS) + 1
REACH = 128            # words kept on either side of a group of hits, within the document
MIN_MATCHES = 12
BITS_PER_SEED = 64
PROBES = 4
MAX_FILTER_BITS = 1 << 27   # 16 MB: beyond it the filter lets more through, the join stays exact


def _bits(h: np.ndarray, n_bits: int, probe: int) -> np.ndarray:
    """The probe-th bit of each hash in the filter."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(probe) * step) & np.uint64(n_bits - 1)).astype(np.int64)


def _filter(batches: Iterator[pa.RecordBatch], n_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_bits(h, n_bits, k) for k in range(PROBES)]))], names=["b"])


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, hash, at) of every seed, and the item's words once (hash null)."""
    for batch in batches:
        for a, b, data, off in T.text_chunks(batch, "text"):
            w = T.Words(data, off, T.ALNUM_WORDS)
            h, ids = w.hashes(), batch.column(0).slice(a, b - a)
            item, key, at, words = [], [], [], []
            for i in range(b - a):
                own, name = h[w.bounds[i]:w.bounds[i + 1]], ids[i].as_py()
                item.append(name)
                key.append(None)
                at.append(None)
                words.append(own.tobytes())
                for k, s in enumerate(SEEDS):
                    r = T.runs(own, s, k).view(np.int64).tolist()
                    item += [name] * len(r)
                    key += r
                    at += range(len(r))
                    words += [None] * len(r)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(words, pa.binary())],
                                             names=["item_id", "hash", "at", "words"])


def _passing(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per group of nearby positions that pass the filter: the words around them, and for
    each position its hash and its place in those words."""
    n_bits = len(table)
    names = ["doc_id", "start", "words", "hits"]
    kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))
    for batch in batches:
        for a, b, data, off in T.text_chunks(batch, "text"):
            w = T.Words(data, off, T.ALNUM_WORDS)
            h = w.hashes()
            owner = w.owner()
            pos, key = [], []
            for k, s in enumerate(SEEDS):
                r = T.runs(h, s, k)
                p = np.arange(len(r))
                for k2 in range(PROBES):
                    p = p[table[_bits(r[p], n_bits, k2)]]
                p = p[owner[p] == owner[p + s[-1]]]
                pos.append(p)
                key.append(r[p])
            pos, key = np.concatenate(pos), np.concatenate(key)
            if not len(pos):
                continue
            order = np.argsort(pos, kind="stable")
            pos, key = pos[order], key[order].view(np.int64)
            cut = np.flatnonzero((np.diff(pos) > REACH) | (owner[pos[1:]] != owner[pos[:-1]])) + 1
            ids = batch.column(0)
            rows = []
            for x, y in zip(np.r_[0, cut], np.r_[cut, len(pos)]):
                d = int(owner[pos[x]])
                lo, hi = int(w.bounds[d]), int(w.bounds[d + 1])
                first, last = max(lo, int(pos[x]) - REACH), min(hi, int(pos[y - 1]) + SPAN + REACH)
                rows.append((ids[a + d].as_py(), first - lo, h[first:last].tobytes(),
                             [{"hash": int(v), "at": int(p) - first} for p, v in zip(pos[x:y], key[x:y])]))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], kind)], names=names)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the stretch with the highest score: +1 a match, -2 a substitution."""
    total = np.r_[0, np.cumsum(np.where(equal, 1, -2))]
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[:end + 1] == low[end])[-1])
    return start, end, int(equal[start:end].sum())


def _verified(batches: Iterator[pa.RecordBatch], min_matches: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "doc_start", "item_start", "overlap", "matches"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            win, item = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
            for shift in r["shifts"]:  # place of the item's first word in the window
                lo, hi = max(0, -shift), min(len(item), len(win) - shift)
                s, e, m = best_stretch(win[lo + shift:hi + shift] == item[lo:hi])
                if m >= min(min_matches, -(-4 * len(item) // 5)):
                    rows.append((r["doc_id"], r["item_id"], r["start"] + lo + shift + s, lo + s, e - s, m))
        cols = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text", min_matches: int = MIN_MATCHES) -> DataFrame:
    """One row per (doc_id, item_id) that share a passage, the one with most equal words: where it
    starts in both (words from 0), its length, the equal words in it and their share."""
    found = _found(docs, benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where(F.col("item_id").isNotNull()), doc_id, text, min_matches)
    best = F.max(F.struct("matches", -F.col("doc_start"), -F.col("item_start"), "overlap")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.col2")).alias("doc_start"), (-F.col("b.col3")).alias("item_start"),
        F.col("b.overlap").alias("overlap"), F.col("b.matches").alias("matches"),
        (F.col("b.matches") / F.col("b.overlap")).alias("identity"))


def _found(docs: DataFrame, items: DataFrame, doc_id: str, text: str, min_matches: int) -> DataFrame:
    """All verified overlaps of ``docs`` with ``items`` (item_id, text), one row per line of hits."""
    seeds = materialize(items.mapInArrow(_item_rows, "item_id bigint, hash bigint, at int, words binary"), "benchmark-seeds")
    words = seeds.where(F.col("hash").isNull()).select("item_id", F.col("words").alias("item_words")).dropDuplicates(["item_id", "item_words"])
    keys = seeds.where(F.col("hash").isNotNull()).select("item_id", "hash", F.col("at").alias("item_at"))
    # the filter: at most MAX_FILTER_BITS bits, whatever the benchmark's size
    n = keys.count()
    n_bits = 1 << min(MAX_FILTER_BITS.bit_length() - 1, max(16, (n * BITS_PER_SEED).bit_length()))
    at = keys.select("hash").mapInArrow(lambda bs: _filter(bs, n_bits), "b bigint").distinct()
    table = np.zeros(n_bits, bool)
    for r in at.groupBy(F.expr("b div 4096").alias("w")).agg(F.collect_list("b").alias("bs")).toLocalIterator():
        table[r["bs"]] = True
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    packed = np.packbits(table)
    groups = materialize(slim.mapInArrow(lambda bs: _passing(bs, np.unpackbits(packed).astype(bool)),
                                         "doc_id bigint, start bigint, words binary, hits array<struct<hash:bigint,at:int>>")
                         .withColumn("gid", F.xxhash64("doc_id", "start", "words")), "benchmark-hits")
    hits = groups.select("gid", F.explode("hits").alias("h")).select("gid", F.col("h.hash").alias("hash"), F.col("h.at").alias("at"))
    lines = (hits.join(keys, "hash").groupBy("gid", "item_id")
             .agg(F.collect_set(F.col("at") - F.col("item_at")).alias("shifts")))  # at most one per place of a group
    both = lines.join(words, "item_id").join(groups.select("gid", "doc_id", "start", "words").dropDuplicates(["gid"]), "gid")
    return both.select("doc_id", "start", "words", "item_id", "item_words", "shifts").mapInArrow(
        lambda bs: _verified(bs, min_matches), "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, overlap bigint, matches bigint")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                      item_text: str = "text", min_matches: int = MIN_MATCHES) -> DataFrame:
    """The rows that share no passage with the benchmark, all columns untouched. Rows are judged each
    by its own text: rows without doc_id and different texts under one doc_id too. Items are told apart by
    their texts, so those without an id count as well."""
    key, _ = row_keys(docs, doc_id, text)
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.xxhash64(item_text).alias("item_id"), F.col(item_text).alias("text")).distinct()
    bad = _found(docs.select(key.alias("key"), F.col(text).alias("text")), items, "key", "text", min_matches)
    bad = materialize(bad.select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.withColumn("__key", key).join(bad, F.col("__key") == F.col("__bad"), "left_anti").drop("__key")
