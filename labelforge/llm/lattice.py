"""Language-model scores from a subword lattice.

An existing subword vocabulary gives the pieces; a piece starts with a space only where a word
does. A word's lattice holds every way to cut " word" into pieces, single bytes included, so every
word has a path. A log-space forward recursion over the lattice adds up the probabilities of all
segmentations. As no piece reaches across a word's start, a document's marginal probability is the
product of its words' and of its end, and each distinct word is worked out once per batch.

Weights start from the vocabulary's own ranking (1 / (rank + 2)) and are re-estimated on the
training words by expectation maximisation (forward-backward, ``ROUNDS`` rounds): each round maps
over the distinct words with their counts and sums at most one row per piece and task. The base
score next to it is an additively smoothed word model. Its counts reach the documents two ways: of
the words that make up at least 1/``FREQUENT`` of all tokens there can be at most ``FREQUENT``, so
these go to every task; all others are joined.

Edge cases: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a null or empty text has the end
alone; texts and words of any length are read whole; a null doc_id is trained on and scored;
repeated rows count and are scored each; without training rows all counts are 0; other columns
are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm import tokens as T
from labelforge.llm.store import materialize

ROUNDS = 2
FREQUENT = 1_000_000
SHORT = 48              # bytes of a word, with its space, that the vectorised recursion takes
WINDOW = 2_000_000      # words handled together in a task
CACHE_WORDS = 600_000   # words whose score a Python worker keeps
SMOOTH = 0.5


# ------------------------------------------------------------------ vocabulary
def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes (the word-start mark as a space) and their first log weights. All 256 single
    bytes are pieces; pieces with a space inside or with capitals never match and are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    rank: dict[bytes, float] = {}
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i) or m.is_byte(i):
            continue
        p = m.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in p[1:] and p == p.lower():
            rank.setdefault(p, -m.get_score(i))
    last = max(rank.values(), default=0.0)
    for b in range(256):
        rank.setdefault(bytes([b]), last)
    pieces = sorted(rank)
    w = -np.log(np.array([rank[p] for p in pieces]) + 2)
    return pieces, w - np.log(np.exp(w).sum())


class Lattice:
    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp, self.where = logp, {p: i for i, p in enumerate(pieces)}
        h = T.hash_of(pieces)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[h & np.uint64((1 << 20) - 1)] = True
        self.longest = max(map(len, pieces))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.seen[h & np.uint64((1 << 20) - 1)])
        at = np.searchsorted(self.keys, h[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == h[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out

    def _arcs(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """(from, to) → piece index of each word or -1, where any word has a piece."""
        n = words.shape[1]
        up, down = T._powers(n + 1)
        total = np.zeros((len(words), n + 1), np.uint64)
        np.cumsum(T._BYTE[words] * up[:n], axis=1, out=total[:, 1:])
        out = {}
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                k = self.find(T.mix(((total[:, j] - total[:, i]) * down[i]) ^ np.uint64(j - i)))
                if (k >= 0).any():
                    out[i, j] = k
        return out

    def _weights(self, arcs):
        lp = np.r_[self.logp, -np.inf]
        return {ij: lp[k] for ij, k in arcs.items()}

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        x = np.stack(terms)
        top = x.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(x - safe).sum(axis=0)) + safe

    def forward(self, n: int, w: dict) -> list[np.ndarray]:
        a = [np.zeros_like(next(iter(w.values())))]
        for j in range(1, n + 1):
            a.append(self._sum([a[i] + w[i, j] for i in range(max(0, j - self.longest), j) if (i, j) in w]))
        return a

    def _groups(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(indexes, byte matrix) of words of one length, space first, in bounded pieces; the long
        ones as (index, bytes)."""
        n = end - start + 1
        for size in np.unique(n[n <= SHORT]).tolist():
            all_of = np.flatnonzero(n == size)
            step = max(256, (4 << 20) // (size * size))
            for k in range(0, len(all_of), step):
                at = all_of[k:k + step]
                m = np.full((len(at), size), 0x20, np.uint8)
                m[:, 1:] = data[start[at][:, None] + np.arange(size - 1)]
                yield at, m
        for i in np.flatnonzero(n > SHORT).tolist():
            yield i, b" " + data[start[i]:end[i]].tobytes()

    def _long_arcs(self, word: bytes):
        return [[(i, self.where[word[i:j]]) for i in range(max(0, j - self.longest), j) if word[i:j] in self.where] for j in range(1, len(word) + 1)]

    def _long_forward(self, arcs) -> list[float]:
        a = [0.0]
        for into in arcs:
            t = [a[i] + self.logp[k] for i, k in into]
            top = max(t)
            a.append(top + math.log(sum(math.exp(x - top) for x in t)))
        return a

    def score(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log marginal probability of each word."""
        out = np.empty(len(start))
        for at, m in self._groups(data, start, end):
            if isinstance(m, bytes):
                out[at] = self._long_forward(self._long_arcs(m))[-1]
            else:
                out[at] = self.forward(m.shape[1], self._weights(self._arcs(m)))[-1]
        return out

    def expect(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over all segmentations of the words, times their counts."""
        out = np.zeros(len(self.logp) + 1)
        for at, m in self._groups(data, start, end):
            if isinstance(m, bytes):
                arcs = self._long_arcs(m)
                a = self._long_forward(arcs)
                b = [-math.inf] * len(arcs) + [0.0]
                for j in range(len(arcs), 0, -1):
                    for i, k in arcs[j - 1]:
                        b[i] = float(np.logaddexp(b[i], b[j] + self.logp[k]))
                        out[k] += count[at] * math.exp(a[i] + self.logp[k] + b[j] - a[-1])
                continue
            n, arcs = m.shape[1], self._arcs(m)
            w = self._weights(arcs)
            a = self.forward(n, w)
            b = [None] * n + [np.zeros(len(m))]
            for i in range(n - 1, -1, -1):
                b[i] = self._sum([w[i, j] + b[j] for j in range(i + 1, min(n, i + self.longest) + 1) if (i, j) in w]) \
                    if any((i, j) in w for j in range(i + 1, min(n, i + self.longest) + 1)) else np.full(len(m), -np.inf)
            for (i, j), k in arcs.items():
                out += np.bincount(k, np.exp(a[i] + w[i, j] + b[j] - a[n]) * count[at], len(out)) if (k >= 0).all() \
                    else np.bincount(np.where(k < 0, len(self.logp), k), np.where(k < 0, 0.0, np.exp(a[i] + w[i, j] + b[j] - a[n])) * count[at], len(out))
        return out[:-1]


# ------------------------------------------------------------------ words of a task
class _Window:
    """Words of several chunks: hashes, their bytes, and the rows' bounds."""

    def __init__(self):
        self.h, self.data, self.start, self.end, self.sizes, self.rows = [], [], [], [], [], []
        self.n = self.shift = 0

    def add(self, w: T.Words, row) -> None:
        self.h.append(w.hashes())
        self.data.append(w.data)
        self.start.append(w.start + self.shift)
        self.end.append(w.end + self.shift)
        self.sizes.append(np.diff(w.bounds))
        self.rows.append(row)
        self.n += len(w)
        self.shift += len(w.data)

    def all(self):
        return tuple(np.concatenate(x) for x in (self.h, self.data, self.start, self.end, self.sizes))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[_Window]:
    win = _Window()
    for batch in batches:
        for a, b, data, off in T.text_chunks(batch, "text"):
            win.add(T.Words(data, off, T.SPACE_WORDS), batch.slice(a, b - a).drop_columns(["text"]))
            if win.n >= WINDOW:
                yield win
                win = _Window()
    if win.rows:
        yield win


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    off = np.r_[0, np.cumsum(size)]
    flat = data[np.repeat(start - off[:-1], size) + np.arange(off[-1])]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(flat)])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for win in _windows(batches):
        h, data, start, end, _ = win.all()
        _, at, n = np.unique(h, return_index=True, return_counts=True)
        for k in range(0, len(at), 200_000):
            i = at[k:k + 200_000]
            yield pa.RecordBatch.from_arrays([_gather(data, start[i], end[i]), pa.array(n[k:k + 200_000])], names=["word", "n"])


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(col.buffers()[2], np.uint8), off[:-1], off[1:]


def _expected(batches: Iterator[pa.RecordBatch], pieces: list[bytes], logp: np.ndarray) -> Iterator[pa.RecordBatch]:
    lat, total = Lattice(pieces, logp), np.zeros(len(pieces))
    for batch in batches:
        if len(batch):
            total += lat.expect(*_bytes_of(batch.column(0)), batch.column(1).to_numpy().astype(float))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])


_SCORES: dict = {}


def _scored(batches: Iterator[pa.RecordBatch], pieces: list[bytes], logp: np.ndarray, freq_h: np.ndarray, freq_n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per row: word count, known frequent words, Σ log10(c + 0.5) over them, the words' log
    probability, and the hashes of the words that aren't frequent."""
    lat = Lattice(pieces, logp)
    known_h, known_s = np.empty(0, np.uint64), np.empty(0)
    for win in _windows(batches):
        h, data, start, end, sizes = win.all()
        u, at, inv = np.unique(h, return_index=True, return_inverse=True)
        k = np.searchsorted(known_h, u)
        k[k == len(known_h)] = 0
        hit = known_h[k] == u if len(known_h) else np.zeros(len(u), bool)
        s = np.empty(len(u))
        s[hit] = known_s[k[hit]]
        new = np.flatnonzero(~hit)
        s[new] = lat.score(data, start[at[new]], end[at[new]])
        if len(known_h) + len(new) > CACHE_WORDS:
            known_h, known_s = u, s
        else:
            known_h, known_s = np.r_[known_h, u[new]], np.r_[known_s, s[new]]
            o = np.argsort(known_h)
            known_h, known_s = known_h[o], known_s[o]
        f = np.searchsorted(freq_h, u)
        f[f == len(freq_h)] = 0
        c = np.where(freq_h[f] == u, freq_n[f], 0) if len(freq_h) else np.zeros(len(u), np.int64)
        rare = (c == 0)[inv]
        term = np.where(c > 0, np.log10(c + 0.5), 0.0)[inv]
        first = np.r_[0, np.cumsum(sizes)]
        some = np.flatnonzero(sizes)

        def per_row(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(sizes), x.dtype)
            if len(some):
                out[some] = np.add.reduceat(x, first[some])
            return out

        n_rare = per_row(rare.astype(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_rare)], pa.int32()), pa.array(h[rare].view(np.int64)))
        rows = pa.Table.from_batches(win.rows).combine_chunks()
        cols = {n: rows[n].combine_chunks() for n in rows.column_names}
        out = pa.table({**cols, "n_words": pa.array(sizes.astype(np.int64)), "n_frequent": pa.array(sizes - n_rare),
                        "frequent_sum": pa.array(per_row(term)), "log_p": pa.array(per_row(s[inv])), "rare": lists})
        yield from out.to_batches()


# ------------------------------------------------------------------ the operator
def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id's text falls in the held-out fold; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def train(texts: DataFrame, pieces: list[bytes], logp: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, float, dict]:
    """``texts``: one column. Word counts (word, n), the pieces' log probabilities, the end's, and
    totals: docs, words, distinct."""
    words = materialize(texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    row = words.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    total = {"docs": texts.count(), "words": row["words"], "distinct": row["distinct"]}
    end = 0.0
    for _ in range(rounds):
        part = words.mapInArrow(lambda bs, lp=logp: _expected(bs, pieces, lp), "piece int, n double")
        soft = np.zeros(len(pieces))
        for r in part.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most one row per piece
            soft[r["piece"]] = r["n"]
        whole = soft.sum() + total["docs"] + SMOOTH * (len(pieces) + 1)
        logp, end = np.log((soft + SMOOTH) / whole), math.log((total["docs"] + SMOOTH) / whole)
    return words, logp, end, total


def word_hash(words: DataFrame) -> DataFrame:
    """(hash, n) of a (word, n) table, with the hash the scoring pass uses."""
    def hashed(batches):
        for b in batches:
            if len(b):
                data, start, end = _bytes_of(b.column(0))
                w = T.Words(data[start[0]:end[-1]], np.r_[start, end[-1]] - start[0], np.ones(256, bool), lower=False)
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes().view(np.int64)), b.column(1)], names=["h", "n"])
    return words.mapInArrow(hashed, "h bigint, n bigint")


def score(docs: DataFrame, pieces_path: str, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns
    from the rows that aren't held out and scores all."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    pieces, first = load_pieces(pieces_path)
    words, logp, end, total = train(slim.where(~F.col("held_out")).select("text"), pieces, first, rounds)
    hashed = materialize(word_hash(words), "word-hashes")
    n = total["words"] + total["docs"]
    v = total["distinct"] + (total["docs"] > 0)
    least = max(1, -(-n // FREQUENT))
    top = hashed.where(F.col("n") >= least) if n else hashed.limit(0)  # at most FREQUENT words reach it
    if total["distinct"]:
        freq = top.toArrow().sort_by("h") if hasattr(top, "toArrow") else pa.Table.from_pandas(top.toPandas()).sort_by("h")
        fh, fn = freq["h"].to_numpy().view(np.uint64), freq["n"].to_numpy()
        o = np.argsort(fh)
        fh, fn = fh[o], fn[o]
    else:
        fh, fn = np.empty(0, np.uint64), np.empty(0, np.int64)
    bc = docs.sparkSession.sparkContext.broadcast((pieces, logp, fh, fn))
    rows = materialize(slim.mapInArrow(lambda bs: _scored(bs, *bc.value), "doc_id " + slim.schema["doc_id"].dataType.simpleString()
                                       + ", held_out boolean, n_words bigint, n_frequent bigint, frequent_sum double, log_p double, rare array<bigint>")
                       .withColumn("row", F.monotonically_increasing_id()), "scored")
    asked = rows.select("row", F.explode("rare").alias("h"))
    got = (asked.join(hashed.where(F.col("n") < least), "h", "left").groupBy("row")
           .agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("s"), F.count("n").alias("k")))
    whole = math.log10(n + 0.5 * (v + 1))
    n_tokens = F.col("n_words") + 1
    out = rows.drop("rare").join(got, "row", "left")
    return out.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"),
        (F.col("n_frequent") + F.coalesce("k", F.lit(0)) + F.lit(int(total["docs"] > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("frequent_sum") + F.coalesce("s", F.lit(0.0)) + F.lit(math.log10(total["docs"] + 0.5)) - n_tokens * F.lit(whole)).alias("base_score"),
        ((F.col("log_p") + F.lit(end)) / F.lit(math.log(10))).alias("score"))
