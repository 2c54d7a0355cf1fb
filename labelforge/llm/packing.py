"""Sequence packing by shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most ``size`` ids. The histogram of piece lengths
has ``size`` bins at most, so it fits anywhere; ``plan`` places the lengths on it, longest first:
all pieces of a length go into the open packs with the least filling that still have room for
them (the shortest packs first), and packs of equal content are one pattern with a count. No step
looks at a single document. A pattern's copies then claim the pieces of each length by rank, and
``pack`` joins them back: piece r of a length belongs to the pattern interval that holds r.

Ranks come without a global sort: pieces of one length are dealt to cells of a bounded number of
rows, the cells' counts give their offsets, and a window numbers the rows within a cell. So one
length that a third of all pieces share is spread over many tasks.

Edge cases: a null or empty text is one piece that holds the end id alone; a document longer than
``size`` is cut, each id in exactly one piece; equal lengths are ranked by document and start;
repeated rows are packed each; an empty table gives an empty result; clashing extra columns are
not read.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.store import materialize

SIZE = 2048
END_ID = 1
CELL_ROWS = 256          # rows of one length that are ranked together, at small sizes
MAX_CELLS = 1 << 20      # cells in all, at large sizes: they grow in rows, not in number
SPECIAL = {"<|endoftext|>": 50256}  # fixed value: the added token of the vocabulary's JSON form
CACHE_CHUNKS = 400_000   # cached word → ids entries of one Python worker; cleared when full

PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"


# ------------------------------------------------------------------ tokens
class Encoder:
    """Ids of a byte-level BPE file as little-endian uint32 bytes, equal to encoding the whole text. The
    strings of SPECIAL are one id each wherever they stand, and the text is cut there first.
    The vocabulary's pattern starts a new word at every single space that stands between two other
    characters, so such a text is the concatenation of its space-separated chunks and each distinct
    chunk is encoded once. A text with two white spaces in a row is encoded whole."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.cache = enc.encode_ordinary, {}
        self.twice = re.compile(r"\s\s").search
        self.special = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")").split
        self.marks = {k: np.asarray([v], "<u4").tobytes() for k, v in SPECIAL.items()}

    def raw(self, text: str) -> bytes:
        return np.asarray(self.encode(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(k in text for k in self.marks):
            return b"".join(self.marks.get(part) or self.ids(part) for part in self.special(text))
        if self.twice(text):
            return self.raw(text)
        head, *rest = text.split(" ")
        cache = self.cache
        for c in set(rest).difference(cache):
            cache[c] = self.raw(" " + c)
        out = self.raw(head) + b"".join(map(cache.__getitem__, rest)) if head else b"".join(map(cache.__getitem__, rest))
        if len(cache) > CACHE_CHUNKS:
            cache.clear()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end_id: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    end = np.asarray([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows: list[tuple] = []
        held = 0
        for i in range(len(batch)):
            raw = enc.ids(texts[i].as_py() or "") + end
            n, doc = len(raw) // 4, ids[i].as_py()
            rows += [(doc, s, min(size, n - s), n, raw[4 * s:4 * (s + size)]) for s in range(0, n, size)]
            held += len(raw)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def tokenize(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text",
             size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens and its ids (little-endian uint32)."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda batches: _pieces(batches, ranks_path, size, end_id), PIECE)


# ------------------------------------------------------------------ the plan, on the histogram
def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of a pack, in the order placed) and how many packs have each. Longest
    lengths first; each goes to the open packs with the least filling that have room for it, and
    what is left opens packs that hold as many of that length as fit."""
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(size + 1)]
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        todo, room = counts[length], size
        while todo:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                break
            lengths, n = by_room[room].pop()
            took = min(n, todo)
            if took < n:
                by_room[room].append((lengths, n - took))
            by_room[room - length].append((lengths + (length,), took))
            todo -= took
        each = size // length
        for copies, packs in ((each, todo // each), (todo % each, 1)):
            if copies and packs:
                by_room[size - copies * length].append(((length,) * copies, packs))
    return [p for packs in by_room for p in packs]


def claims(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Arrays sorted by (length, first): pieces of ``length`` with ranks from ``first`` on go to
    the sequences from ``sequence`` on, at ``offset``."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + n
            offset += x
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"key": cols[0] * _RANKS + cols[1], "first": cols[1], "sequence": cols[2], "offset": cols[3]}


_RANKS = 1 << 48  # more pieces of one length than any table has


def _claimed(batches: Iterator[pa.RecordBatch], c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
        at = np.searchsorted(c["key"], length * _RANKS + rank, "right") - 1
        kept = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index(n)) for n in kept]
            + [pa.array(c["sequence"][at] + rank - c["first"][at]), pa.array(c["offset"][at])],
            names=[*kept, "sequence_id", "offset"])


def pack(pieces: DataFrame, size: int = SIZE, cell_rows: int = CELL_ROWS, max_cells: int = MAX_CELLS) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, start and length (other columns ride
    along): every sequence holds at most ``size`` ids, gapless from offset 0."""
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    placed = claims(plan(counts, size))
    per_cell = max(cell_rows, sum(counts.values()) // max_cells)
    cells = ",".join(str(max(1, -(-counts.get(n, 0) // per_cell))) for n in range(1, size + 1))
    of = F.element_at(F.split(F.lit(cells), ",").cast("array<bigint>"), F.col("length").cast("int"))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("doc_id", "start"), of))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialize(dealt.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
                          .select("length", "cell", F.coalesce(before, F.lit(0)).alias("before")), "cell-offsets")
    within = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "start"))
    ranked = (dealt.join(offsets, ["length", "cell"])
              .select(*pieces.columns, (F.col("before") + within - 1).cast("long").alias("rank")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(lambda batches: _claimed(batches, placed), f"{fields}, sequence_id bigint, offset bigint")
