"""Vocabulary, token ids and text vectors.

Texts are split into lower-case words (the word-level stand-in for sub-word pieces). Token
occurrences are pre-aggregated to (doc, token) counts before any join, so a hot token shared by
every document becomes one row per document, and the vector gather is an equi-join on token id.
Pooling is one ``groupBy(doc)`` with a sum per dimension: no per-row Python and no arrays
collected.

Where all texts of a table are pooled, they are folded in blocks of bounded size (``token_blocks``):
a block names each of its tokens once, and its documents list (place of the token, count). Vocabulary,
ids and vectors are then joined per token of a block, not per token of a document, and what meets
again are short integer lists by block, and one vector per id by run of blocks.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import WORD_SPLIT
from labelforge.functions.vectors import cosine, normalize
from labelforge.operators.hot_join import HOT_SHARE, salted_join
from labelforge.operators.position import key_position
from labelforge.session import written

SIF_A = 1e-3           # fixed value: SIF smoothing constant
IDF_EPSILON = 1e-12    # fixed values: IDF probability floor and clip range
IDF_CLIP_MIN = 1.0
IDF_CLIP_MAX = 15.0


def tokenize(df: DataFrame, id_col, text: str) -> DataFrame:
    """(id..., pos, token) for every non-blank lower-cased word, ``pos`` = word index in the text."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    return (df.select(*ids, F.posexplode(F.split(F.lower(F.col(text)), WORD_SPLIT))
                      .alias("pos", "token"))
            .filter(F.col("token") != ""))


def token_counts(tokens: DataFrame, id_col) -> DataFrame:
    """(id..., token, cnt): occurrences folded per document before any join."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    return tokens.groupBy(*ids, "token").agg(F.count(F.lit(1)).alias("cnt"))


BLOCK_TOKENS = 1 << 24   # words of a block, unless one text has more
BLOCK_DOCS = 1 << 15     # texts of a block
BLOCK_NAMES = 1 << 21    # distinct words of a block, counted per piece, unless one piece has more
PIECE_TOKENS = 1 << 21   # words folded at a time, unless one text has more
NAMES_ROW = 1 << 16      # distinct words in a row of the result
GATHER_DOCS = 1 << 11    # documents of a block summed at a time
GATHER_ROWS = 1 << 15    # (document, token) entries multiplied at a time
GATHER_WAVES = 2         # runs of blocks a core, each summed by one task
HELD_VECTORS = 1 << 20   # vectors that such a task holds, unless one block needs more
PACK_ROWS = 1 << 17      # (place, vector id) entries packed at a time


def _fold_piece(ids: pa.Array, words: pa.ListArray) -> tuple:
    """(ids of the texts with words, where their entries begin and end, places, counts, distinct tokens in order, totals)"""
    length = words.value_lengths().fill_null(0).to_numpy()
    coded = words.flatten().dictionary_encode()
    tokens, order = coded.dictionary, pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)  # places follow the order of the tokens
    rank[order] = np.arange(len(order))
    doc = np.repeat(np.arange(len(ids)), length)
    key, count = np.unique(doc * max(1, len(order)) + rank[coded.indices.to_numpy()], return_counts=True)
    doc, place = np.divmod(key, max(1, len(order)))
    tokens = tokens.take(pa.array(order)).cast(pa.string())
    if len(tokens) and tokens[0].as_py() == "":  # only the ends of a split text can be blank
        doc, place, count, tokens = doc[place > 0], place[place > 0] - 1, count[place > 0], tokens.slice(1)
    has, first = np.unique(doc, return_index=True)
    total = np.bincount(place, count, len(tokens)).astype(np.int64)
    return ids.take(pa.array(has)), np.r_[first, len(doc)].astype(np.int32), place.astype(np.int32), count.astype(np.int32), tokens, total


def _block_rows(number: int, pieces: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    coded = pa.concat_arrays([x[4] for x in pieces]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    tokens, at, code = coded.dictionary.take(pa.array(order)), 0, coded.indices.to_numpy()
    total = np.zeros(len(order), np.int64)
    for ids, cut, place, count, own, own_total in pieces:
        mine = rank[code[at:at + len(own)]]  # ascends, as the piece's own places do
        at += len(own)
        total[mine] += own_total
        n, cut = len(ids), pa.array(cut)
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (mine[place], count)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), ids, *lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
    for lo in range(0, len(tokens), NAMES_ROW):
        part, sums = tokens.slice(lo, NAMES_ROW), pa.array(total[lo:lo + NAMES_ROW])
        whole = pa.array([0, len(part)], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pieces[0][0].type), *[pa.nulls(1, pa.list_(pa.int32()))] * 2, pa.array([lo], pa.int32()),
                                          pa.ListArray.from_arrays(whole, part), pa.ListArray.from_arrays(whole, sums)], names=names)


def token_blocks(df: DataFrame, id_col: str, text: str, words: int = BLOCK_TOKENS, texts: int = BLOCK_DOCS) -> DataFrame:
    """The words of every row of ``df`` (``tokenize``), counted per row and in blocks of rows: a row (block, id,
    places, counts) per text with words, and rows (block, start, tokens, totals) per block with its distinct
    tokens in order, from place ``start`` on, which the places refer to. A block goes on from one Arrow batch
    to the next, up to ``words`` words or ``texts`` texts: the larger it is, the fewer times a token is named.
    Written once; rows that share an id stay apart."""
    kind = df.schema[id_col].dataType.simpleString()
    split = df.select(F.col(id_col), F.split(F.lower(F.col(text)), WORD_SPLIT).alias("_w"))
    names = ["block", id_col, "places", "counts", "start", "tokens", "totals"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, pieces, held, rows, named = TaskContext.get().partitionId() << 32, [], 0, 0, 0
        for batch in batches:
            ids, split = batch.column(0), batch.column(1)
            ends = np.cumsum(split.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)
            at = 0
            while at < len(ids):
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + min(words - held, PIECE_TOKENS), "right"))
                to = max(at + (not pieces), min(to, at + texts - rows))
                if to > at:
                    pieces.append(_fold_piece(ids.slice(at, to - at), split.slice(at, to - at)))
                    held, rows, named = held + int(ends[to - 1]) - before, rows + to - at, named + len(pieces[-1][4])
                if to == at or held >= words or rows >= texts or named >= BLOCK_NAMES:
                    yield from _block_rows(number, pieces, names)
                    number, pieces, held, rows, named = number + 1, [], 0, 0, 0
                at = to
        if pieces:
            yield from _block_rows(number, pieces, names)

    return written(split.mapInArrow(fold, f"block long, `{id_col}` {kind}, places array<int>, counts array<int>, start int, tokens array<string>, totals array<long>"), "token-blocks")


def block_tokens(blocks: DataFrame) -> DataFrame:
    """(block, place, token, cnt): every distinct token of every block, with its count there."""
    z = blocks.where("tokens IS NOT NULL").select("block", "start", F.posexplode(F.arrays_zip("tokens", "totals")).alias("_at", "_t"))
    return z.select("block", (F.col("start") + F.col("_at")).alias("place"), F.col("_t.tokens").alias("token"), F.col("_t.totals").alias("cnt"))


def top_tokens(blocks: DataFrame, id_col: str) -> DataFrame:
    """(token): every document's most frequent token, of equally frequent ones the first; distinct. A document
    in one row has its place at hand; those in several rows are counted over all of them."""
    docs = blocks.where("tokens IS NULL").select("block", F.col(id_col).alias("_id"), "places", "counts")
    again = written(docs.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_id").alias("_again")), "repeated-ids")
    same = F.col("_id").eqNullSafe(F.col("_again"))
    best = F.array_position("counts", F.array_max("counts")).cast("int")  # the first one: places ascend
    named = block_tokens(blocks).select("block", "place", "token")
    once = docs.join(again, same, "left_anti").select("block", F.element_at("places", best).alias("place")).distinct().join(named, ["block", "place"]).select("token")
    if not again.limit(1).count():
        return once.distinct()
    rows = docs.join(again, same, "left_semi").select("block", "_id", F.explode(F.arrays_zip("places", "counts")).alias("_e"))
    rows = rows.select("block", "_id", F.col("_e.places").alias("place"), F.col("_e.counts").alias("cnt")).join(named, ["block", "place"])
    rows = rows.groupBy("_id", "token").agg(F.sum("cnt").alias("cnt"))
    more = rows.groupBy("_id").agg(F.min(F.struct((-F.col("cnt")).alias("n"), "token")).alias("_m")).select("_m.token")
    return once.unionByName(more).distinct()


def build_vocab(tokens: DataFrame) -> DataFrame:
    """A16 + L3: token, n, p = n/Σn, logp = ln p, token_id = rank by (n desc, token) from 0.

    ``tokens`` is either one row per occurrence or the per-document counts (a ``cnt`` column):
    building from the counts lets a query share one tokenisation between the vocabulary and the
    per-document side.

    Ranks follow the order (n desc, token) by range partitions of that composite key, so the long
    tail of tokens seen once is cut by the token itself and numbered by many tasks. The counted
    tokens are written once; the total is a scalar subquery over that table."""
    n = F.sum("cnt") if "cnt" in tokens.columns else F.count(F.lit(1))
    v = key_position(tokens.groupBy("token").agg(n.alias("n")), [F.col("n").desc(), F.col("token")], name="token_id")
    total = v.agg(F.sum("n")).scalar()
    return (v.withColumn("p", F.col("n") / total).withColumn("logp", F.log(F.col("p")))
            .select("token", "n", "p", "logp", "token_id"))


def frequent_tokens(vocab: DataFrame) -> DataFrame:
    """(token): those with more than 1/HOT_SHARE of all counted occurrences, at most HOT_SHARE."""
    return vocab.where(F.col("p") * HOT_SHARE > 1).select("token")


def attach_token_ids(df: DataFrame, vocab: DataFrame, n_vectors: Column | int | None = None,
                     unk_id: int = 0, hot: DataFrame | None = None, folded: bool = False) -> DataFrame:
    """Token → (token_id, logp); unknown tokens get ``unk_id``; ids beyond the vector table
    (``n_vectors``) fall back to ``unk_id`` too. ``hot`` lists tokens that hold many rows of ``df``
    (default: the vocabulary's frequent ones; ``hot_join.hot_keys`` finds those of another corpus):
    their rows are spread over many tasks by a hash of the row. ``folded``: ``df`` has one row per text
    and token, so that no token holds a large share of it, and a plain join will do."""
    spread = F.xxhash64(*[c for c in df.columns if c != "token"])
    ids = vocab.select("token", "token_id", "logp")
    j = df.join(ids, "token", "left") if folded else salted_join(
        df, ids, "token", frequent_tokens(vocab) if hot is None else hot, spread, "left")
    tid = F.coalesce(F.col("token_id"), F.lit(unk_id))
    if n_vectors is not None:
        nv = F.lit(n_vectors) if isinstance(n_vectors, int) else n_vectors
        tid = F.when(tid < nv, tid).otherwise(F.lit(unk_id))
    return j.withColumn("vid", tid.cast("long"))


def sif_weight(logp) -> Column:
    """a / (a + exp(logp)); an unknown token (null logp) weighs 1."""
    lp = F.col(logp) if isinstance(logp, str) else logp
    return F.coalesce(F.lit(SIF_A) / (F.lit(SIF_A) + F.exp(lp)), F.lit(1.0))


def vector_dim(vectors: DataFrame, vec: str = "embedding") -> int:
    """Dimension of the vector table (one row read)."""
    row = vectors.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    return int(row[0]) if row else 0


def _block_runs(blocks: DataFrame, vectors: DataFrame) -> tuple[int, Column]:
    """(number of runs, run of a block): blocks of neighbouring tasks are gathered together, a run gets each of its
    vectors once. At most GATHER_WAVES runs a core, so the vectors sent grow with the vector table only and not with
    the blocks too; where the table is larger than HELD_VECTORS, every block is a run, which bounds what it holds."""
    task, number = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    last = blocks.agg(F.max(task), F.max(number)).first()
    tasks, most = [1 + (x or 0) for x in last]
    cores, large = blocks.sparkSession.sparkContext.defaultParallelism, vectors.count() > HELD_VECTORS
    apart = most if large or tasks < cores else 1  # blocks of a task that may go to different runs
    units = tasks * apart
    runs = units if large else min(units, GATHER_WAVES * cores)
    unit = task * F.lit(apart) + F.least(number, F.lit(apart - 1))
    return runs, F.floor(unit * F.lit(runs) / F.lit(units)).cast("int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, vid, w) as rows (block, places, vids, ws), up to PACK_ROWS rows at a time."""
    held = []

    def rows() -> pa.RecordBatch:
        block, *others = (pa.concat_arrays([x.column(i) for x in held]) for i in range(4))
        block = block.to_numpy()
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        cut, order = pa.array(np.r_[first, len(block)], pa.int32()), pa.array(order)
        return pa.RecordBatch.from_arrays([pa.array(block[first]), *[pa.ListArray.from_arrays(cut, x.take(order)) for x in others]], names=["block", "places", "vids", "ws"])

    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) >= PACK_ROWS:
            yield rows()
            held = []
    if held:
        yield rows()


def _held(found: list[pa.RecordBatch], dim: int) -> tuple:
    """The vectors of a run: (ids in order, their values, which of these are not null, how often an id comes). Ids are ranks
    by frequency, so the vectors of the commonest words lie together."""
    vid, row = np.unique(np.concatenate([x["vids"].flatten().to_numpy() for x in found]), return_inverse=True)
    flat = pa.concat_arrays([x["v"].flatten() for x in found])
    gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(row), dim) if flat.null_count else None
    value, there = flat.fill_null(0).to_numpy().reshape(len(row), dim), None if gaps is None else (~gaps).astype(np.int64)
    if len(vid) == len(row):  # the vectors as they stand
        order = np.argsort(row)
        return vid, value[order], there if there is None else there[order], np.ones(len(vid), np.int64)
    every, value = value, np.zeros((len(vid), dim))  # a vector id in several rows counts with each of them
    np.add.at(value, row, every)
    if gaps is not None:
        every, there = there, np.zeros((len(vid), dim), np.int64)
        np.add.at(there, row, every)
    return vid, value, there, np.bincount(row).astype(np.int64)


def _places(found: list[pa.RecordBatch], vid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the vector ids, -1 for none; weight) by the places of a block."""
    place, want, w = (np.concatenate([x[c].flatten().to_numpy() for x in found]) for c in ("places", "vids", "ws"))
    at = np.minimum(np.searchsorted(vid, want), len(vid) - 1)
    of, weigh = np.full(int(place.max()) + 1, -1), np.zeros(int(place.max()) + 1)
    of[place], weigh[place] = np.where(vid[at] == want, at, -1), w
    return of, weigh


def _doc_sums(docs: pa.RecordBatch, id_col: str, dim: int, held: tuple, of: np.ndarray, weigh: np.ndarray) -> pa.RecordBatch | None:
    """(id, n, _ws, _s) of documents of a block, whose words have these vectors and weights."""
    _, value, there, times = held
    at, count = docs["places"], docs["counts"]
    doc = np.repeat(np.arange(len(docs)), at.value_lengths().to_numpy())
    at, count = at.flatten().to_numpy(), count.flatten().to_numpy()
    keep = of.take(at, mode="clip") >= 0
    keep &= at < len(of)
    doc, at, count = doc[keep], at[keep], count[keep].astype(np.int64)
    has, first = np.unique(doc, return_index=True)
    if not len(has):
        return None
    r, ww = of[at], weigh[at] * count
    n, ws = np.add.reduceat(count * times[r], first), np.add.reduceat(ww * times[r], first)
    sums, some = np.zeros((len(has), dim)), np.ones((len(has), dim), bool)
    end = np.r_[first[1:], len(r)]
    lo = 0
    while lo < len(has):  # a bounded number of entries at a time; a long text alone, piece by piece
        hi = max(lo + 1, int(np.searchsorted(end, first[lo] + GATHER_ROWS, "right")))
        if hi == lo + 1:
            for a in range(first[lo], end[lo], GATHER_ROWS):
                b = min(a + GATHER_ROWS, end[lo])
                sums[lo] += ww[a:b] @ value[r[a:b]]
        else:
            a, b = first[lo], end[hi - 1]
            sums[lo:hi] = np.add.reduceat(value[r[a:b]] * ww[a:b, None], first[lo:hi] - a, axis=0)
        if there is not None:
            some[lo:hi] = np.add.reduceat(there[r[first[lo]:end[hi - 1]]], first[lo:hi] - first[lo], axis=0) > 0
        lo = hi
    flat = pa.array(sums.reshape(-1), mask=None if there is None else ~some.reshape(-1))
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * dim, pa.int32()), flat)
    return pa.RecordBatch.from_arrays([docs[id_col].take(pa.array(has)), pa.array(n), pa.array(ws), listed], names=[id_col, "n", "_ws", "_s"])


def gather(blocks: DataFrame, tokens: DataFrame, vectors: DataFrame, id_col: str, dim: int,
           weight: Column | None = None, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, n, _ws, _s0 ...): per document the number of gathered vectors, Σ w·cnt and Σ w·cnt·v.

    ``blocks`` are the documents (``token_blocks``), ``tokens`` their ``block_tokens`` with the vector id
    ``vid``. A run of blocks (``_block_runs``) meets in one task, in this order: the vectors that its tokens have,
    then per block the vector ids and weights of its places and its documents. The task holds the vectors of
    the run and the places of one block; documents pass by."""
    float_type = vectors.schema[vec].dataType.simpleString() == "array<float>"
    kind = "array<float>" if float_type else "array<double>"
    v = F.col(vec) if float_type else F.col(vec).cast("array<double>")
    v = F.array(*[v[i] for i in range(dim)]).cast(kind)
    w = (weight if weight is not None else F.lit(1.0)).cast("double")
    runs, run = _block_runs(blocks, vectors)
    parts = min(runs, max(GATHER_WAVES * blocks.sparkSession.sparkContext.defaultParallelism, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    places = written(tokens.select("block", "place", F.col("vid").cast("long").alias("vid"), w.alias("w"))
                     .mapInArrow(_packed, "block long, places array<int>, vids array<long>, ws array<double>"), "block-vids")
    needed = places.select(run.alias("run"), F.explode(F.array_distinct("vids")).alias("vid")).distinct()
    needed = needed.join(vectors.select(F.col(vec_id).alias("vid"), v.alias("v")), "vid")

    rest = {id_col: blocks.schema[id_col].dataType.simpleString(), "places": "array<int>", "counts": "array<int>", "vids": "array<long>", "ws": "array<double>", "v": kind}

    def side(df: DataFrame, run: Column, block: Column, step: int, **have: Column) -> DataFrame:
        none = {c: F.lit(None).cast(t).alias(c) for c, t in rest.items()}
        return df.select(run.alias("run"), block.alias("block"), F.lit(step).alias("step"), *[have[c].alias(c) if c in have else none[c] for c in rest])

    rows = (side(needed, F.col("run"), F.lit(-1).cast("long"), 0, vids=F.array("vid"), v=F.col("v"))
            .unionByName(side(places, run, F.col("block"), 1, **{c: F.col(c) for c in ("places", "vids", "ws")}))
            .unionByName(side(blocks.where("tokens IS NULL"), run, F.col("block"), 2, **{c: F.col(c) for c in (id_col, "places", "counts")})))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, listed, at = {}, None, {}, None  # the vectors of the run, the places of the block
        for batch in batches:
            key = np.stack([batch[c].to_numpy() for c in ("run", "block", "step")], 1)
            cut = np.r_[0, 1 + np.flatnonzero((key[1:] != key[:-1]).any(1)), len(key)] if len(key) else [0]
            for lo, hi in zip(cut[:-1], cut[1:]):
                (r, block, step), rows = key[lo].tolist(), batch.slice(lo, hi - lo)
                if step == 0:
                    found, held, listed, at = {r: [*found.get(r, []), rows.select(["vids", "v"])]}, None, {}, None
                elif r in found and step == 1:
                    listed, at = {block: [*listed.get(block, []), rows.select(["places", "vids", "ws"])]}, None
                elif r in found and block in listed:
                    held = held or _held(found[r], dim)
                    found[r] = []
                    at = at or _places(listed[block], held[0])
                    listed[block] = []
                    for x in range(0, len(rows), GATHER_DOCS):
                        some = _doc_sums(rows.slice(x, GATHER_DOCS), id_col, dim, held, *at)
                        if some is not None:
                            yield some

    placed = rows.repartitionById(parts, F.floor(F.col("run") * F.lit(parts) / F.lit(runs)).cast("int")).sortWithinPartitions("run", "block", "step")
    part = placed.mapInArrow(sums, f"`{id_col}` {rest[id_col]}, n long, _ws double, _s array<double>")
    # rows that share an id are one document
    return part.groupBy(id_col).agg(F.sum("n").alias("n"), F.sum("_ws").alias("_ws"), *[F.sum(F.col("_s")[i]).alias(f"_s{i}") for i in range(dim)])


def pool(doc_tokens: DataFrame, vectors: DataFrame, id_col: str, dim: int,
         weight: Column | None = None, vec_id: str = "vec_id", vec: str = "embedding",
         l2: bool = True, blocks: DataFrame | None = None) -> DataFrame:
    """A14 (weight = SIF) / A15 (weight = 1): Σ w·cnt·v / Σ w·cnt per document, optionally
    L2-normalised. ``doc_tokens`` holds (id, vid, cnt[, logp]), or with ``blocks`` the tokens of these
    blocks (block, place, vid[, logp]), which moves far less (``gather``).

    Without blocks the vector table is joined on its id without a hint: when its measured size is under
    the broadcast threshold it is broadcast, otherwise a shuffle join with AQE skew splitting."""
    if blocks is not None:
        return _mean(gather(blocks, doc_tokens, vectors, id_col, dim, weight, vec_id, vec), id_col, dim, l2)
    w = (weight if weight is not None else F.lit(1.0)) * F.col("cnt")
    vt = vectors.select(F.col(vec_id).alias("vid"), F.col(vec).cast("array<double>").alias("_v"))
    # the many tokens without a vector share id 0: folded to one row per document before the join
    j = doc_tokens.groupBy(id_col, "vid").agg(F.sum(w).alias("_w")).join(vt, "vid")
    sums = [F.sum(F.col("_w") * F.col("_v")[i]).alias(f"_s{i}") for i in range(dim)]
    return _mean(j.groupBy(id_col).agg(F.sum("_w").alias("_ws"), *sums), id_col, dim, l2)


def _mean(agg: DataFrame, id_col: str, dim: int, l2: bool) -> DataFrame:
    v = F.array(*[F.when(F.col("_ws") > 0, F.col(f"_s{i}") / F.col("_ws")).otherwise(F.col(f"_s{i}"))
                  for i in range(dim)])
    out = agg.select(id_col, v.alias("vector"))
    return out.withColumn("vector", normalize("vector")) if l2 else out


def idf_weights(vocab: DataFrame) -> DataFrame:
    """clip(-ln(max(p, eps)), 1, 15) rescaled so the mean is 1 (the mean is a scalar
    subquery)."""
    raw = F.least(F.greatest(-F.log(F.greatest(F.col("p"), F.lit(IDF_EPSILON))), F.lit(IDF_CLIP_MIN)),
                  F.lit(IDF_CLIP_MAX))
    v = vocab.withColumn("_idf", raw)
    mean = v.agg(F.avg("_idf")).scalar()
    return v.withColumn("idf", F.col("_idf") / mean).drop("_idf")


def weight_summary(weights: DataFrame, col: str = "idf") -> DataFrame:
    """Min / max / mean of a weight column."""
    return weights.agg(F.min(col).alias("weight_min"), F.max(col).alias("weight_max"),
                       F.avg(col).alias("weight_mean"))


def centroid_cosine(vectors: DataFrame, key: str, vec_id: str = "vec_id", vec: str = "embedding",
                    dim: int | None = None) -> DataFrame:
    """J9 keyed form: cosine of every vector to the centroid of its class. The centroids are
    one row per class, computed with per-dimension sums (a partial aggregate)."""
    d = dim or vector_dim(vectors, vec)
    v = vectors.select(vec_id, key, F.col(vec).cast("array<double>").alias("_v"))
    cen = class_centroids(vectors, key, vec, d).withColumnRenamed(vec, "_cen")
    return (v.join(cen, key).select(vec_id, key, cosine("_v", "_cen").alias("cosine")))


PROBE_BLOCK, VECTOR_BLOCK = 256, 1024  # vectors of a block of the matrix product


def _blocks(vectors: DataFrame, vid: str, vec: str, size: int, side: str) -> DataFrame:
    """(block, n ids, flat vectors): ``size`` vectors a row, in id order. A null vector is left out."""
    v = key_position(vectors.select(F.col(vid).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL"), "id", name="_i")
    rows = F.array_sort(F.collect_list(F.struct("_i", "id", "v")))  # at most ``size``
    return written(v.groupBy(F.expr(f"_i div {size}").alias(f"{side}_block")).agg(rows.alias("_r"))
                   .select(f"{side}_block", F.col("_r.id").alias(f"{side}_ids"), F.flatten("_r.v").alias(f"{side}_v")), f"{side}-blocks")


def cosine_matrix(probes: DataFrame, vectors: DataFrame | None = None, pid: str = "id", vid: str = "id", vec: str = "embedding") -> DataFrame:
    """(id_a, id_b, cosine) of every probe with every vector, or without ``vectors`` of the unique pairs
    of the probe list (id_a before id_b). 0.0 where a vector has zero norm; vectors of one length.

    A blocked matrix product: probes and vectors become blocks of bounded size, every pair of blocks is
    one row, joined on (probe block, vector block), so the product of any size is spread evenly over
    the tasks, and a task holds two blocks at a time. The probe list may be any table."""
    own = vectors is None
    a = _blocks(probes, pid, vec, PROBE_BLOCK, "a")
    b = _blocks(probes, pid, vec, PROBE_BLOCK, "b") if own else _blocks(vectors, vid, vec, VECTOR_BLOCK, "b")
    count = {side: df.agg(F.coalesce(F.max(f"{side}_block") + 1, F.lit(0))).scalar() for side, df in (("a", a), ("b", b))}
    left = a.withColumn("_b", F.explode(F.when(count["b"] > 0, F.sequence(F.col("a_block") if own else F.lit(0).cast("long"), count["b"] - 1))))
    right = b.withColumn("_a", F.explode(F.when(count["a"] > 0, F.sequence(F.lit(0).cast("long"), F.col("b_block") if own else count["a"] - 1))))
    pairs = left.join(right, (F.col("a_block") == F.col("_a")) & (F.col("_b") == F.col("b_block")))

    def multiply(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (np.asarray(batch[f"{s}_v"][row].values, dtype=float).reshape(len(batch[f"{s}_ids"][row]), -1) for s in "ab")
                ia, ib = (batch[f"{s}_ids"][row].values for s in "ab")
                norm = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
                cos = np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm != 0)
                keep = np.triu(np.ones(cos.shape, bool), 1) if own and batch["a_block"][row] == batch["b_block"][row] else np.ones(cos.shape, bool)
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ia.take(pa.array(i)), ib.take(pa.array(j)), pa.array(cos[i, j])], names=["id_a", "id_b", "cosine"])

    kind = {s: df.schema[f"{s}_ids"].dataType.elementType.simpleString() for s, df in (("a", a), ("b", b))}
    return pairs.select("a_block", "b_block", "a_ids", "a_v", "b_ids", "b_v").mapInArrow(multiply, f"id_a {kind['a']}, id_b {kind['b']}, cosine double")


def class_centroids(vectors: DataFrame, key: str, vec: str = "embedding", dim: int | None = None) -> DataFrame:
    """(key, embedding): the mean vector of every class, one partial aggregate."""
    d = dim or vector_dim(vectors, vec)
    v = F.col(vec).cast("array<double>")
    cen = vectors.groupBy(key).agg(*[F.avg(v[i]).alias(f"_c{i}") for i in range(d)])
    return cen.select(key, F.array(*[F.col(f"_c{i}") for i in range(d)]).alias(vec))


def pad_ids(ids, max_len: int = 48) -> tuple[Column, Column]:
    """F8: truncate to ``max_len``, an empty list becomes [0]; pad with 0 to ``max_len``.
    Returns (ids, pad_mask) with True = padding."""
    c = F.col(ids) if isinstance(ids, str) else ids
    seq = F.slice(c, 1, max_len)
    seq = F.when(F.size(seq) == 0, F.array(F.lit(0).cast("long"))).otherwise(seq)
    n = F.size(seq)
    padded = F.concat(seq, F.array_repeat(F.lit(0).cast("long"), F.lit(max_len) - n))
    mask = F.transform(F.sequence(F.lit(1), F.lit(max_len)), lambda i: i > n)
    return padded, mask


def attention_mask(pad_mask) -> Column:
    """1 where a real token, 0 where padding."""
    c = F.col(pad_mask) if isinstance(pad_mask, str) else pad_mask
    return F.transform(c, lambda m: F.when(m, F.lit(0)).otherwise(F.lit(1)))


__all__ = ["tokenize", "token_counts", "token_blocks", "block_tokens", "top_tokens", "build_vocab", "attach_token_ids", "sif_weight", "gather", "pool",
           "idf_weights", "weight_summary", "centroid_cosine", "cosine_matrix", "class_centroids", "pad_ids",
           "attention_mask", "vector_dim"]
