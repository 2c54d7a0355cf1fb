"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct five-word shingles (64-bit hashes). Documents with equal sets
are one class, and only one document of a class takes part in what follows.

- Every class has a sketch: ``COORDS`` minwise values of its set. A tree starts with all classes in
  its root. A node selects one minwise coordinate, or two, 1/0.85 on average; its documents branch
  to a child per selected coordinate, named by the minwise value they have there. So two documents
  at the threshold share one child on average and closer ones more, while unrelated ones part at
  once. A document finds its paths from its own sketch; only (node, id) pairs are shuffled.
- A pair meets in a node ``START_DEPTH`` levels down of one tree with probability 0.64 at the
  threshold (more above it), and ``TREES`` independent trees miss it with probability 5e-6. Each
  further level lowers that (0.50 at 8 levels: 2e-4; pairs of 0.9 and more: under 1e-6).
- Star round: each class is compared with the smallest id it shares a node with. That links almost
  all copies with one comparison each, and what is linked need not be compared again.
- Nodes whose documents still lie in different components: small ones (``WORK``) are compared
  exhaustively, larger ones branch further, and what stays large ``MAX_DEPTH`` levels down
  is compared block by block, so no task holds an unbounded group and no pair of a node is left out.
  A node's task has the full sets and emits links only, one per pair of components it joins.
- The sketches rule out pairs that lie more than four standard errors below the threshold; every
  other pair is confirmed on the full sets: 100·|A∩B| ≥ 85·|A∪B|.

Edge cases: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; fewer than five words make one
shingle of them all; a null or empty text has no shingle and no link; texts are read whole. Rows
without doc_id get component null and are kept; rows that repeat a doc_id count as one document;
an empty table gives an empty result; other columns are not read. ``keep_one`` goes by row instead:
each text counts, whatever its doc_id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm import tokens as T
from labelforge.llm.bloom_cascade import accepts, encode
from labelforge.llm.components import components
from labelforge.llm.row_keys import row_keys
from labelforge.llm.store import materialize

SHINGLE = 5
NUM, DEN = 85, 100
COORDS = 64
BINS = 256
TREES = 12
START_DEPTH = 4
STEP = 2
MAX_DEPTH = 24
WORK = 1 << 28  # a node is compared in one task if its documents times its shingles stay below
BLOCK_ROWS = 200
# four standard errors under the threshold, of COORDS minwise values and of BINS bins
MIN_COORDS = int(COORDS * (NUM / DEN - 4 * (NUM / DEN * (1 - NUM / DEN) / COORDS) ** 0.5))
MIN_BINS = NUM / DEN - 4 * (NUM / DEN * (1 - NUM / DEN) / BINS) ** 0.5

_RNG = np.random.default_rng(85)
_XOR = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64)
_MUL = _RNG.integers(1, 2**63, COORDS, dtype=np.uint64) | np.uint64(1)


# ------------------------------------------------------------------ sets and sketches
def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = T.Words(data, offsets, T.SPACE_WORDS)
    h = w.hashes()
    r = T.runs(h, tuple(range(SHINGLE)))
    out = []
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(r[a:b - SHINGLE + 1]))
        elif b > a:
            out.append(T.runs(h[a:b], tuple(range(b - a)), salt=b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_shingles, a 128-bit signature of the set, its minwise values, and for each of BINS equal
    parts of the hash range one byte of the smallest hash in it (0: none)."""
    names = ["doc_id", "n_shingles", "sig1", "sig2", "mins", "bins"]
    for batch in batches:
        for a, b, data, off in T.text_chunks(batch, "text"):
            sets = shingle_sets(data, off)
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            mins = np.zeros((b - a, COORDS), np.uint32)
            bins = np.zeros((b - a, BINS), np.uint8)
            sig = np.zeros((2, b - a), np.uint64)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                at = np.r_[0, np.cumsum(sizes[some])[:-1]]
                for k in range(COORDS):
                    mins[some, k] = np.minimum.reduceat((flat ^ _XOR[k]) * _MUL[k], at) >> np.uint64(32)
                for k, c in enumerate((0x1234567, 0x89ABCDEF01)):
                    sig[k, some] = np.add.reduceat(T.mix(flat ^ np.uint64(c)), at)
                owner = np.repeat(some, sizes[some])
                part = (flat >> np.uint64(56)).astype(np.int64) + owner * BINS
                first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                bins.reshape(-1)[part[first]] = (T.mix(flat[first]) % np.uint64(255)).astype(np.uint8) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)),
                 pa.array([m.tobytes() for m in mins], pa.binary()), pa.array([m.tobytes() for m in bins], pa.binary())], names=names)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, off in T.text_chunks(batch, "text"):
            sets = [s.tobytes() for s in shingle_sets(data, off)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["id", "shingles"])


# ------------------------------------------------------------------ paths
def children(nodes: np.ndarray, mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) of rows that stand in ``nodes``; ``mins`` has a row for each. What a node
    selects depends on the node alone: one coordinate, and a second one in 1/0.85 - 1 of the nodes."""
    x = T.mix(nodes ^ np.uint64(0x9E3779B97F4A7C15))
    one = (x % np.uint64(COORDS)).astype(np.int64)
    two = (one + 1 + ((x >> np.uint64(8)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
    more = np.flatnonzero((x >> np.uint64(40)).astype(np.float64) < (DEN / NUM - 1) * 2**24)
    row = np.r_[np.arange(len(nodes)), more]
    coord = np.r_[one, two[more]]
    value = mins[row, coord].astype(np.uint64) | (coord.astype(np.uint64) << np.uint64(32))
    return row, T.mix(nodes[row] + T.mix(value))


def _branch(batches: Iterator[pa.RecordBatch], levels: int, root: bool) -> Iterator[pa.RecordBatch]:
    """(node, id, size) ``levels`` further down; from the roots of all trees, or from the column node."""
    for batch in batches:
        ids, size = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("id", "size"))
        if not len(ids):
            continue
        raw = batch.column(batch.schema.get_field_index("mins"))
        mins = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(-1, COORDS)
        if root:
            row = np.tile(np.arange(len(ids)), TREES)
            node = np.repeat(T.mix(np.arange(1, TREES + 1, dtype=np.uint64)), len(ids))
        else:
            row = np.arange(len(ids))
            node = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False).view(np.uint64)
        for _ in range(levels):
            at, node = children(node, mins[row])
            row = row[at]
        yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(ids[row]), pa.array(size[row])], names=["node", "id", "size"])


def similar(mins: np.ndarray, bins: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sketches of i and j leave room for the threshold."""
    ok = np.count_nonzero(mins[i] == mins[j], axis=1) >= MIN_COORDS
    i, j = i[ok], j[ok]
    same = np.count_nonzero((bins[i] == bins[j]) & (bins[i] > 0), axis=1)
    used = np.count_nonzero((bins[i] > 0) | (bins[j] > 0), axis=1)
    out = np.zeros(len(ok), bool)
    out[np.flatnonzero(ok)[same >= MIN_BINS * used]] = True
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if DEN * len(small) < NUM * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """|A∩B| of all pairs: the sets as rows of a 0/1 matrix, multiplied slice by slice."""
    sizes = [len(x) for x in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    words, col = np.unique(np.concatenate(sets), return_inverse=True)
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    width = max(1024, (4 << 20) // len(sets))
    for x in range(0, len(words), width):
        lo, hi = np.searchsorted(col, (x, x + width))
        m = np.zeros((len(sets), min(width, len(words) - x)), np.float32)
        m[owner[lo:hi], col[lo:hi] - x] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def _links_of(docs: list[dict]) -> list[tuple[int, int]]:
    ids = [d["id"] for d in docs]
    comp = np.array([d["component"] for d in docs])
    mins = np.frombuffer(b"".join(d["mins"] for d in docs), np.uint32).reshape(-1, COORDS)
    bins = np.frombuffer(b"".join(d["bins"] for d in docs), np.uint8).reshape(-1, BINS)
    near = []
    for k in range(len(ids) - 1):
        j = np.flatnonzero(comp[k + 1:] != comp[k]) + k + 1
        j = j[similar(mins, bins, np.full(len(j), k), j)] if len(j) else j
        near += [(k, x) for x in j.tolist()]
    if not near:
        return []
    used = np.unique(np.array(near))
    sets = {k: np.frombuffer(docs[k]["shingles"], np.uint64) for k in used.tolist()}
    if len(near) > 2 * len(used):
        place = {k: i for i, k in enumerate(used.tolist())}
        both = shared(list(sets.values()))
        near = [(i, j) for i, j in near if DEN * (n := both[place[i], place[j]]) >= NUM * (len(sets[i]) + len(sets[j]) - n)]
    else:
        near = [(i, j) for i, j in near if linked(sets[i], sets[j])]
    out = []
    for i, j in near:
        if comp[i] != comp[j]:
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            comp[comp == comp[j]] = comp[i]
    return out


def _node_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a node between different components; components that a link joins are one from then on."""
    for batch in batches:
        out = [ab for node in batch.column(0) for ab in _links_of(node.as_py())]
        cols = list(zip(*out)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _sketch_check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        n = len(batch)
        mins = np.frombuffer(b"".join(cols["mins"].to_pylist() + cols["mins_b"].to_pylist()), np.uint32).reshape(-1, COORDS)
        bins = np.frombuffer(b"".join(cols["bins"].to_pylist() + cols["bins_b"].to_pylist()), np.uint8).reshape(-1, BINS)
        ok = pa.array(similar(mins, bins, np.arange(n), np.arange(n) + n))
        yield pa.RecordBatch.from_arrays([cols["a"].filter(ok), cols["b"].filter(ok)], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets reach the threshold."""
    for batch in batches:
        ok = pa.array([linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                       for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


# ------------------------------------------------------------------ the join
class _Join:
    def __init__(self, slim: DataFrame, reps: DataFrame, repeated: bool = False):
        self.slim, self.reps, self.repeated = slim, reps, repeated

    def sets(self, ids: DataFrame, n: int) -> DataFrame:
        """(id, shingles) of the ids in the column ``key`` (at most ``n`` different ones). Their
        texts are read again: a Bloom filter of bounded size drops most others at the scan, the
        join the rest."""
        bloom = encode(ids, n)
        docs = self.slim.where(accepts(bloom, F.col("doc_id"), bloom.bits.scalar()))
        docs = docs.join(ids.distinct(), F.col("doc_id") == F.col("key"), "left_semi")
        if self.repeated:  # a set for each id, not for each row of it
            docs = docs.dropDuplicates(["doc_id"])
        return materialize(docs.mapInArrow(_full_sets, "id bigint, shingles binary"), "shingle-sets")

    def busy(self, nodes: DataFrame) -> DataFrame:
        """The rows of nodes that hold two ids or more, with the node's size and smallest id."""
        size = materialize(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub"), F.sum("size").alias("total")).where("n > 1"), "nodes")
        return materialize(nodes.join(size, "node"), "members")

    def stars(self, members: DataFrame) -> DataFrame:
        """Links (a, b) of each id b with the smallest other id of its nodes."""
        pairs = members.where("id <> hub").groupBy(F.col("id").alias("b")).agg(F.min("hub").alias("a"))
        left = self.reps.select(F.col("id").alias("a"), "mins", "bins")
        right = self.reps.select(F.col("id").alias("b"), F.col("mins").alias("mins_b"), F.col("bins").alias("bins_b"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "mins", "mins_b", "bins", "bins_b")
        pairs = materialize(both.mapInArrow(_sketch_check, "a bigint, b bigint"), "star-pairs")
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("key")), 2 * pairs.count())
        a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
        b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
        full = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
        return materialize(full.mapInArrow(_linked, "a bigint, b bigint").distinct(), "star-links")

    def exhaustive(self, groups: DataFrame, keys: list[str], sets: DataFrame) -> DataFrame:
        """Links within each group of a bounded number of rows (id, component)."""
        rows = groups.join(self.reps.select("id", "mins", "bins").join(sets, "id"), "id")
        held = rows.groupBy(*keys).agg(F.collect_list(F.struct("id", "component", "mins", "bins", "shingles")).alias("docs"))
        return materialize(held.select("docs").mapInArrow(_node_links, "a bigint, b bigint").distinct(), "node-links")

    def mixed(self, members: DataFrame, label: DataFrame) -> DataFrame:
        """The members (node, id, n, total) of nodes that hold several components, with their component."""
        rows = members.select("node", "id", "n", "total").join(label, "id", "left").select("node", "id", "n", "total", F.coalesce("component", "id").alias("component"))
        rows = materialize(rows, "labelled")
        several = rows.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("node")
        return materialize(rows.join(materialize(several, "mixed"), "node"), "mixed-rows")

    def rest(self, members: DataFrame, links: DataFrame) -> DataFrame:
        """(id, component) after all nodes that hold several components are compared; ``links``: the
        star round's. What a level links is known when the next one is looked at."""
        rows = self.mixed(members, _star_labels(links))
        n = rows.count()
        if not n:
            return components(links)
        sets = self.sets(rows.select(F.col("id").alias("key")), n)  # the nodes further down hold no other ids
        depth = START_DEPTH
        while True:
            links = links.union(self.exhaustive(rows.where(F.col("n") * F.col("total") <= WORK), ["node"], sets))
            large = rows.where(F.col("n") * F.col("total") > WORK)
            if not large.limit(1).count():
                return components(links)
            label = components(links)
            large = self.mixed(large, label)
            if not large.limit(1).count():
                return label
            if depth >= MAX_DEPTH:
                return components(links.union(self.blocks(large, sets)))
            depth += STEP
            below = large.select("node", "id").join(self.reps.select("id", "mins", "size"), "id")
            below = materialize(below.mapInArrow(lambda bs: _branch(bs, STEP, False), "node bigint, id bigint, size bigint").distinct(), "paths")
            rows = self.mixed(self.busy(below), label)

    def blocks(self, large: DataFrame, sets: DataFrame) -> DataFrame:
        """All pairs of nodes that don't get smaller: every row goes to each pair of blocks it is in."""
        n_blocks = F.ceil(F.col("n") / (BLOCK_ROWS // 2)).cast("int")
        mine = F.pmod(F.xxhash64("id"), n_blocks).cast("int")
        rows = large.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        return self.exhaustive(rows.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}), ["node", "lo", "hi"], sets)


def _star_labels(links: DataFrame) -> DataFrame:
    """(id, component) of star links, two steps up from each id: ids with equal labels are connected
    (others may be too, which costs a comparison and no link)."""
    up = links.select(F.col("b").alias("a"), F.col("a").alias("up"))
    return materialize(links.join(up, "a", "left").select(F.col("b").alias("id"), F.coalesce("up", "a").alias("component")), "star-labels")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repeated: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept, for
    every row. ``repeated``: ids stand in several rows, of equal texts."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = materialize(slim.mapInArrow(_sketched, "doc_id bigint, n_shingles bigint, sig1 bigint, sig2 bigint, mins binary, bins binary"), "sketches")
    named = sketch.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    sig = ["sig1", "sig2", "n_shingles"]
    classes = materialize(named.groupBy(*sig).agg(F.min("doc_id").alias("id")), "classes")
    reps = named.join(classes.select(F.col("id").alias("doc_id"), *sig), ["doc_id", *sig]).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "mins", "bins")
    reps = materialize(reps.dropDuplicates(["id"]), "class-sketches")
    join = _Join(slim, reps, repeated)
    members = join.busy(reps.select("id", "mins", "size").mapInArrow(lambda bs: _branch(bs, START_DEPTH, True), "node bigint, id bigint, size bigint").distinct())
    label = join.rest(members, join.stars(members))
    of_class = materialize(classes.join(label, "id", "left").select(*sig, F.coalesce("component", "id").alias("component_id")), "class-components")
    told = sketch.select("doc_id", *sig).join(of_class, sig, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return told.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id, rows without one last;
    columns untouched. Rows are judged each by its own text: rows without doc_id and different texts
    under one doc_id too. Rows with equal doc_id and text are one; rows with neither doc_id nor
    words all stay."""
    key, keys = row_keys(docs, doc_id, text)
    repeated = bool(keys.where("n > 1").limit(1).count())
    found = near_duplicates(docs.select(key.alias("key"), F.col(text).alias("text")), "key", "text", repeated)
    found = materialize(found.select(F.col("doc_id").alias("key"), "n_shingles", "component_id").distinct().join(keys, "key"), "components")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "key")).alias("b"))
    best = materialize(best.select(F.col("b.key").alias("key")), "kept-rows")
    go = materialize(found.join(best, "key", "left_anti").select(F.col("key").alias("__go")), "duplicates")
    left = docs.withColumn("__key", key).join(go, F.col("__key") == F.col("__go"), "left_anti")
    if not repeated:
        return left.drop("__key")
    twice = found.where("n > 1 and (id is not null or n_shingles > 0)").join(best, "key", "left_semi")
    twice = materialize(twice.select(F.col("key").alias("__twice")), "repeated")
    again = left.join(twice, F.col("__key") == F.col("__twice"), "left_semi").dropDuplicates(["__key"])
    return left.join(twice, F.col("__key") == F.col("__twice"), "left_anti").unionByName(again).drop("__key")
