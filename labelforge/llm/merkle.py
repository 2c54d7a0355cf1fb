"""Merkle manifest of a dataset, with a proof for every row.

Every row is a leaf: the SHA-256 of its fields, each written as ``-`` (null) or its UTF-8 byte count,
``:`` and value. The leaves of a group ascend by id; every ``FANOUT`` consecutive digests of a level
are concatenated as lower-case hex and hashed, until one is left, the group's root (a lone leaf is its
own). The groups' roots, ordered by group (null first), form a tree of the same kind; what remains there
is the dataset's root.

Trees grow level by level, a grouping of at most FANOUT digests each, so the tables shrink eightfold.
Proofs come from pointer jumping: an inner node starts with a pointer to its parent and the segment of
its siblings there (what stands left of it, what stands right); a self-join replaces the pointer by the
pointed node's own and appends that node's segments, which doubles the distance, until every pointer is
at the root. The leaves, eight times as many, make the last jump only: each takes its parent's finished
segments. The right side of a join holds only nodes far enough up to be pointed at, so it shrinks as
its keys get more common. No task holds more than FANOUT children or one row's segments.

Defined cases: rows whose id is null come first in their group; rows of one id are ordered by their
digests, equal rows in any order (their proofs differ by place); null and empty text differ in their leaf
(``-`` and ``0:``); a null group is a group; an empty table gives no row. Only the named columns are
read, so extra ones do not clash.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.store import materialize
from labelforge.operators.position import key_position

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER_TREE = -1  # tree number of the tree over the groups' roots
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def _written(value: Column) -> Column:
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def row_digest(fields: Sequence[Column]) -> Column:
    """The leaf of a row with these fields."""
    return F.sha2(F.concat(*[_written(c) for c in fields]), 256)


def lower_ascii(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, idx, digest, n: nodes of that tree on this level), of which no
    tree has more than ``most``: (tree, depth, idx, digest, children in order, n)."""
    out = []
    while most > 1:
        up = (nodes.where("n > 1").groupBy("tree", "n", F.expr(f"idx div {FANOUT}").alias("up"))
              .agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"))
              .select("tree", F.lit(len(out) + 1).alias("depth"), F.col("up").alias("idx"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest"),
                      F.col("run.digest").alias("children"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n")))
        out.append(materialize(up, f"merkle-level-{len(out) + 1}"))
        nodes, most = out[-1], -(-most // FANOUT)
    return out


def _segment(children: Column, idx: Column) -> Column:
    """The siblings of the child at ``idx``, left and right of it."""
    at = F.pmod(idx, F.lit(FANOUT)).cast("int")
    return F.struct(F.array_join(F.slice(children, F.lit(1), at), "").alias("left"),
                    F.array_join(F.slice(children, at + 2, F.lit(FANOUT)), "").alias("right"))


def _node(tree, depth, idx) -> Column:
    return F.struct(tree.cast("long").alias("tree"), depth.cast("int").alias("depth"), idx.cast("long").alias("idx"))


def _parent(n_trees: int) -> Column:
    """The node above (tree, depth, idx, n): in its tree, or from a group's root in the upper tree."""
    tree, depth, idx, n = (F.col(c) for c in ("tree", "depth", "idx", "n"))
    inside = F.when(n > 1, _node(tree, depth + 1, F.expr(f"idx div {FANOUT}")))
    if n_trees == 1:
        return inside
    return F.coalesce(inside, F.when(tree != UPPER_TREE, _node(F.lit(UPPER_TREE), F.lit(1), F.expr(f"tree div {FANOUT}"))))


def _place() -> Column:
    """The place of a node among its siblings: its index, or its group's number under the upper tree."""
    return F.when(F.col("n") > 1, F.col("idx")).otherwise(F.col("tree"))


def _jumped(inner: DataFrame, n_trees: int, height: int) -> DataFrame:
    """(id, path) of all inner nodes: the segments from each up to the root, by pointer jumping."""
    nodes = inner.withColumns({"id": _node(F.col("tree"), F.col("depth"), F.col("idx")), "ptr": _parent(n_trees), "place": _place()})
    above = nodes.select(F.col("id").alias("up"), F.col("children").alias("run"))
    own = F.when(F.col("up").isNotNull(), F.array(_segment(F.col("run"), F.col("place")))).otherwise(F.array())
    path = materialize(nodes.select("id", "ptr", "place").join(above, F.col("ptr") == F.col("up"), "left")
                       .select("id", "ptr", own.cast(_PATH).alias("path")), "merkle-jump-1")
    distance = 1
    while distance < height:
        # a pointer of this distance starts at depth 1 or higher
        far = path.where((F.col("id.tree") == UPPER_TREE) | (F.col("id.depth") > distance)).select(
            F.col("id").alias("up"), F.col("ptr").alias("next"), F.col("path").alias("rest"))
        distance *= 2
        path = materialize(path.join(far, F.col("ptr") == F.col("up"), "left").select(
            "id", F.col("next").alias("ptr"), F.concat("path", F.coalesce("rest", F.array().cast(_PATH))).alias("path")), f"merkle-jump-{distance}")
    return path.select("id", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, doc_id: str = "doc_id", group: str = "lang",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, group, position, the ``carry`` columns (computed from the
    row in the same pass as its leaf), leaf, subroot, root, and path, the siblings (left, right) of each
    level from the leaf up. The texts are read once and never shuffled."""
    carry = carry or {}
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(group).alias("group"), row_digest([F.col(c) for c in fields]).alias("leaf"),
                       *[c.alias(f"carry_{k}") for k, c in carry.items()])
    slim = materialize(slim, "merkle-rows")  # texts hashed once, as the sampling of the order reads the keys too
    placed = materialize(key_position(slim, ["doc_id", "leaf"], ["group"], "idx", "n"), "merkle-leaves")
    groups = materialize(key_position(placed.groupBy("group").agg(F.max("n").alias("size")), "group", name="tree"), "merkle-groups")
    most, n_trees = groups.agg(F.max("size"), F.count(F.lit(1))).first()
    numbered = (placed.join(groups.select(F.col("group").alias("g"), "tree"), F.col("group").eqNullSafe(F.col("g"))).drop("g")
                .withColumn("depth", F.lit(0)))
    leaves = numbered.select("tree", "depth", "idx", F.col("leaf").alias("digest"), "n")
    lower = _levels(leaves, most or 0)
    subroots = leaves.where("n = 1").select("tree", "digest")
    for level in lower:
        subroots = subroots.unionByName(level.where("n = 1").select("tree", "digest"))
    subroots = materialize(subroots, "merkle-subroots")
    upper = _levels(subroots.select(F.lit(UPPER_TREE).alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(n_trees).alias("n")), n_trees)
    root = (upper[-1] if upper else subroots).agg(F.max("digest")).scalar()

    out = ["doc_id", "group", "idx", *[f"carry_{k}" for k in carry], "leaf"]
    last = numbered.withColumns({"ptr": _parent(n_trees), "place": _place()}).select(*out, "tree", "ptr", "place")
    inner = [x for x in (*lower, *upper)]
    if inner:
        nodes = inner[0]
        for level in inner[1:]:
            nodes = nodes.unionByName(level)
        done = _jumped(nodes, n_trees, len(inner))
        own = nodes.select(_node(F.col("tree"), F.col("depth"), F.col("idx")).alias("node"), "children")
        tops = materialize(own.join(done, own["node"] == done["id"]).select("node", "children", "path")
                           .where((F.col("node.depth") == 1)), "merkle-parents")
        path = F.when(F.col("node").isNull(), F.array().cast(_PATH)).otherwise(
            F.concat(F.array(_segment(F.col("children"), F.col("place"))), F.col("path")))
        last = last.join(tops, F.col("ptr") == F.col("node"), "left").select(*out, "tree", path.alias("path"))
    else:
        last = last.select(*out, "tree", F.array().cast(_PATH).alias("path"))
    return (last.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")
            .select("doc_id", "group", F.col("idx").alias("position"), *[F.col(f"carry_{k}").alias(k) for k in carry],
                    "leaf", "subroot", root.alias("root"), "path"))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` and a check of every proof. Where 3 divides the CRC-32 of the id's
    decimal digits, the proof is checked against a row tampered with: its text's A-Z lower-cased. Columns:
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, position, path. Rows without an id
    are not tampered with."""
    changed = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    seen = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, row_digest(changed))
    m = manifest(docs, carry={"seen": seen})
    return (m.withColumn("folded_root", folded(F.coalesce("seen", "leaf"), F.col("path")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified"), "position", "path"))
