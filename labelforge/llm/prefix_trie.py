"""Prefix trie of conversations, with count-min screening of prefix digests.

A conversation's turns, in order, give it one prefix per depth; conversations that share a prefix share
a node. Every prefix has a 128-bit digest: the exclusive or, over its turns, of a hash of (place, role,
text), so digests of all depths come from one running aggregate. Two different prefixes of a corpus of
n prefixes meet with probability n^2 / 2^129.

Screening: a count-min sketch counts all prefix digests in two rows of counters. As an estimate is never
too small, an estimate of one proves that a prefix belongs to one conversation alone, and so do all
longer ones. Only whether a counter holds one or more matters, so the sketch is kept as one bit a
counter, at most ``MAX_CELLS`` a row, and broadcast. Behind the first proven singleton a conversation's
nodes are its own: they are emitted where the row is. Only the possibly shared prefixes shuffle by digest
and are grouped exactly, so false alarms cost a shuffle and change no result. The sketch grows with the
corpus up to its bound (a quarter of MAX_CELLS prefixes); beyond it, more prefixes shuffle.

Sums over subtrees need no walk over levels. A node's members are known, so a subtree's sum is a sum over
members: every conversation brings, for each depth, what its own path holds from there down, a running sum
over its turns. For saved_tokens a path holds a node's bytes unless the conversation is the node's
smallest member; for n_leaves it holds one where the conversation is the smallest member of its leaf.

Skew: a node with many members is folded by partial aggregates and joined by its key through a salted
join (the nodes with more than 1/256 of all rows are at most 256). A very long conversation is cut
into chunks of ``CHUNK`` turns for its running aggregates. Ids of the conversations ending at one
node are joined to short strings in order, and these are streamed through one SHA-256, which
has no parallel form: bounded memory, an id costs its digits.

Defined cases: null role or text is empty; rows without conv_id are left out; null turns come first;
rows of one turn are ordered by role, then by the digest of their text; repeated rows are turns of their
own; base conversations follow SQL's %, which keeps the sign; an empty table gives no row, not even
a root. Only conv_id, turn, role and text are read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.llm.store import materialize
from labelforge.operators.hot_join import HOT_SHARE, salted_join
from labelforge.operators.position import key_position, ordered

HEADS = 9             # a rebuilt conversation starts with up to 8 turns of its base
FAMILY = 5            # conversations c - c % 5 .. share that base
CHUNK = 1024          # turns of one conversation handled together
CELLS_PER_PREFIX = 4  # counters a row
MAX_CELLS = 1 << 29   # counters a row at most: two rows of bits are 128 MB
PAGE = 32_768         # counters of one bitmap
IDS = 512             # conversation ids of one string
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
ROOT = "struct(0L AS k1, 0L AS k2)"


def turns_in_order(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), n (turns of the conversation), a and b (128 bits of role and text) and
    bytes (of the text). The texts are read once; slim rows are put in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes"))
    return materialize(key_position(slim, ["turn", "role", "a", "b"], ["conv_id"], "pos", "n").drop("turn", "role"), "trie-turns")


def rebuild(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their turns (conv_id, pos, len, a, b, bytes) and (conv_id, len) of all.
    ``h`` turns come from the base conversation, the rest are the conversation's own after its first h."""
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = placed.where("pos = 0").select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    took = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(sizes, "base", "left").withColumn("took", took).withColumn("len", F.col("took") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "base", "n", "h", "took", "len"), "trie-conversations")
    first = placed.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("base"), "pos", "a", "b", "bytes")
    heads = convs.where("took > 0").select("conv_id", "base", "h", "len").join(first, "base").where("pos < h")
    hot = convs.where(F.col("n") * HOT_SHARE > convs.agg(F.sum("n")).scalar()).select("conv_id")
    own = salted_join(placed.where(F.col("pos") >= h).select("conv_id", "pos", "a", "b", "bytes"), convs.select("conv_id", "h", "took", "len"),
                      "conv_id", hot, F.xxhash64("pos"))
    cols = ("conv_id", "pos", "len", "a", "b", "bytes")
    rows = heads.select(*cols).unionByName(own.withColumn("pos", F.col("took") + F.col("pos") - F.col("h")).select(*cols))
    return materialize(rows.withColumn("chunk", F.expr(f"pos div {CHUNK}")), "trie-rebuilt"), convs


def _running(df: DataFrame, aggs: dict[str, tuple], down: bool = False) -> DataFrame:
    """Running aggregates over a conversation's rows by pos, this row included (``down``: from the last
    row back): name → (column, aggregate, how two of its values combine). A conversation longer than a
    chunk is summed by chunk first, and its chunks get what the ones before them hold."""
    way = (lambda c: F.col(c).desc()) if down else F.col
    inside = Window.partitionBy("conv_id", "chunk").orderBy(way("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.where(F.col("len") > CHUNK).groupBy("conv_id", "chunk").agg(*[agg(col).alias(k) for k, (col, agg, _) in aggs.items()])
    off = sums.select(F.col("conv_id").alias("_c"), F.col("chunk").alias("_k"), *[agg(k).over(before).alias(f"_{k}") for k, (_, agg, _) in aggs.items()])
    out = df.withColumns({k: agg(col).over(inside) for k, (col, agg, _) in aggs.items()})
    out = out.join(off, (F.col("conv_id") == F.col("_c")) & (F.col("chunk") == F.col("_k")), "left")
    return out.withColumns({k: both(F.col(k), F.coalesce(F.col(f"_{k}"), F.col(k))) if both is F.least else both(F.col(k), F.coalesce(F.col(f"_{k}"), F.lit(0)))
                            for k, (_, _, both) in aggs.items()}).drop("_c", "_k", *[f"_{k}" for k in aggs])


def prefixes(rows: DataFrame) -> DataFrame:
    """One row per conversation and depth from 1: node (its digest), up (the digest one turn shorter)."""
    one = {"ta": F.xxhash64("pos", "a", "b"), "tb": F.xxhash64("b", "pos", "a")}
    xor = Column.bitwiseXOR
    r = _running(rows.withColumns(one), {"k1": (F.col("ta"), F.bit_xor, xor), "k2": (F.col("tb"), F.bit_xor, xor)})
    node = F.struct("k1", "k2")
    up = F.struct(F.col("k1").bitwiseXOR(F.col("ta")).alias("k1"), F.col("k2").bitwiseXOR(F.col("tb")).alias("k2"))
    return materialize(r.select("conv_id", "pos", "chunk", "len", (F.col("pos") + 1).alias("depth"), "bytes", node.alias("node"), up.alias("up")), "trie-prefixes")


def _cells(width: int) -> list[Column]:
    return [F.pmod(F.col(f"node.{k}"), F.lit(width)) + 1 for k in ("k1", "k2")]


def sketch(pre: DataFrame, max_cells: int = MAX_CELLS) -> tuple[DataFrame, int]:
    """The count-min sketch of the prefix digests as pages of bits (line, page, bits), a bit set where a
    counter holds two or more, and the number of counters a row."""
    width = min(max_cells, max(PAGE, 1 << (CELLS_PER_PREFIX * pre.count()).bit_length()))
    both = F.explode(F.array(*[F.struct(F.lit(i).alias("line"), c.alias("cell")) for i, c in enumerate(_cells(width))]))
    counters = pre.select(both.alias("s")).groupBy("s.line", "s.cell").agg(F.count(F.lit(1)).alias("n"))
    pages = (counters.where("n > 1").groupBy("line", F.bitmap_bucket_number("cell").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")))
    return materialize(pages, "trie-sketch"), width


def screen(pre: DataFrame, pages: DataFrame, width: int) -> DataFrame:
    """``pre`` with kind: shared (the estimates up to here are all above one), edge (the first proven
    singleton) or tail (behind it)."""
    more = pre
    for i, cell in enumerate(_cells(width)):
        page = F.broadcast(pages.where(F.col("line") == i).select(F.col("page").alias(f"p{i}"), F.col("bits").alias(f"b{i}")))
        more = more.withColumn("cell", cell).join(page, F.bitmap_bucket_number("cell") == F.col(f"p{i}"), "left")
        bit = F.bitmap_bit_position("cell")
        byte = F.conv(F.hex(F.substring(F.col(f"b{i}"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        more = more.withColumn(f"two{i}", F.coalesce(F.getbit(byte, (bit % 8).cast("int")), F.lit(0)).cast("int")).drop(f"p{i}", f"b{i}", "cell")
    more = more.withColumn("two", F.least("two0", "two1")).drop("two0", "two1")
    r = _running(more, {"all_two": (F.col("two"), F.min, F.least), "ones": (1 - F.col("two"), F.sum, lambda a, b: a + b)})
    kind = F.when(F.col("all_two") == 1, "shared").when((F.col("ones") == 1) & (F.col("two") == 0), "edge").otherwise("tail")
    return materialize(r.withColumn("kind", kind).drop("two", "all_two", "ones"), "trie-screened")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings, which arrive in order, with commas between."""
    key, sha = None, None

    def done():
        return pa.RecordBatch.from_pylist([{"node": {"k1": key[0], "k2": key[1]}, "sha": sha.hexdigest()}], _FOLDED)
    for batch in batches:
        for k1, k2, ids in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["ids"].to_pylist()):
            if key != (k1, k2):
                if key is not None:
                    yield done()
                key, sha = (k1, k2), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if key is not None:
        yield done()


_FOLDED = pa.schema([("node", pa.struct([("k1", pa.int64()), ("k2", pa.int64())])), ("sha", pa.string())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, sha): SHA-256 of the conversation ids of each node, ascending, comma-joined. ``ends`` is
    (node, conv_id). Ids become strings of IDS each in parallel; only nodes with several strings are
    streamed through one hash each."""
    placed = ordered(ends, ["node", "conv_id"])
    strings = (placed.groupBy("node", "_part", F.expr(f"_row div {IDS}").alias("piece"))
               .agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    strings = materialize(strings, "trie-ends")
    many = strings.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("ids").alias("only"))
    single = many.where("m = 1").select("node", F.sha2("only", 256).alias("sha"))
    several = strings.join(many.where("m > 1").select("node"), "node").select("node", "node.k1", "node.k2", "_part", "piece", "ids")
    folded = (several.repartition("node").sortWithinPartitions("node", "_part", "piece").select("k1", "k2", "ids")
              .mapInArrow(_fold, "node struct<k1:bigint,k2:bigint>, sha string"))
    return single.unionByName(folded)


def trie(turns: DataFrame, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; see the module and COLUMNS."""
    rows, convs = rebuild(turns_in_order(turns))
    pre = prefixes(rows)
    pages, width = sketch(pre, max_cells)
    kinds = screen(pre, pages, width)
    none = F.sha2(F.lit(""), 256)
    alone = F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none)
    n = lambda c: F.lit(c).cast("long")
    own = {"n_convs": n(1), "n_children": (F.col("depth") < F.col("len")).cast("long"), "n_leaves": n(1), "saved_tokens": n(0), "ends_sha256": alone}
    tails = kinds.where("kind = 'tail'").withColumns({"parent_conv_id": F.col("conv_id"), **own}).select(*COLUMNS)

    # the possibly shared prefixes, grouped exactly
    shared, edges = kinds.where("kind = 'shared'"), kinds.where("kind = 'edge'")
    nodes = materialize(shared.groupBy("node").agg(
        F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("depth") == F.col("len")).alias("ending"),
        F.min("depth").alias("depth"), F.min("up").alias("up")), "trie-nodes")
    hot = nodes.where(F.col("members") * HOT_SHARE > nodes.agg(F.sum("members")).scalar()).select("node")
    about = nodes.select("node", "rep", (F.col("members") == F.col("ending")).alias("childless"))
    met = salted_join(shared.select("conv_id", "pos", "chunk", "len", "bytes", "node"), about, "node", hot, F.xxhash64("conv_id"))
    first = F.col("conv_id") == F.col("rep")
    path = met.select("conv_id", "pos", "chunk", "len", "node", F.when(first, n(0)).otherwise(F.col("bytes")).alias("saved"),
                      (first & F.col("childless")).cast("long").alias("leaf"))
    path = materialize(path.unionByName(edges.select("conv_id", "pos", "chunk", "len", F.lit(None).cast("struct<k1:bigint,k2:bigint>").alias("node"),
                                                     n(0).alias("saved"), n(1).alias("leaf"))), "trie-paths")
    add = lambda a, b: a + b
    below = _running(path, {"saved_below": (F.col("saved"), F.sum, add), "leaves_below": (F.col("leaf"), F.sum, add)}, down=True)
    children = edges.select("up").unionByName(nodes.select("up"))
    parts = (below.where("node IS NOT NULL").select("node", "saved_below", "leaves_below", n(0).alias("child"))
             .unionByName(children.select(F.col("up").alias("node"), n(0).alias("saved_below"), n(0).alias("leaves_below"), n(1).alias("child"))))
    sums = parts.groupBy("node").agg(F.sum("saved_below").alias("saved_tokens"), F.sum("leaves_below").alias("n_leaves"), F.sum("child").alias("n_children"))
    ends = ends_digests(shared.where("depth = len").select("node", "conv_id").unionByName(convs.where("len = 0").select(F.expr(ROOT).alias("node"), "conv_id")))
    sums = materialize(sums.join(ends, "node", "full").withColumn("ends_sha256", F.coalesce("sha", none)).drop("sha"), "trie-sums")

    # parents: a child row (an edge, or a shared node) finds the smallest member one level up
    smallest = convs.agg(F.min("conv_id")).scalar()
    named = nodes.select(F.col("node").alias("up"), F.col("rep").alias("parent_conv_id"))

    def under(df: DataFrame, what: str) -> DataFrame:
        j = salted_join(df, named, "up", hot.withColumnRenamed("node", "up"), F.xxhash64(what), "left")
        return j.withColumn("parent_conv_id", F.when(F.col("depth") == 1, smallest).otherwise(F.col("parent_conv_id")))
    edge_nodes = under(edges.select("conv_id", "depth", "len", "up"), "conv_id").withColumns(own).select(*COLUMNS)
    inner = under(nodes.select("node", "rep", "members", "depth", "up"), "node").join(sums, "node")
    inner = inner.withColumnsRenamed({"rep": "conv_id", "members": "n_convs"}).select(*COLUMNS)

    totals = path.agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"))
    at_root = sums.where(F.col("node") == F.expr(ROOT)).agg(F.max("n_children").alias("kids"), F.max("ends_sha256").alias("ends"))
    root = (convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
            .withColumns({"depth": n(0), "parent_conv_id": F.lit(None).cast("long"), "n_children": F.coalesce(at_root.select("kids").scalar(), n(0)),
                          "n_leaves": F.greatest(n(1), F.coalesce(totals.select("leaves").scalar(), n(0))),
                          "saved_tokens": F.coalesce(totals.select("saved").scalar(), n(0)),
                          "ends_sha256": F.coalesce(at_root.select("ends").scalar(), none)}).select(*COLUMNS))
    return root.unionByName(inner).unionByName(edge_nodes).unionByName(tails)
