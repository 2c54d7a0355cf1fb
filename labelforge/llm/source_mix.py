"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: all words are shared out by the sources' weights; a source stops at ``MOST`` times its own size
and the excess goes to the others by weight, until none is above (``targets``).

Schedule: the mix is a sequence of slots, one block of words each. The van der Corput points of a full
period are mapped through the cumulative slot counts of the sources: slot k has the point rev(k), k's
bits in reverse, and belongs to the source in whose interval that point lies. So every source has
exactly its slots, spread evenly over the whole sequence. As rev is its own inverse, a source finds its
slots from its interval and no range join is needed. Slots are ranked per source.

Blocks: a source's texts, shuffled by a seeded hash of the row, are laid end to end and cut into
blocks of ``BLOCK`` words (the source's last one may be shorter). The slot of rank r takes block
r mod n of the n blocks in pass r div n; the last slot of a source takes only the words still missing
from its target. So a source gives its target to the word, and no text is taken more than MOST times.

Scale: texts are read once, for word counts and hashes; slim rows are shuffled. Ranks and text
offsets come from range partitions of the composite key (source, hash), so a source with a third of all
rows fills many tasks; blocks and slots meet on (source, block), at most BLOCK pieces and MOST + 1
slots a key. The table of sources (one row each) is never collected: the driver sees totals only.

Defined cases: a null text has no words; texts without words are never taken, and a source of such
texts has target 0; sources are ordered by code point, null last; rows without doc_id and repeated rows
are mixed like all others; an empty table gives no rows. Only doc_id, source and text are read.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from labelforge.llm.store import materialize
from labelforge.llm.tokens import SPACE_WORDS, Words, text_chunks
from labelforge.operators.position import key_position, ordered

WEIGHTS = (1, 2, 3)  # by the source's rank, repeating
MOST = 3             # times a source's own size its target may be
BLOCK = 512          # words of a slot
SEED = 11
CHUNK = 4096         # points emitted by one row; rows of a running sum's bucket


@F.arrow_udf(LongType())
def n_words(text: pa.Array) -> pa.Array:
    """Words [^\\x20\\x09-\\x0D]+ of each text; a null has none."""
    out: list[int] = []
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    for a, b, data, offsets in text_chunks(batch, "text"):
        bounds = Words(data, offsets, SPACE_WORDS, lower=False).bounds
        out.extend((bounds[1:] - bounds[:-1]).tolist())
    return pa.array(out, pa.int64())


def _hash(doc_id: Column, text: Column, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), doc_id.isNull(), F.coalesce(doc_id.cast("string"), F.lit("")), text.isNull(), F.coalesce(text, F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size) → rank, weight, target. Each round fixes the sources whose share
    is above ``most`` times their size and shares what they leave among the others; it ends when a
    round fixes none. Rounds pass three totals through the driver; the arithmetic is exact."""
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = materialize(key_position(sizes, F.col("source").asc_nulls_last(), name="rank").withColumn("weight", w), "mix-sources")
    total, rest_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    rest = total = total or 0
    cap, big = F.col("source_size") * most, lambda c: c.cast("decimal(38,0)")
    while True:
        # above its cap: weight * rest / rest_weight > cap; a source once above stays so, as shares only rise
        above = big(F.col("weight")) * F.lit(rest).cast("decimal(19,0)") > big(cap) * F.lit(rest_weight or 0).cast("decimal(19,0)") if rest_weight else F.lit(True)
        capped, open_weight = s.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        now = (total - (capped or 0), open_weight or 0)
        if now == (rest, rest_weight) or not open_weight:
            break
        rest, rest_weight = now
    share = F.col("weight") * F.lit(float(rest)) / F.lit(float(rest_weight or 1))
    return s.withColumn("target", F.when(above, cap.cast("double")).otherwise(F.least(share, cap.cast("double"))))


def _starts(df: DataFrame, value: str, rank: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows of smaller ``rank`` (dense), in two levels."""
    b = df.withColumn("_b", F.expr(f"{rank} div {CHUNK}"))
    sums = b.groupBy("_b").agg(F.sum(value).alias("_v"))
    off = sums.select(F.col("_b").alias("_ob"), F.coalesce(F.sum("_v").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_b").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return (b.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(off, F.col("_b") == F.col("_ob"))
            .withColumn(name, F.col("_off") + F.col("_in")).drop("_b", "_ob", "_off", "_in"))


def reversed_bits(y: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(y), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def plan(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``targets`` with words (the target as whole words), n_blocks, passes (whole ones), rest (words of
    the last, partial pass), slots and first_point: the sources' intervals laid end to end."""
    words = F.least(F.round("target").cast("long"), F.col("source_size") * MOST)
    size = F.greatest("source_size", F.lit(1))
    s = sources.withColumns({"words": words, "n_blocks": F.expr(f"(source_size + {block - 1}) div {block}"), "size": size})
    s = s.withColumns({"passes": F.expr("words div size"), "rest": F.expr("words % size")})
    s = s.withColumn("slots", F.col("passes") * F.col("n_blocks") + F.expr(f"(rest + {block - 1}) div {block}")).drop("size")
    return materialize(_starts(s, "slots", "rank", "first_point"), "mix-plan")


def schedule(planned: DataFrame, block: int = BLOCK) -> DataFrame:
    """The slots of ``plan``: slot (its time), src (the source's rank), nth (rank among the source's
    slots), block, pass, tokens (words it takes)."""
    n = planned.agg(F.sum("slots")).first()[0] or 0
    bits = max(n - 1, 0).bit_length()
    last = F.col("first_point") + F.col("slots") - 1
    chunks = planned.where("slots > 0").withColumn("at", F.explode(F.sequence(F.expr(f"first_point div {CHUNK}"), F.expr(f"(first_point + slots - 1) div {CHUNK}"))))
    chunks = chunks.select(F.col("rank").alias("src"), "at", F.greatest("first_point", F.col("at") * CHUNK).alias("lo"),
                           F.least(last, F.col("at") * CHUNK + CHUNK - 1).alias("hi")).repartition("src", "at")
    points = chunks.select("src", F.explode(F.sequence("lo", "hi")).alias("y")).select("src", reversed_bits(F.col("y"), bits).alias("slot"))
    nth = key_position(points, "slot", ["src"], "nth")
    size = planned.select(F.col("rank").alias("_r"), "source_size", "n_blocks", "passes", "rest")
    b = nth.join(size, F.col("src") == F.col("_r")).withColumns({"block": F.expr("nth % n_blocks"), "pass": F.expr("nth div n_blocks")})
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("rest") - F.col("block") * block
    return b.select("slot", "src", "nth", "block", "pass", F.when(F.col("pass") == F.col("passes"), F.least(full, left)).otherwise(full).alias("tokens"))


def _streams(rows: DataFrame) -> DataFrame:
    """``rows`` (src, size > 0, h, h2, ...) with start: the words before it in its source's stream."""
    placed = ordered(rows, ["src", "h", "h2", "doc_id", "size"])
    w = Window.partitionBy("src").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    off = (placed.groupBy("src", "_part").agg(F.sum("size").alias("_v"))
           .select(F.col("src").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_off")))
    inside = Window.partitionBy("src", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(off, (F.col("src") == F.col("_s")) & (F.col("_part") == F.col("_p")))
            .withColumn("start", F.col("_off") + F.col("_in")).drop("_part", "_row", "_s", "_p", "_off", "_in", "h", "h2"))


def _pieces(streams: DataFrame, block: int) -> DataFrame:
    """Each row cut at the block edges: block, in_block (first word's place there), first (word of the
    row), len."""
    cut = streams.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    lo = F.greatest("start", F.col("block") * block)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return cut.withColumns({"in_block": lo - F.col("block") * block, "first": lo - F.col("start"), "len": hi - lo})


def _prepared(docs: DataFrame, block: int, keep_text: bool = False):
    text = [F.col("text")] if keep_text else []
    rows = materialize(docs.select("doc_id", "source", n_words("text").alias("size"), _hash(F.col("doc_id"), F.col("text"), SEED).alias("h"),
                                   _hash(F.col("doc_id"), F.col("text"), SEED + 1).alias("h2"), *text), "mix-rows")
    planned = plan(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), block)
    names = planned.select(F.col("source").alias("_name"), F.col("rank").alias("src"))
    rows = rows.join(names, F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    return rows, planned, schedule(planned, block), _pieces(_streams(rows.where("size > 0").drop("source")), block)


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, one row per piece of a text: slot and at (the piece's first word in the slot;
    both give the training order), source, pass, doc_id, first (word of the text), n_words and text (its
    words joined by spaces)."""
    _, planned, slots, pieces = _prepared(docs, block, keep_text=True)
    names = planned.select("source", F.col("rank").alias("src"))
    taken = F.least("len", F.col("tokens") - F.col("in_block"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return (slots.join(pieces, ["src", "block"]).withColumn("n_words", taken).where("n_words > 0").join(names, "src")
            .select("slot", F.col("in_block").alias("at"), "source", "pass", "doc_id", "first", "n_words",
                    F.array_join(F.slice(words, (F.col("first") + 1).cast("int"), F.col("n_words").cast("int")), " ").alias("text")))


def taken(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """What the mix takes of every row of ``docs``: doc_id, size, source_size, target, taken, source."""
    rows, planned, slots, pieces = _prepared(docs, block)
    part = F.greatest(F.lit(0), F.least("len", F.coalesce("tokens", F.lit(0)) - F.col("in_block")))  # no slot: nothing
    met = pieces.select("src", "block", "doc_id", "size", "start", "in_block", "len").join(slots.select("src", "block", "tokens"), ["src", "block"], "left")
    # start tells the rows of a source apart
    some = met.groupBy("src", "start", "doc_id", "size").agg(F.coalesce(F.sum(part), F.lit(0)).alias("taken")).select("doc_id", "src", "size", "taken")
    none = rows.where("size = 0").select("doc_id", "src", "size", F.lit(0).cast("long").alias("taken"))
    about = planned.select(F.col("rank").alias("src"), "source_size", "target", "source")
    return some.unionByName(none).join(about, "src").select("doc_id", "size", "source_size", "target", "taken", "source")
