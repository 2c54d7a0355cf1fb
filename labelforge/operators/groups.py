"""Named groups laid end to end: offsets (W4), global ids (W1 per group), the binned range join
back from a position to its group (J6), rows per group (A4) and ordered label chunks (A5)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelforge.operators.position import batch_id, key_position

RANGE_BINS = 4096
LABEL_CHUNK = 1024


def order_table(spark, order: Sequence[str], grp: str = "grp") -> DataFrame:
    """The declared group order as a tiny table (grp, ord)."""
    return spark.createDataFrame([(g, i) for i, g in enumerate(order)], f"{grp} string, ord int")


def group_offsets(df: DataFrame, order: Sequence[str], grp: str = "grp") -> DataFrame:
    """W4 + A4: (grp, ord, n, off) with off = running sum of n in the declared order.
    Groups of the order that have no rows keep n = 0."""
    counts = df.groupBy(grp).agg(F.count(F.lit(1)).alias("n"))
    o = order_table(df.sparkSession, order, grp)
    w = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (F.broadcast(o).join(counts, grp, "left").fillna(0, ["n"])
            .withColumn("off", F.sum("n").over(w) - F.col("n")))


def corpus_ids(df: DataFrame, order: Sequence[str], key: str, grp: str = "grp",
               name: str = "id") -> DataFrame:
    """Global id across groups laid out in ``order``: off(grp) + rank of ``key`` in the group. A row
    whose group isn't declared stops the job: it has no place in the order."""
    p = key_position(df, key, partition_by=[grp], name="_gpos")  # written: the offsets count the same rows
    offs = group_offsets(p, order, grp).select(grp, "ord", "off")
    undeclared = F.raise_error(F.concat(F.lit("group not in the declared order: "), F.coalesce(F.col(grp).cast("string"), F.lit("null"))))
    return (p.join(F.broadcast(offs), grp, "left")
            .withColumn(name, F.when(F.col("off").isNull(), undeclared.cast("long")).otherwise(F.col("off") + F.col("_gpos"))).withColumnRenamed("_gpos", "gpos")
            .drop("off"))


def range_join(points: DataFrame, pos: str, intervals: DataFrame, start: str = "off",
               length: str = "n", bins: int = RANGE_BINS) -> DataFrame:
    """Attach to each point the interval [start, start+length) holding it, as an equi-join.

    Intervals are cut at bin edges (bin width from a scalar subquery so there are about ``bins``
    bins in all); a point joins the pieces of its own bin and keeps the one that contains it."""
    hi = intervals.agg(F.max(F.col(start) + F.col(length))).scalar()
    width = F.greatest(F.lit(1), F.ceil(hi / F.lit(bins))).cast("long")
    iv = (intervals.filter(F.col(length) > 0)
          .withColumn("_w", width)
          .withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("_w")).cast("long"),
                                                    F.floor((F.col(start) + F.col(length) - 1)
                                                            / F.col("_w")).cast("long"))))
          .drop("_w"))
    pt = points.withColumn("_bin", F.floor(F.col(pos) / width).cast("long"))
    j = pt.join(iv, "_bin")
    return j.filter((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(start) + F.col(length))).drop("_bin")


def label_chunks(df: DataFrame, grp: str, pos: str, y: str, chunk: int = LABEL_CHUNK) -> DataFrame:
    """A5: the ordered label list of each group, as chunks of at most ``chunk`` labels
    (grp, chunk, labels) — never a whole group in one row."""
    return (df.withColumn("chunk", batch_id(pos, chunk))
            .groupBy(grp, "chunk")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(y).alias("y"))))
                 .alias("_l"))
            .select(grp, "chunk", F.concat_ws("", F.transform("_l", lambda x: x["y"].cast("string")))
                    .alias("labels")))
