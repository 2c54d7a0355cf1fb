"""Sampling and splitting (D1-D6, U4), deterministic on the order ``md5(seed:id), id``."""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelforge.operators.position import hash_key, key_position
from labelforge.session import written

REPLICATE_BLOCK = 4096


def _first_part(n: Column, ratio: float) -> Column:
    """int(ratio * n) + 1, clamped at n (the reference's split sizes)."""
    return F.least(n, F.floor(F.lit(ratio) * n).cast("long") + F.lit(1))


STEPS = (4, 32)  # leading hash characters that the steps of a selection look at


def hash_cuts(df: DataFrame, id_col: str, seed, ranks: Sequence, partition_by: Sequence[str] = ()) -> tuple[Column, DataFrame]:
    """Order statistics of the seeded shuffle order without ordering rows: for each of ``ranks``
    (functions of the row count n) the hash of the row at that place, per group.

    Counts by the first hash characters tell in which bucket a rank lies; only that bucket's rows are
    counted by all characters (about rows / 16^4 hashes a cut).
    Returns the hash as an expression on ``df`` and the table of cuts: group columns, _n, _cut0, _cut1 ...
    (null: no row at that place). The keys of ``df`` are written once; rows that share an id share a
    hash, and a null id's hash sorts first."""
    h, parts = F.coalesce(hash_key(seed, id_col), F.lit("")), list(partition_by)
    keys = written(df.select(*parts, h.alias("_h")), "split-keys")
    g = [F.col(c).alias(f"_g{i}") for i, c in enumerate(parts)]
    names = [f"_g{i}" for i in range(len(parts))]
    keys = keys.select(*g, "_h")
    totals = keys.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    want = [F.struct(F.lit(i).alias("cut"), r(F.col("_n")).cast("long").alias("rank")) for i, r in enumerate(ranks)]
    open_ = written(totals.select(*names, "_n", F.inline(F.array(*want))).where("rank < _n").withColumn("_p", F.lit("")), "split-ranks")
    at = 0
    for chars in STEPS:
        # the rows of the buckets that hold a cut, counted by a longer piece of the hash
        mine = keys.withColumnsRenamed({c: f"k{c}" for c in names}).withColumn("_q", F.substring("_h", 1, at) if at else F.lit(""))
        same = [F.col("_q") == F.col("_p"), *[F.col(f"k{c}").eqNullSafe(F.col(c)) for c in names]]
        counts = (mine.join(open_.drop("_n"), same).groupBy(*names, "cut", "rank", F.substring("_h", 1, chars).alias("_next"))
                  .agg(F.count(F.lit(1)).alias("_m")))
        w = Window.partitionBy(*names, "cut").orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        found = counts.withColumn("_before", F.coalesce(F.sum("_m").over(w), F.lit(0))).where("_before <= rank and rank < _before + _m")
        open_ = found.select(*names, "cut", (F.col("rank") - F.col("_before")).alias("rank"), F.col("_next").alias("_p"), F.lit(0).alias("_n"))
        open_ = open_ if chars == STEPS[-1] else written(open_, "split-ranks")
        at = chars
    cuts = [F.max(F.when(F.col("cut") == i, F.col("_p"))).alias(f"_cut{i}") for i in range(len(ranks))]
    return h, written(open_.groupBy(*names).agg(*cuts), "split-cuts")


def _below(df: DataFrame, id_col: str, seed, ranks: Sequence, partition_by: Sequence[str], name: str, labels: Sequence[str]) -> DataFrame:
    """``df`` with ``name``: the label of the first rank that the row lies below, else the last one."""
    h, cuts = hash_cuts(df, id_col, seed, ranks, partition_by)
    names = [f"_g{i}" for i in range(len(partition_by))]
    if partition_by:
        df = df.join(cuts, [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(partition_by, names)], "left")
        at = [F.col(f"_cut{i}") for i in range(len(ranks))]
    else:
        at = [cuts.agg(F.max(f"_cut{i}")).scalar() for i in range(len(ranks))]
    out = F.lit(labels[-1])
    for cut, label in reversed(list(zip(at, labels))):
        out = F.when(cut.isNull() | (h < cut), F.lit(label)).otherwise(out)
    return df.withColumn(name, out).drop(*names, *[f"_cut{i}" for i in range(len(ranks))] if partition_by else [])


def exact_split(df: DataFrame, id_col: str, seed=666, ratio: float = 0.8, eval_ratio: float = 0.5,
                partition_by: Sequence[str] = (), name: str = "split",
                labels: tuple[str, str, str] = ("train", "eval", "test")) -> DataFrame:
    """In the seeded shuffle order, train = first int(0.8n)+1, eval = int(0.5m)+1 of the rest, test =
    rest. Two cut hashes per group decide every row where it stands: no row is sorted or moved. Rows
    that share an id get the same part, so the sizes are exact for unique ids. ``df`` is evaluated
    twice, the first time for its ids and groups only."""
    n_train = lambda n: _first_part(n, ratio)
    n_seen = lambda n: n_train(n) + _first_part(n - n_train(n), eval_ratio)
    return _below(df, id_col, seed, (n_train, n_seen), partition_by, name, labels)


def carve_validation(df: DataFrame, id_col: str, seed=0, ratio: float = 0.05,
                     name: str = "part") -> DataFrame:
    """D3: in the seeded shuffle order, the first max(1, int(0.05 n)) rows are internal validation."""
    size = lambda n: F.greatest(F.lit(1), F.floor(F.lit(ratio) * n).cast("long"))
    return _below(df, id_col, seed, (size,), (), name, ("val", "train"))


def replicate(df: DataFrame, times: Column | str, name: str = "copy",
              block: int = REPLICATE_BLOCK) -> DataFrame:
    """U4: emit each row ``times`` times with copy = 1..times.

    Two-level expansion: a row first becomes ceil(times/block) block rows, which are spread
    over the cluster by a shuffle, and each block then emits at most ``block`` copies. A single
    row asked to repeat a billion times therefore never lands in one task."""
    t = F.col(times) if isinstance(times, str) else times
    blocks = (df.withColumn("_t", t.cast("long")).filter(F.col("_t") > 0)
              .withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"),
                                                       F.ceil(F.col("_t") / block).cast("long") - 1))))
    spread = blocks.repartition(F.col("_blk"), F.xxhash64(*df.columns))  # by row: a class uses all partitions
    return (spread.withColumn(name, F.explode(F.sequence(
                F.col("_blk") * block + 1, F.least(F.col("_t"), (F.col("_blk") + 1) * block))))
            .drop("_t", "_blk"))


def draw_index(seed, cls, k, cnt) -> Column:
    """Deterministic draw in [0, cnt): first 60 bits of md5('seed:class:k') mod cnt."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), cls.cast("string"), k.cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 15), 16, 10).cast("long"), cnt)


def upsample_classes(df: DataFrame, label: str, id_col: str, seed=42) -> DataFrame:
    """Every class up to the largest: whole copies (max div cnt), then (max mod cnt) draws
    with replacement. Output adds ``copy`` (1.. for whole copies, 0 for draws) and ``draw``.
    ``upsampled_shuffle`` adds the final shuffle."""
    return _upsampled(df, label, id_col, seed)[0].select(*df.columns, "copy", "draw")


def _upsampled(df: DataFrame, label: str, id_col: str, seed) -> tuple[DataFrame, DataFrame]:
    """The upsampled rows with their class columns, and the classes (label, _cnt)."""
    p = key_position(df, id_col, partition_by=[label], name="_cpos", total="_cnt")
    classes = written(p.groupBy(label).agg(F.max("_cnt").alias("_cnt")), "classes")
    p = p.withColumn("_max", classes.agg(F.max("_cnt")).scalar())
    reps = F.floor(F.col("_max") / F.col("_cnt")).cast("long")
    rem = F.pmod(F.col("_max"), F.col("_cnt"))
    whole = replicate(p.withColumn("_reps", reps), "_reps").withColumn("draw", F.lit(None).cast("long"))
    # Draw k (1..rem) is emitted by the class row at position k-1 (rem < cnt), so the draws are
    # produced where the data is, then joined to the drawn row on (class, position).
    draws = (p.filter(F.col("_cpos") < rem)
             .select(F.col(label).alias("_dl"), (F.col("_cpos") + 1).alias("draw"), F.col("_cnt").alias("_dcnt"))
             .withColumn("_target", draw_index(seed, F.col("_dl"), F.col("draw"), F.col("_dcnt"))))
    drawn = (draws.join(p, F.col("_dl").eqNullSafe(F.col(label)) & (F.col("_target") == F.col("_cpos")))
             .withColumn("copy", F.lit(0).cast("long")))
    cols = [*df.columns, "copy", "draw", "_cpos", "_cnt", "_max"]
    return whole.select(*cols).unionByName(drawn.select(*cols)), classes


SHUFFLE_ROUNDS = 48


def permuted(i: Column, n: Column, seed, rounds: int = SHUFFLE_ROUNDS) -> Column:
    """The place of index ``i`` (0..n-1) in a seeded permutation of n places, computed from i alone.

    A swap-or-not shuffle: each round pairs every index i with (key - i) mod n and a hash bit of the pair
    decides whether the two change places, so every round is a permutation and so are all together, for
    any n. Nothing is sorted or collected, and a row's place is known before the row exists."""
    keys = [int(hashlib.md5(f"{seed}:key:{r}".encode()).hexdigest()[:15], 16) for r in range(rounds)]
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).cast("long").alias("k")) for r, k in enumerate(keys)])

    def step(at, s):
        other = F.pmod(F.pmod(s["k"], n) - at, n)
        swap = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), s["r"].cast("string"), F.greatest(at, other).cast("string"))), 1, 1) >= "8"
        return F.when(swap, other).otherwise(at)

    return F.aggregate(steps, i.cast("long"), step)


def upsampled_shuffle(df: DataFrame, label: str, id_col: str, seed=42, name: str = "position") -> DataFrame:
    """D4 in full: ``upsample_classes`` and the final shuffle, as each row's place 0..n-1 in a seeded
    permutation. Before the shuffle the classes lie end to end (label order, null first), in each the whole
    copies in id order, then the draws; that index is arithmetic on (copy, place in the class, draw), so no
    replicated row is sorted. Order by ``name`` (or range-partition on it) to read the shuffled set."""
    up, classes = _upsampled(df, label, id_col, seed)
    n = F.lit(classes.agg(F.count(F.lit(1)) * F.max("_cnt")).first()[0] or 1)  # two numbers of the class table
    ranks = key_position(classes.select(F.col(label).alias("_cl")), "_cl", name="_rank")
    at = F.when(F.col("draw").isNull(), (F.col("copy") - 1) * F.col("_cnt") + F.col("_cpos")).otherwise(
        F.floor(F.col("_max") / F.col("_cnt")) * F.col("_cnt") + F.col("draw") - 1)
    return (up.join(ranks, F.col(label).eqNullSafe(F.col("_cl")))
            .withColumn(name, permuted(F.col("_rank") * F.col("_max") + at, n, seed)).select(*df.columns, "copy", "draw", name))


def quota_rounds(df: DataFrame, query: str, round_col: str, target: int, max_rounds: int = 50,
                 avoid: DataFrame | None = None, avoid_col: str = "query") -> DataFrame:
    """Take whole rounds until the distinct count reaches ``target`` or ``max_rounds``.

    Per round: queries first seen in it (``new``), the running total before (``prior``) and
    after (``total``), and whether the round is taken: prior < target and round index < max."""
    q = df.select(F.col(query).alias("_q"), F.col(round_col).alias("round"))
    if avoid is not None:
        q = q.join(avoid.select(F.col(avoid_col).alias("_q")), "_q", "left_anti")
    first = q.groupBy("_q").agg(F.min("round").alias("round"))
    per_round = first.groupBy("round").agg(F.count(F.lit(1)).alias("new"))
    rounds = q.select("round").distinct()
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rounds.join(per_round, "round", "left").fillna(0, ["new"])
            .withColumn("total", F.sum("new").over(w))
            .withColumn("prior", F.col("total") - F.col("new"))
            .withColumn("idx", F.row_number().over(Window.orderBy("round")) - 1)
            .withColumn("kept", (F.col("prior") < target) & (F.col("idx") < max_rounds))
            .drop("idx"))

