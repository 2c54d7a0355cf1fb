"""Restartable row-wise jobs (T1) and distinct accumulation over arriving rounds.

T1, batch form: rows carry a ``batch_id``; consecutive batches form waves, each written by its own
Spark job to its own folder (``wave=<first>_<last>``) through the commit protocol. A rerun lists
the committed folders, skips their batches and redoes only the others.

T2: a Structured Streaming query over a folder of arriving files: stream–static left-anti join
with the avoid list, then ``dropDuplicates`` on the text, with an ``availableNow`` trigger and a
checkpoint in the shared folder. The dedupe state has no watermark on purpose — the collected
set must be complete — so it grows with the number of distinct texts (kept in the state store,
spilled to the checkpoint, not in driver memory).
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelforge.operators.translation import consolidate
from labelforge.session import scratch_path

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # state on disk, not on the heap
WAVE_BATCHES = 1024     # batches that one job processes and commits together
FILES_PER_TRIGGER = 64  # arrived files that one micro-batch takes


def finished_ranges(spark: SparkSession, out: str) -> list[tuple[int, int]]:
    """(first, last) batch of the committed waves under ``out``, neighbours merged: a directory
    listing, no result is read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(out)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for st in fs.listStatus(root):
        m = re.fullmatch(r"wave=(\d+)_(\d+)", st.getPath().getName())
        if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            found.append((int(m[1]), int(m[2])))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def run_batches(work: DataFrame, process: Callable[[DataFrame], DataFrame], out: str,
                result_schema: str, batch: str = "batch_id", wave_batches: int = WAVE_BATCHES) -> int:
    """Process the batches of ``work`` not yet committed under ``out``; returns how many rows
    were sent to ``process`` (0 on a rerun after completion).

    The open rows are written once, ordered by batch, then taken in waves of ``wave_batches``
    consecutive batches. A wave is one Spark job with its own commit and its own folder, so a
    failure loses the wave it happens in and no earlier one. Batch ids must be dense (W2)."""
    spark = work.sparkSession
    todo = work
    for first, last in finished_ranges(spark, out):
        todo = todo.where(~F.col(batch).between(first, last))
    staged = scratch_path(spark, "t1-work")
    todo = todo.withColumn("_wave", F.expr(f"`{batch}` div {int(wave_batches)}"))
    todo.repartitionByRange(F.col(batch)).write.partitionBy("_wave").parquet(staged)
    todo = spark.read.schema(todo.schema).parquet(staged)
    waves = todo.groupBy("_wave").agg(F.min(batch).alias("first"), F.max(batch).alias("last"), F.count(F.lit(1)).alias("n"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # calls made at a time; AQE leaves a stated number alone
    sent = 0
    for w in waves.orderBy("_wave").collect():  # one row per wave
        rows = todo.where(F.col("_wave") == w["_wave"]).drop("_wave").repartition(tasks, batch)
        write_wave(process(rows), out, f"{w['first']}_{w['last']}")
        sent += w["n"]
    return sent


def write_wave(res: DataFrame, out: str, wave: str) -> None:
    """One wave's results in a folder of its own; a retry replaces it as a whole."""
    res.write.mode("overwrite").json(f"{out.rstrip('/')}/wave={wave}")


def stream_batches(spark: SparkSession, inbox: str, schema, process: Callable[[DataFrame], DataFrame],
                   out: str, checkpoint: str, files_per_trigger: int = FILES_PER_TRIGGER) -> int:
    """T1, streaming form: work rows arrive as files under ``inbox``; each run processes the
    files not yet recorded in ``checkpoint`` (trigger availableNow), at most
    ``files_per_trigger`` at a time, and writes each micro-batch to the folder of its number from
    ``foreachBatch``. One replayed after a failure rewrites that folder, so the output stays
    exactly-once, and earlier ones are kept. Returns the number of rows processed by this run."""
    seen = []

    def each(df: DataFrame, epoch_id: int) -> None:
        n = df.count()
        if n:
            write_wave(process(df), out, f"epoch-{epoch_id}")
        seen.append(n)

    q = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(inbox)
         .writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return sum(seen)


def read_results(spark: SparkSession, out: str, result_schema: str, key: str = "row_id",
                 batch: str = "batch_id") -> DataFrame:
    """All batch outputs as one table, one row per id (the latest batch wins, Q10)."""
    res = spark.read.schema(f"{result_schema}, {batch} long").json(out).drop("wave")
    return consolidate(res, key, (batch,))


def stream_rounds(spark: SparkSession, inbox: str, schema, text: str, round_col: str, out: str, checkpoint: str,
                  files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A22 over arriving files: every run takes the files that are new under ``inbox`` and returns the
    progress so far (``round_progress``).

    The state lies on disk, in a folder per micro-batch: the batch folded to (digest, round, rows), read
    from the input once, and the digests not seen in earlier batches with their first round. A batch replayed
    after a failure rewrites its own folders and looks at earlier ones only, so nothing counts twice.
    Rounds arrive in order; a text seen first in one batch belongs to its smallest round there."""
    def folder(step: str, epoch: int) -> str:
        return f"{out.rstrip('/')}/{step}/epoch={epoch:08d}"

    def each(df: DataFrame, epoch: int) -> None:
        digest = F.coalesce(F.sha2(F.col(text), 256), F.lit("null"))  # a missing text is one text
        df.groupBy(digest.alias("digest"), F.col(round_col).cast("long").alias("round")).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(folder("arrived", epoch))
        here = spark.read.parquet(folder("arrived", epoch)).groupBy("digest").agg(F.min("round").alias("round"))
        earlier = _epochs(spark, f"{out.rstrip('/')}/seen", epoch)
        if earlier:
            here = here.join(spark.read.parquet(*earlier).select("digest"), "digest", "left_anti")
        here.write.mode("overwrite").parquet(folder("seen", epoch))

    q = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(inbox).select(text, round_col)
         .writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return round_progress(spark, out)


def _epochs(spark: SparkSession, root: str, before: int) -> list[str]:
    """The committed micro-batch folders under ``root`` with a smaller number (a listing, no job)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return []
    found = [st.getPath() for st in fs.listStatus(path(root))]
    return [p.toString() for p in found if (m := re.fullmatch(r"epoch=(\d+)", p.getName())) and int(m[1]) < before and fs.exists(path(p, "_SUCCESS"))]


def round_progress(spark: SparkSession, out: str) -> DataFrame:
    """(round, rows, new, collected) of what ``stream_rounds`` has taken in so far; one row a round."""
    arrived = spark.read.schema("digest string, round long, rows long, epoch string").parquet(f"{out.rstrip('/')}/arrived")
    seen = spark.read.schema("digest string, round long, epoch string").parquet(f"{out.rstrip('/')}/seen")
    new = seen.groupBy("round").agg(F.count(F.lit(1)).alias("new"))
    w = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (arrived.groupBy("round").agg(F.sum("rows").alias("rows")).join(new, "round", "left").fillna(0, ["new"])
            .withColumn("collected", F.sum("new").over(w)).select("round", "rows", "new", "collected"))


def stream_distinct(spark: SparkSession, source_dir: str, schema, text: str, avoid: DataFrame,
                    sink: str, checkpoint: str, avoid_col: str = "query", glob: str | None = None) -> DataFrame:
    """Distinct texts over all files that have arrived in ``source_dir``, minus the avoid
    list; runs to completion (availableNow) and returns the sink as a static table. ``glob`` names the
    entries of the folder that are read: files, or folders of part files."""
    if glob:  # a pattern in any case: a stream takes a plain path for a folder
        source_dir = f"{source_dir.rstrip('/')}/{glob if re.search(r'[*?{[]', glob) else f'[{glob[0]}]{glob[1:]}'}"
    stream = spark.readStream.schema(schema).parquet(source_dir).select(F.col(text).alias("query"))
    a = avoid.select(F.col(avoid_col).alias("query")).distinct()
    # the state holds a digest per text, not the text
    out = (stream.join(a, "query", "left_anti").withColumn("_digest", F.sha2("query", 256))
           .dropDuplicates(["_digest"]).drop("_digest"))
    # a query keeps the provider it started with; the session's own setting comes back afterwards
    old = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        q = (out.writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink))
        q.awaitTermination()
    finally:
        spark.conf.unset(STATE_PROVIDER) if old is None else spark.conf.set(STATE_PROVIDER, old)
    if not _exists(spark, sink):  # nothing has arrived
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(sink)  # the schema is stated: the sink may hold no file


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
