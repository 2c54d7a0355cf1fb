"""Records that are not lines: unquoted CSV with escapes (S6), JSON arrays (S3) and the label documents of
groups (S9), all read in splits by Spark's text source, so one large file is many tasks and any store Spark reads will do.

S6: a line break inside a field stands behind the escape character, so a record may run over several
lines, and a split may begin inside one. Each split joins the lines it has; only its first record and an
unfinished last one depend on its neighbours. These edges, two rows a split at most, are put together by
file and offset; all other records never leave their task.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_PIECES = "file string, block bigint, part int, value string, closed boolean, edge boolean"
_PIECE_TYPES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("value", pa.string()), ("closed", pa.bool_()), ("edge", pa.bool_())])
ROWS = 1024  # records handed on at once


def _goes_on(line: str, escape: str) -> bool:
    """Whether the line break behind ``line`` is escaped."""
    return (len(line) - len(line.rstrip(escape))) % 2 == 1


def _pieces(batches: Iterator[pa.RecordBatch], escape: str) -> Iterator[pa.RecordBatch]:
    """Lines of whole splits, in file order → records, and the open ends of each split (part 0 and 1)."""
    here, first, buf, out = None, True, [], []

    def take(closed: bool) -> None:
        nonlocal first, buf
        out.append((*here, 0 if first else 1, "\n".join(buf), closed, first or not closed))
        first, buf = False, []

    for batch in batches:
        for value, file, block in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, block) != here:
                if buf:
                    take(False)
                here, first = (file, block), True
            buf.append(value)
            if not _goes_on(value, escape):
                take(True)
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PIECE_TYPES)], schema=_PIECE_TYPES)
                out = []
    if buf:
        take(False)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _PIECE_TYPES)], schema=_PIECE_TYPES)


def escaped_records(spark: SparkSession, path: str, escape: str = "\\", header: str | None = None) -> DataFrame:
    """(value): the records of the files under ``path``. ``header`` is dropped where it is the first record
    of the first file. The files are scanned twice, the second time for the edges of the splits."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = lines.mapInArrow(lambda bs: _pieces(bs, escape), _PIECES)
    edges = pieces.where("edge")
    w = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("record", F.coalesce(F.sum(F.col("closed").cast("long")).over(w), F.lit(0)))
    joined = (edges.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "part", "value"))).alias("p"))
              .select("file", "record", F.array_join("p.value", "\n").alias("value")))
    if header is not None:
        first = lines.agg(F.min("file")).scalar()
        joined = joined.where(~((F.col("record") == 0) & (F.col("value") == header) & (F.col("file") == first)))
    return pieces.where("NOT edge").select("value").unionByName(joined.select("value"))


def _fields(batches: Iterator[pa.RecordBatch], names: list[str], sep: str, escape: str) -> Iterator[pa.RecordBatch]:
    token = re.compile(f"{re.escape(escape)}(.)|({re.escape(sep)})|([^{re.escape(escape + sep)}]+|.)", re.S)
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for line in batch.column(0).to_pylist():
            row, cur = [], []
            for m in token.finditer(line):
                if m[2]:
                    row.append("".join(cur))
                    cur = []
                else:
                    cur.append(m[1] or m[3])
            row.append("".join(cur))
            if len(row) != len(names):
                raise ValueError(f"a record of {len(row)} fields, {len(names)} expected: {line[:200]!r}")
            for c, v in zip(cols, row):
                c.append(v or None)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=names)


def read_unquoted(spark: SparkSession, path: str, schema: str | StructType, sep: str = ",", escape: str = "\\",
                  header: bool = True) -> DataFrame:
    """S6 source: the table that ``unquoted_csv_line`` and ``write_unquoted_lines`` wrote. An empty
    field is null, as in the CSV reader; a record with another number of fields stops the job."""
    sch = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    records = escaped_records(spark, path, escape, sep.join(sch.names) if header else None)
    rows = records.mapInArrow(lambda bs: _fields(bs, sch.names, sep, escape), ", ".join(f"`{n}` string" for n in sch.names))
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in sch])


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON strings of one task → the lines of one JSON array, an element a line."""
    last = None
    for batch in batches:
        lines = []
        for v in batch.column(0).to_pylist():
            lines.append("[" if last is None else f"  {last},")
            last = v
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([f"  {last}", "]"])], names=["value"])


def write_json_arrays(df: DataFrame, col: str, order: str, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """S3 sink: a text column as JSON arrays of strings in ``order``, one array a file, an element a line;
    streamed, so a task holds one element. ``files`` fixes their number. Nulls are left out."""
    text = df.where(F.col(col).isNotNull())
    ranged = text.repartitionByRange(files, order) if files else text.repartitionByRange(order)
    js = F.to_json(F.array(F.col(col)))
    (ranged.sortWithinPartitions(order).select(F.substring(js, F.lit(2), F.length(js) - 2).alias("value"))
     .mapInArrow(_array_lines, "value string").write.mode(mode).text(path))


def _label_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, head, chunk labels) in group and chunk order → the lines of one JSON document a group."""
    here = None
    for batch in batches:
        out = []
        for grp, head, labels in zip(*[c.to_pylist() for c in batch.columns]):
            if here is None or here[0] != grp:
                if here is not None:
                    out.append((here[0], "]}"))
                out.append((grp, head[:-1] + ', "labels": ['))
                out.append((grp, labels))
            else:
                out.append((grp, "," + labels))
            here = (grp,)
        yield pa.RecordBatch.from_pylist([{"grp": g, "value": v} for g, v in out], _GROUP_LINE)
    if here is not None:
        yield pa.RecordBatch.from_pylist([{"grp": here[0], "value": "]}"}], _GROUP_LINE)


_GROUP_LINE = pa.schema([("grp", pa.string()), ("value", pa.string())])


def write_group_documents(meta: DataFrame, chunks: DataFrame, path: str, grp: str = "grp", mode: str = "overwrite") -> None:
    """S9 sink: one JSON document per group, in a folder of its own (``grp=...``): the columns of ``meta``
    (one row a group) and ``labels``, the group's whole ordered label list, a line per chunk.

    ``chunks`` is (grp, chunk, labels: one digit a label), as ``groups.label_chunks`` makes them. A
    group's document is written by one task, as a file is, but streamed: a task holds a chunk, never
    a group. A group without labels gets no document."""
    head = meta.select(F.col(grp).alias("_g"), F.to_json(F.struct(*[F.col(c) for c in meta.columns])).alias("head"))
    rows = chunks.join(head, F.col(grp) == F.col("_g")).select(F.col(grp).cast("string").alias("grp"), "head", "chunk", F.array_join(F.split("labels", ""), ",").alias("labels"))
    (rows.repartition("grp").sortWithinPartitions("grp", "chunk").select("grp", "head", "labels")
     .mapInArrow(_label_lines, "grp string, value string").write.mode(mode).partitionBy("grp").text(path))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole splits → (grp, block, line: its number in the split, n: its labels, labels)."""
    here, line = None, 0
    for batch in batches:
        out = []
        for value, grp, block in zip(*[c.to_pylist() for c in batch.columns]):
            here, line = ((grp, block), 0) if here != (grp, block) else (here, line + 1)
            digits = value.replace(",", "")
            if digits.isdigit():
                out.append({"grp": grp, "block": block, "line": line, "n": len(digits), "labels": digits})
        yield pa.RecordBatch.from_pylist(out, _LABEL_LINE)


_LABEL_LINE = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("n", pa.int64()), ("labels", pa.string())])


def read_group_labels(spark: SparkSession, path: str) -> DataFrame:
    """(grp, pos, y): the labels of the documents of ``write_group_documents``, in order from 0. Files are
    read in splits; a line's first place comes from the counts of the lines before it."""
    lines = (spark.read.schema("value string, grp string").option("basePath", path).text(path)
             .select("value", F.col("grp"), F.col("_metadata.file_block_start").alias("block")))
    rows = lines.mapInArrow(_numbered, "grp string, block long, line long, n long, labels string")
    inside = Window.partitionBy("grp", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("grp", "block").agg(F.sum("n").alias("m")).withColumn("off", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    at = rows.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(splits, ["grp", "block"])
    return at.select("grp", (F.col("off") + F.col("at")).alias("start"), F.posexplode(F.split("labels", ""))).where("col <> ''").select(
        "grp", (F.col("start") + F.col("pos")).alias("pos"), F.col("col").cast("int").alias("y"))


def read_json_arrays(spark: SparkSession, path: str, name: str = "query") -> DataFrame:
    """S3 source: files that hold one JSON array of strings each, on one line or many → one row per
    string. A string has no raw line break, so every line is read by itself and large files split; a
    line that is no part of such an array stops the job."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    inner = F.regexp_replace(F.regexp_replace("value", r"^\s*\[?\s*,?", ""), r",?\s*\]?\s*$", "")
    parsed = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>", {"mode": "FAILFAST"})
    return lines.select(F.explode(parsed).alias(name))
