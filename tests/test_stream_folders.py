"""T2 over tables that are folders of part files, as large tables are."""
import pytest

from labelforge.session import scratch_path
from labelforge.streaming import jobs as J

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "x")]


def distinct(spark, root, rows, parts, glob="documents.parquet"):
    path = f"{root}/{glob.replace('*', 's')}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.repartition(parts).write.parquet(path)
    spark.createDataFrame([(9, "other table")], "doc_id bigint, text string").write.parquet(f"{root}/labels.parquet")
    avoid = spark.createDataFrame([("x",)], "query string")
    out = J.stream_distinct(spark, str(root), docs.schema, "text", avoid, scratch_path(spark, "sink"), scratch_path(spark, "ckpt"), glob=glob)
    assert out.columns == ["query"]
    return [r.query for r in out.collect()]


@pytest.mark.parametrize("glob", ["documents.parquet", "document*.parquet"])
def test_a_folder_of_part_files_is_read(spark, tmp_path, glob):
    assert sorted(distinct(spark, tmp_path, ROWS, 3, glob), key=str) == [None, "a", "b"]


def test_one_file_is_read(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    out = J.stream_distinct(spark, str(tmp_path), "doc_id bigint, text string", "text", spark.createDataFrame([("x",)], "query string"),
                            scratch_path(spark, "sink"), scratch_path(spark, "ckpt"), glob="documents.parquet")
    assert sorted([r.query for r in out.collect()], key=str) == [None, "a", "b"]


def test_nothing_left_is_an_empty_table(spark, tmp_path):
    assert distinct(spark, tmp_path / "a", [(6, "x")], 1) == []
    assert distinct(spark, tmp_path / "b", [], 1) == []
