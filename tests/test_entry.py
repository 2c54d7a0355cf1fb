import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from labelforge.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"split", "label", "n"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


FAST = ["d2_split_label_counts", "a2_dedupe_first", "p9_weak_labels", "a10_auc", "a13_overlapping_report",
        "a14_sif_pool", "j6_range_join", "d4_upsample_classes", "f8_pad_and_mask", "s6_unquoted_lines",
        "j5_error_table", "t2_stream_distinct"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    exp = con.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    cols = sorted(exp.columns)

    def norm(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, float):
            r = round(v, 4) + 0.0
            return repr(int(r)) if r.is_integer() else repr(r)
        return repr(v.item() if hasattr(v, "item") else v)

    def key(df):
        return sorted("|".join(norm(r[c]) for c in cols) for r in df.astype(object).to_dict("records"))
    assert key(got) == key(exp)
