"""Label maps (F3, F4) and the label-domain check (P5)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelforge.functions.text import py_strip

# Label ids of the binary task.
LABEL2ID = {"Chat": 0, "Search": 1}
ID2LABEL = {0: "Chat", 1: "Search"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label_to_id(label) -> Column:
    """Strict map (F4): exact 'Chat'/'Search' → 0/1, anything else null."""
    m = F.create_map(*[x for k, v in LABEL2ID.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(label)]


def id_to_label(i) -> Column:
    m = F.create_map(*[x for k, v in ID2LABEL.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(i)]


def normalize_label(label) -> Column:
    """str → strip → lower → id; null for anything outside the domain."""
    key = F.lower(py_strip(_c(label).cast("string")))
    return F.when(key == "chat", F.lit(0)).when(key == "search", F.lit(1))


def normalize_label_strict(label) -> Column:
    """P5 fatal form: like normalize_label but raises on a value outside the domain."""
    key = F.lower(py_strip(_c(label).cast("string")))
    return (F.when(key == "chat", F.lit(0)).when(key == "search", F.lit(1))
            .otherwise(F.raise_error(F.concat(F.lit("label outside the domain: "),
                                              F.coalesce(_c(label).cast("string"), F.lit("null"))))))
