"""Scalar text functions (F1, F2, F5, F6) as Column expressions.

Regexes are written so that Java's engine (Spark) and RE2 agree on them: explicit character
classes instead of \\s and \\b, no look-around, ``\\z`` for end of text.
"""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The characters Python's str.strip() removes (str.isspace), as one regex class.
PY_SPACE_CLASS = (
    r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters as a plain string, for btrim (which only looks at the two ends).
PY_SPACE_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                                           *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# ASCII whitespace used to split text into words.
WORD_SPLIT = r"[\t\n\x0B\f\r ]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remove_question_marks(q) -> Column:
    """drop every '?'; a null (non-string) query becomes ''."""
    return F.coalesce(F.replace(_c(q), F.lit("?"), F.lit("")), F.lit(""))


def py_strip(t) -> Column:
    """Python str.strip(): all outer whitespace, Unicode included (``btrim`` reads only the
    ends of the text, a regex would scan all of it)."""
    return F.btrim(_c(t), F.lit(PY_SPACE_CHARS))


def strip_trailing_qmark(t) -> Column:
    """strip ONE trailing '?', then outer whitespace (so 'ab? ' keeps its '?')."""
    c = _c(t)
    return py_strip(F.when(c.endswith("?"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c))


def fill_template(template, value) -> Column:
    """replace '{}' in a template with a value."""
    tpl = F.lit(template) if isinstance(template, str) else template
    return F.replace(tpl, F.lit("{}"), _c(value))


def words(t) -> Column:
    """Words of a text: split the trimmed text on runs of ASCII whitespace."""
    return F.split(py_strip(t), WORD_SPLIT)


def word_count(t) -> Column:
    """Number of words; blank text counts 0."""
    s = py_strip(t)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, WORD_SPLIT)))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_for_pieces(t) -> Column:
    """NFKC (Arrow-batched pandas UDF: Spark has no NFKC), collapse runs of spaces,
    then mark each word start with '▁' as a word-piece pre-tokeniser does."""
    s = F.regexp_replace(_nfkc(_c(t)), " {2,}", " ")
    return F.concat(F.lit("▁"), F.replace(s, F.lit(" "), F.lit("▁")))
