"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule is a Boolean Column over one text. ``calibrate`` measures every rule on a bounded sample:
the share of rows it rejects and the seconds its evaluation takes. ``order_rules`` sorts by
rejections per cost, and ``verdict`` evaluates the rules in that order as one CASE WHEN: a row
that a rule rejects is never shown to the later ones. The kept set is the conjunction of all
rules, so it doesn't depend on the order; only the work does.

Edge cases: a null or empty text has no words; words, lines and windows are those of the whole
text however long; repeated rows get equal values; an empty table gives an empty result, with the
rules in the order given; any other column of the input is left alone.
"""
from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.store import materialize

SPACES = " \t\n\x0b\f\r"
SAMPLE_ROWS = 1000      # expected size of the sample that calibrates the cascade
SAMPLE_SEED = 7


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


# ------------------------------------------------------------------ measures of one text
def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the whole text; null has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+"))


def word_chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", "")).cast("long")


def lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def n_dup_lines(ls: Column) -> Column:
    return (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once even where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _low_bits(ws: Column) -> Column:
    """All ones in as many bits as a position in the text needs."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(ws)))) - F.lit(1)


def window_keys(ws: Column) -> Column:
    """One sorted long per 3-word window: its hash in the high bits, its position in the low ones.
    The position takes as many bits as the text needs (10 for 512 words), the hash the rest, so
    two different windows of one text meet with a probability around n²/2^54."""
    def keys(low):
        at = F.sequence(F.lit(0), F.size(ws) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
                           .bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    return F.when(F.size(ws) >= 3, F.sort_array(_let(_low_bits(ws), keys))).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(ws: Column, keys: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text, the first one included."""
    def covered(low):
        same = lambda a, b: F.coalesce(a.bitwiseXOR(b).between(F.lit(0), low), F.lit(False))  # noqa: E731 - equal but for the position
        again = F.filter(keys, lambda k, i: ((i > 0) & same(k, F.get(keys, i - 1))) | same(k, F.get(keys, i + 1)))
        at = F.transform(again, lambda k: k.bitwiseAND(low))
        return F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))
    return F.size(F.array_distinct(_let(_low_bits(ws), covered))).cast("long")


def measured(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the measures the rules read, under ``prefix``."""
    p, t = prefix, F.col(text)
    df = df.withColumn(f"{p}ws", words(t))
    ws = F.col(f"{p}ws")
    df = df.withColumns({f"{p}keys": window_keys(ws), f"{p}lines": lines(t)})
    return df.withColumns({
        f"{p}n_words": F.size(ws).cast("long"),
        f"{p}word_chars": word_chars(ws),
        f"{p}n_symbols": n_symbols(t),
        f"{p}n_lines": F.size(f"{p}lines").cast("long"),
        f"{p}n_dup_lines": n_dup_lines(F.col(f"{p}lines")),
        f"{p}n_repeat_words": n_repeat_words(ws, F.col(f"{p}keys")),
    }).drop(f"{p}ws", f"{p}keys", f"{p}lines")


# ------------------------------------------------------------------ rules
def base_rules(prefix: str = "") -> list[Rule]:
    c = lambda n: F.col(prefix + n)
    return [Rule("few_words", c("n_words") < 50),
            Rule("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words"))]


def method_rules(prefix: str = "") -> list[Rule]:
    """Wide limits after published web-corpus heuristics: they reject symbol tables, word lists
    without spaces and texts made of repeated lines, and leave ordinary prose alone."""
    c = lambda n: F.col(prefix + n)
    return [Rule("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
            Rule("short_words", c("word_chars") < 2 * c("n_words")),
            Rule("long_words", c("word_chars") > 15 * c("n_words")),
            Rule("dup_lines", (10 * c("n_dup_lines") > 3 * c("n_lines")) & (c("n_dup_lines") >= 3))]


# ------------------------------------------------------------------ the cascade
def sampled(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of the whole table, whatever its size, written once."""
    return materialize(df.sample(fraction=min(1.0, rows / max(1, df.count())), seed=SAMPLE_SEED), "cascade-sample")


def calibrate(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share of the sample it rejects, seconds on the sample) for every rule. Each rule is
    evaluated alone, twice, the faster run counting."""
    out = []
    for r in rules:
        best, share = float("inf"), 0.0
        for _ in range(2):
            t = time.perf_counter()
            row = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(r.rejects).alias("hit")).first()
            best, share = min(best, time.perf_counter() - t), (row["hit"] or 0) / max(1, row["n"])
        out.append((r, share, best))
    return out


def order_rules(measured_rules: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per second first; ties keep the order given."""
    return [r for r, share, cost in sorted(measured_rules, key=lambda x: -x[1] / max(x[2], 1e-9))]


def verdict(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, or null: later rules aren't evaluated for that row."""
    chain = reduce(lambda acc, r: F.when(F.coalesce(r.rejects, F.lit(False)), r.name) if acc is None
                   else acc.when(F.coalesce(r.rejects, F.lit(False)), r.name), rules, None)
    return chain if chain is not None else F.lit(None).cast("string")


def text_rules(text: Column, ws: Column) -> list[Rule]:
    """The same rules on the text and its words, each computing only what it needs: in a CASE WHEN
    the cascade's order decides how much of a text's work is done."""
    n, chars, sym = F.size(ws), word_chars(ws), n_symbols(text)
    repeats = _let(window_keys(ws), lambda keys: n_repeat_words(ws, keys))
    dup = _let(lines(text), lambda ls: (10 * n_dup_lines(ls) > 3 * F.size(ls)) & (n_dup_lines(ls) >= 3))
    return [Rule("few_words", n < 50), Rule("repeated_windows", 100 * repeats > 50 * n),
            Rule("symbols", 10 * sym > 3 * n), Rule("short_words", chars < 2 * n),
            Rule("long_words", chars > 15 * n), Rule("dup_lines", dup)]


def ranked_rules(texts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in the order the sample calls for. ``texts`` has one column, the text."""
    (t,) = texts.columns
    sample = sampled(texts, sample_rows).withColumn("ws", words(F.col(t)))  # a column of its own: lambdas index it
    return [r.name for r in order_rules(calibrate(sample, text_rules(F.col(t), F.col("ws"))))]


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the measures, base_failed, rejected_by (first rule of the calibrated order that
    rejects, base rules included) and kept, for every row."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    by_name = {r.name: r for r in base_rules() + method_rules()}
    order = [by_name[n] for n in ranked_rules(slim.select("text"), sample_rows)]
    base = reduce(lambda a, b: a | b, [r.rejects for r in base_rules()])
    return (measured(slim).withColumn("base_failed", base).withColumn("rejected_by", verdict(order))
            .withColumn("kept", F.col("rejected_by").isNull()).drop("text"))


def keep_good(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that pass every rule, all columns untouched."""
    order = ranked_rules(docs.select(F.col(text).alias("text")), sample_rows)
    t = F.col(text)

    def first_rejection(ws: Column) -> Column:
        by_name = {r.name: r for r in text_rules(t, ws)}
        return verdict([by_name[n] for n in order])
    # the words are bound to a lambda: a filter is pushed below a column that would hold them
    return docs.where(_let(words(t), first_rejection).isNull())
