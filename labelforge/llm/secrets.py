"""Secret scan (DataFrame functions only): fixed patterns, and a sliding-window Shannon entropy
over candidate strings per character class.

Candidates are the maximal runs of a class's characters (at least ``short`` long). Each run is
read once: a window of ``window`` characters (``short`` ones for shorter runs, with a threshold of
their own) slides over it and keeps one count per character; entering and leaving characters change
Σ c·log2(c), so the entropy log2(w) - Σ/w needs no recount. A run whose best window reaches the
class's threshold becomes a span, unless its whole value is on the allow-list. A path of plain words
in front of a run is no part of the candidate; what stands behind it is scored like any other run.
Base spans are never suppressed.

Positions are code points, end exclusive. A pattern's matches come from regexp_extract_all and the gaps
before them from a split at the same pattern; their lengths add up to the positions. All steps are linear
in the text: positions are added up batch by batch, windows move over a list of codes, and cuts are made
in slices.

Edge cases: a null text is empty and has no spans; texts of any length are read whole; spans of
different kinds may overlap; repeated rows give equal spans; other columns are left alone.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their listed order, and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"  # sorts by start, then kind as listed


@dataclass(frozen=True)
class CharClass:
    """Runs of ``alphabet`` (a regex class) whose best window of ``window`` characters has at
    least ``min_bits`` of entropy, or of ``short`` characters ``short_bits`` where the run is shorter
    than ``window``; ``need`` must be found in the run for each pattern."""
    kind: str
    alphabet: str
    chars: str
    window: int
    min_bits: float
    need: tuple[str, ...]
    short: int = 16
    short_bits: float = 3.0


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Of random keys at most about one in a hundred has a best window below its class's threshold.
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", DIGITS + "abcdefABCDEF", 24, 3.1, ("[0-9]", "[A-Fa-f]"), short_bits=2.6),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", LOWER + UPPER + DIGITS + "+/_=-", 24, 3.7, ("[0-9]", "[a-z]", "[A-Z]"), short_bits=3.2),
    CharClass("entropy_lower", "a-z0-9", LOWER + DIGITS, 24, 3.4, ("[0-9]", "[g-z]")),
    CharClass("entropy_upper", "A-Z0-9", UPPER + DIGITS, 24, 3.4, ("[0-9]", "[G-Z]")),
)
# Whole values that look random but are public by nature: UUIDs, test values, words with a number.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)^(?:[+/_=-]++|example|sample|placeholder|changeme|your|api|secret|key|token|value|x{6,}+|0123456789|abcdefghij(?:klmnopqrstuvwxyz)?|abcdef){1,40}$",
    r"^[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,}){0,8}(?:[0-9]{2}|[0-9]{4})$",
    r"^[A-Z]{4,}(?:[0-9]{2}|[0-9]{4})$",
)
PATH = r"^/?(?:[A-Za-z][A-Za-z_-]*+/){2,64}"  # plain words in front of a run, not the run itself


BATCH = 512  # elements that one fold passes over: Spark copies a fold's state at each element


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(xs: Column, both) -> Column:
    """For each element of an int array, what ``both`` makes of 0 and all elements before it. Batches
    are folded first, so no state holds more than a batch, or one value a batch."""
    def batches(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(BATCH)).cast("int")),
                           lambda k: F.slice(v, k * BATCH + 1, F.lit(BATCH)))

    def by_batch(parts):
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), both))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(both(F.element_at(acc, -1), t))))
        inside = lambda p, at: F.aggregate(
            p, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, x: F.struct(both(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, F.slice(starts, F.lit(1), F.size(parts)), inside))

    return _let(xs, lambda v: F.when(F.size(v) > 0, _let(batches(v), by_batch)).otherwise(F.array().cast("array<int>")))


def _matches(text: Column, pattern: str) -> Column:
    """The pattern's matches as (value, gap: what stands between it and the match before)."""
    none = F.array().cast("array<struct<value:string,gap:string>>")
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, F.zip_with(
        found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))).otherwise(none))


def _located(matches: Column) -> Column:
    """``_matches`` → (start, end, value). A match starts behind its gap, where the one before ended."""
    def place(m):
        ends = _before(F.transform(m, lambda x: F.length(x["gap"]) + F.length(x["value"])), lambda a, b: a + b)
        start = lambda x, at: at + F.length(x["gap"])
        return F.zip_with(m, ends, lambda x, at: F.struct(start(x, at).alias("start"), (start(x, at) + F.length(x["value"])).alias("end"), x["value"].alias("value")))

    return _let(matches, place)


def _spans(located: Column, rank: int, kind: str) -> Column:
    return F.transform(located, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                                                   m["end"].alias("end"), F.lit(kind).alias("kind")))


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}


def base_spans(matches: dict[str, Column]) -> dict[str, Column]:
    """The base spans from each kind's ``_matches``."""
    ok = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8
    found = {k: _located(matches[k]) for k in BASE_KINDS}
    found["assign"] = F.filter(found["assign"], ok)
    return {k: _spans(found[k], i, k) for i, k in enumerate(BASE_KINDS)}


def best_window_bits(run: Column, c: CharClass, window: int | None = None) -> Column:
    """Highest entropy of any ``window`` (``c.window``) consecutive characters of the run. The state holds the
    counts and s = Σ count·log2(count); a character coming in or going out changes one count and s."""
    w, k = window or c.window, len(c.chars)
    xlog = F.array(*[F.lit(i * math.log2(i) if i else 0.0) for i in range(w + 2)])
    codes = F.transform(F.regexp_extract_all(run, F.lit("."), F.lit(0)), lambda x: F.instr(F.lit(c.chars), x))  # 1..k
    gone = F.concat(F.array_repeat(F.lit(0), w), codes)  # the character that leaves as another comes, 0 for none
    moves = F.zip_with(codes, F.slice(gone, F.lit(1), F.length(run)), lambda x, y: F.struct(x.alias("came"), y.alias("gone")))
    zero = F.array_repeat(F.lit(0), k)
    state = F.struct(F.lit(0).alias("i"), zero.alias("n"), F.lit(0.0).alias("s"), F.lit(float(w * w)).alias("low"))

    def step(acc, m):
        i, came, gone = acc["i"] + 1, m["came"], m["gone"]
        up, down = F.get(acc["n"], came - 1), F.get(acc["n"], gone - 1)
        moved = F.when(came == gone, acc["n"]).otherwise(
            F.transform(acc["n"], lambda x, j: x + (j + 1 == came).cast("int") - (j + 1 == gone).cast("int")))
        s = F.when(came == gone, acc["s"]).otherwise(
            acc["s"] + F.get(xlog, up + 1) - F.get(xlog, up)
            + F.when(gone > 0, F.get(xlog, down - 1) - F.get(xlog, down)).otherwise(F.lit(0.0)))
        return F.struct(i.alias("i"), moved.alias("n"), s.alias("s"),
                        F.when(i >= w, F.least(acc["low"], s)).otherwise(acc["low"]).alias("low"))

    return F.aggregate(moves, state, step, lambda acc: F.lit(math.log2(w)) - acc["low"] / F.lit(float(w)))


def entropy_spans(matches: Column, c: CharClass, rank: int, allow: tuple[str, ...] = ALLOW) -> Column:
    runs = _located(matches)
    if "/" in c.chars:
        bare = F.transform(runs, lambda m: F.struct(m["end"].alias("end"), F.regexp_replace(m["value"], PATH, "").alias("value")))
        runs = F.transform(bare, lambda m: F.struct((m["end"] - F.length(m["value"])).alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    def secret(m):
        run, ok = m["value"], F.length(m["value"]) >= c.short
        for p in c.need:
            ok = ok & run.rlike(p)
        for p in allow:
            ok = ok & ~run.rlike(p)
        high = F.when(F.length(run) >= c.window, best_window_bits(run, c) >= c.min_bits).otherwise(best_window_bits(run, c, c.short) >= c.short_bits)
        return F.when(ok, high).otherwise(F.lit(False))

    return _spans(F.filter(runs, secret), rank, c.kind)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", classes: tuple[CharClass, ...] = CLASSES,
         allow: tuple[str, ...] = ALLOW, prefix: str = "") -> DataFrame:
    """Adds ``base`` and ``found`` (base and method) span arrays, sorted by start, then kind as listed,
    and the counts n_assign, n_access, n_hex, all under ``prefix``."""
    t, p = f"{prefix}whole", prefix
    docs = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    wanted = PATTERNS | {c.kind: f"[{c.alphabet}]{{{c.short},}}" for c in classes}
    docs = docs.withColumns({f"{p}m_{k}": _matches(F.col(t), x) for k, x in wanted.items()})
    m = {k: F.col(f"{p}m_{k}") for k in wanted}
    b = base_spans(m)
    docs = docs.withColumns({f"{p}{k}": b[k].cast(SPAN) for k in BASE_KINDS}
                            | {f"{p}{c.kind}": entropy_spans(m[c.kind], c, len(BASE_KINDS) + i, allow).cast(SPAN) for i, c in enumerate(classes)})
    base = [F.col(f"{p}{k}") for k in BASE_KINDS]
    more = [F.col(f"{p}{c.kind}") for c in classes]
    return (docs.withColumns({f"{p}base": F.sort_array(F.concat(*base)), f"{p}found": F.sort_array(F.concat(*base, *more))}
                             | {f"{p}n_{k}": F.size(f"{p}{k}").cast("long") for k in BASE_KINDS})
            .drop(t, *[f"{p}m_{k}" for k in wanted], *[f"{p}{k}" for k in BASE_KINDS], *[f"{p}{c.kind}" for c in classes]))


SLICE = 4096  # characters of a slice of the text, so that no cut counts from the text's start


def slices(text: Column, spans: Column) -> Column:
    """The text in slices of SLICE code points, where it has spans."""
    return F.when(F.size(spans) > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _between(cut: Column, a: Column, e: Column) -> Column:
    """Characters [a, e) of a text in ``slices``."""
    at = lambda x: F.floor(x / F.lit(SLICE)).cast("int")
    part = lambda i: F.substring(F.get(cut, i), F.greatest(a - i * SLICE, F.lit(0)) + 1, F.least(e - i * SLICE, F.lit(SLICE)) - F.greatest(a - i * SLICE, F.lit(0)))
    return F.when(e > a, F.array_join(F.transform(F.sequence(at(a), at(e - 1)), part), "")).otherwise(F.lit(""))


def redacted(text: Column, spans: Column, cut: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans give one mark. ``cut`` is the
    column that holds ``slices(text, spans)``."""
    ends = F.transform(spans, lambda s: s["end"])
    before = _before(ends, lambda a, b: F.greatest(a, b))  # how far the spans before reach

    def put(c):
        own = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(_between(c, at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(own, ""), _between(c, F.array_max(ends), F.length(text)))

    return F.when(F.size(spans) > 0, _let(cut, put)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, secrets of the text replaced; ``length`` (if there) follows the
    text of the rows that changed. A null text stays null."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(text).alias("__text"))
    s = scan(rows, "__text", prefix="__s_").withColumn("__cut", slices(F.col("__text"), F.col("__s_found")))
    s = s.withColumn("__new", redacted(F.col("__text"), F.col("__s_found"), F.col("__cut")))
    changed = F.size("__s_found") > 0
    new = {text: F.col("__new")}
    if length in docs.columns:
        new[length] = F.when(changed, F.length("__new").cast(docs.schema[length].dataType)).otherwise(F.col(f"__row.`{length}`"))
    return s.select(*[new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
