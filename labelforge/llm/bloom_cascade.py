"""Bloom filter cascade over URL keys (DataFrame functions only).

Level 1 encodes the listed keys; level 2 the other keys of the corpus that level 1 wrongly accepts;
level 3 the listed keys that level 2 accepts; and so on until a level accepts nothing wrongly. For
every key of the universe the first level that says no decides: on an odd level the key isn't
listed, on an even one it is; a key that all levels accept is listed if their number is odd. As
the levels were built over the complete universe, membership is exact for all of its keys, and a
row is judged by looking at a few bits, without a join.

The levels reach the rows as scalar subqueries over a small written table. Their size follows the
number of listed keys (``BITS_PER_KEY``); ``max_bits`` is the proven bound of what each executor
gets. Beyond it ``build`` refuses, and ``judge`` takes an exact join (``member_by_join``) instead.

Edge cases: a null key is in no list; repeated listed keys count once; an empty list or universe
gives an empty cascade, in which nothing is listed.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.llm.store import materialize

BITS_PER_KEY = 12
HASHES = 4
MAX_BITS = 1 << 26     # 8 MB a level
MAX_LEVELS = 24


@dataclass(frozen=True)
class Level:
    """``bits``: a table of one row with the level's words (64 bits each)."""
    bits: DataFrame
    n_words: int
    number: int


def _positions(key: Column, level: int, n_words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(n_words * 64).cast("long")) for i in range(HASHES)]


def encode(keys: DataFrame, n: int, level: int = 1, max_bits: int = MAX_BITS) -> Level:
    """A Bloom filter of the ``n`` keys in the column ``key``, of at most ``max_bits`` bits."""
    n_words = max(1, -(-min(n * BITS_PER_KEY, max_bits) // 64))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, n_words))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    empty = keys.sparkSession.range(n_words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = at.select((F.col("at") / 64).cast("long").alias("w"), one.alias("bits")).union(empty).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    full = words.agg(F.sort_array(F.collect_list(F.struct("w", "bits")))["bits"].alias("bits"))
    return Level(materialize(full, f"cascade-level{level}"), n_words, level)


def accepts(level: Level, key: Column, bits: Column) -> Column:
    """All bits of the key are set in ``bits``, the level's words."""
    ok = F.lit(True)
    for at in _positions(key, level.number, level.n_words):
        word = F.get(bits, (at / 64).cast("int"))
        ok = ok & (F.call_function("shiftright", word, (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return ok


class TooLarge(ValueError):
    """A level would hold more bits than the bound of what is sent to executors."""


class Cascade:
    """``attach`` adds the levels to rows as columns (scalar subqueries: one value per query, kept
    out of lambdas), ``contains`` reads them."""

    def __init__(self, levels: list[Level], name: str):
        self.levels, self.name = levels, name

    @property
    def columns(self) -> list[str]:
        return [f"__{self.name}_{lv.number}" for lv in self.levels]

    def attach(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: lv.bits.scalar() for c, lv in zip(self.columns, self.levels)}) if self.levels else rows

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for lv in reversed(self.levels):
            out = F.when(~accepts(lv, key, F.col(f"__{self.name}_{lv.number}")), F.lit(lv.number % 2 == 0)).otherwise(out)
        return F.coalesce(F.when(key.isNotNull(), out), F.lit(False))


def build(listed: DataFrame, universe: DataFrame, name: str = "cascade", max_bits: int = MAX_BITS) -> Cascade:
    """``listed`` and ``universe`` have one string column each. Keys of the list that the universe
    lacks are kept too."""
    yes = listed.select(F.col(listed.columns[0]).alias("key")).where(F.col("key").isNotNull()).distinct()
    everything = universe.select(F.col(universe.columns[0]).alias("key")).where(F.col("key").isNotNull()).distinct()
    yes = materialize(yes, "cascade-listed")
    no = materialize(everything.join(yes, "key", "left_anti"), "cascade-other")
    levels: list[Level] = []
    inside, outside = yes, no
    n = inside.count()
    while n:
        if len(levels) == MAX_LEVELS or n * BITS_PER_KEY > max_bits:
            raise TooLarge(f"{n} keys at level {len(levels) + 1}: over the bound of what is sent to executors; use member_by_join")
        levels.append(encode(inside, n, len(levels) + 1))
        wrong = materialize(outside.where(accepts(levels[-1], F.col("key"), levels[-1].bits.scalar())), f"cascade-wrong{len(levels)}")
        inside, outside = wrong, inside
        n = inside.count()
    return Cascade(levels, name)


def member_by_join(rows: DataFrame, key: str, listed: DataFrame, out: str) -> DataFrame:
    """The same answer for lists of any size: a join on the key."""
    known = listed.select(F.col(listed.columns[0]).alias("__key")).where(F.col("__key").isNotNull()).distinct().withColumn("__in", F.lit(True))
    return rows.join(known, rows[key] == F.col("__key"), "left").withColumn(out, F.coalesce("__in", F.lit(False))).drop("__key", "__in")


# ------------------------------------------------------------------ URLs
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def domains(host: Column) -> Column:
    """The host and all domains above it: a.b.c → [a.b.c, b.c, c]; empty for an empty host."""
    parts = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), ".")))


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    verdict: str
    host: str
    path: str


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every domain joined with the path's beginnings of the rules' path lengths."""
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda h: h.isNotNull())
    return F.flatten(F.transform(domains(host), lambda d: F.transform(heads, lambda h: F.concat(d, h))))


def judge(pages: DataFrame, rules: list[UrlRule], blocked_hosts: DataFrame, page_id: str = "page_id", url: str = "url",
          max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, else null) and verdict for every row: the
    rule's, else block for a host at or below one of ``blocked_hosts`` (one column), else allow.
    Both lookups ask a cascade: one lists the rules' keys (the few rules that exist are then told
    apart by their text), the other the blocked hosts; their universes are all keys of the table.
    A cascade that would pass ``max_bits`` at any level gives way to an exact lookup of another kind:
    the rules' few keys are compared as they are, the blocked hosts are joined with the distinct hosts."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    texts = {r.host + r.path: r.verdict for r in rules}
    try:
        rule_universe = rows.select(F.explode(rule_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
        by_rule = build(spark.createDataFrame([(k,) for k in texts], "key string"), rule_universe, "rules", max_bits)
        rows, is_rule = by_rule.attach(rows), by_rule.contains
    except TooLarge:
        is_rule = lambda k: k.isin(*texts)
    hosts = rows.select("host").distinct()
    try:
        by_host = build(blocked_hosts, hosts.select(F.explode(domains(F.col("host"))).alias("key")), "hosts", max_bits)
        rows = by_host.attach(rows).withColumn("listed", F.exists(domains(F.col("host")), by_host.contains))
    except TooLarge:
        each = hosts.select(F.col("host").alias("__host"), F.explode(domains(F.col("host"))).alias("__domain"))
        listed = member_by_join(each, "__domain", blocked_hosts, "__listed").where("__listed").select("__host").distinct()
        rows = rows.join(materialize(listed, "blocked-hosts"), F.col("host") == F.col("__host"), "left").withColumn("listed", F.col("__host").isNotNull())
    fits = F.filter(rule_keys(F.col("host"), F.col("path"), lengths), is_rule)
    longest = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    told = F.create_map(*[x for k, v in texts.items() for x in (F.lit(k), F.lit(v))])
    return rows.withColumn("rule", longest).select(
        "page_id", "host", "path", "rule", F.coalesce(F.element_at(told, F.col("rule")), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def hosts_with_terms(pages: DataFrame, terms: tuple[str, ...], url: str = "url") -> DataFrame:
    """The hosts of the table that carry one of ``terms`` in their name."""
    hosts = pages.select(host_of(F.col(url)).alias("host")).distinct()
    found = F.lit(False)
    for t in terms:
        found = found | F.contains("host", F.lit(t))
    return hosts.where(found)
