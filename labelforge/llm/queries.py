"""Registered queries of the training-data operators: thin (spark, sf_dir) functions that apply an
operator to its whole table and derive the digest columns, with DuckDB SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import bloom_cascade, chosen_path, decontaminate, html_template, lattice, licenses, merkle, packing, prefix_trie, quality_cascade, secrets, sentence_spans, source_mix

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


# ------------------------------------------------------------------ 3 secrets
@register("op3_secret_entropy")
def op3_secret_entropy(spark, d):
    s = secrets.scan(read(spark, d, "documents").select("doc_id", "text"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex",
                    F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
                    secrets.written(F.col("found")).alias("spans"))


# ------------------------------------------------------------------ 5 URL filter
URL_RULES = [bloom_cascade.UrlRule("allow", "org", "/"), bloom_cascade.UrlRule("block", "example.org", "/es/"),
             bloom_cascade.UrlRule("block", "example.org", "/en/1"), bloom_cascade.UrlRule("allow", "com", "/fr/"),
             bloom_cascade.UrlRule("block", "com", "/de/")]
BLOCK_TERMS = ("spam", "pills", "casino", "porn", "phish", "malware")

OP5_SQL = r"""
WITH u AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT u.page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS v
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u.page_id)
SELECT u.page_id, host, path, rule,
       coalesce(v, CASE WHEN """ + " OR ".join(f"contains(host, '{t}')" for t in BLOCK_TERMS) + r""" THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f USING (page_id)"""


@register("op5_url_cascade", OP5_SQL)
def op5_url_cascade(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    return bloom_cascade.judge(pages, URL_RULES, bloom_cascade.hosts_with_terms(pages, BLOCK_TERMS))


# ------------------------------------------------------------------ 7 quality rules
OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM l),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM l),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM g WHERE i + 2 <= len(w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM k),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
       OR (10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3)) AS kept
FROM b"""


@register("op7_quality_cascade", OP7_SQL)
def op7_quality_cascade(spark, d):
    a = quality_cascade.assess(read(spark, d, "documents"))
    return a.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# ------------------------------------------------------------------ 10 licenses
@register("op10_license_templates")
def op10_license_templates(spark, d):
    return licenses.scan(read(spark, d, "documents")).drop("spans")


# ------------------------------------------------------------------ 8 packing
def ranks_path(spark: SparkSession) -> str:
    """The vocabulary of byte_bpe_50k.json as ranks; labelforge.bpe_ranks names another place."""
    import public_tokenizers

    return spark.conf.get("labelforge.bpe_ranks", None) or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@register("op8_shortest_pack_first")
def op8_shortest_pack_first(spark, d):
    pieces = packing.tokenize(read(spark, d, "documents"), ranks_path(spark))
    slim = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(slim)


# ------------------------------------------------------------------ 2 decontamination
@register("op2_spaced_seed_leaks")
def op2_spaced_seed_leaks(spark, d):
    return decontaminate.overlaps(read(spark, d, "documents"), read(spark, d, "benchmark"))


# ------------------------------------------------------------------ 6 near duplicates
@register("op6_chosen_path")
def op6_chosen_path(spark, d):
    return chosen_path.near_duplicates(read(spark, d, "documents"))


# ------------------------------------------------------------------ 9 language-model scores
def pieces_path(spark: SparkSession) -> str:
    """The subword vocabulary; labelforge.pieces names another place."""
    import public_tokenizers

    return spark.conf.get("labelforge.pieces", None) or str(public_tokenizers.path("piece_bpe_32k.model"))


@register("op9_subword_lattice")
def op9_subword_lattice(spark, d):
    return lattice.score(read(spark, d, "documents"), pieces_path(spark))


# ------------------------------------------------------------------ 4 sentence spans
@register("op4_sentence_spans")
def op4_sentence_spans(spark, d):
    return sentence_spans.repeated_spans(read(spark, d, "documents"))


# ------------------------------------------------------------------ 1 HTML extraction
@register("op1_template_removal")
def op1_template_removal(spark, d):
    return html_template.extract(read(spark, d, "pages")).withColumn("n_chars", F.length("text").cast("long"))


# ------------------------------------------------------------------ 13 manifest
@register("op13_merkle_manifest")
def op13_merkle_manifest(spark, d):
    return merkle.audit(read(spark, d, "documents")).drop("position", "path")


# ------------------------------------------------------------------ 11 mixing sources
@register("op11_source_schedule")
def op11_source_schedule(spark, d):
    return source_mix.taken(read(spark, d, "documents")).drop("source")


# ------------------------------------------------------------------ 12 conversation trie
@register("op12_prefix_trie")
def op12_prefix_trie(spark, d):
    return prefix_trie.trie(read(spark, d, "conversations"))
