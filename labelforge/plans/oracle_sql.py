"""SQL building blocks for the DuckDB oracle: the derived views as CTEs, and helpers that
spell the same expressions as the Spark side."""
from __future__ import annotations

from labelforge.functions.text import PY_SPACE_CLASS, WORD_SPLIT
from labelforge.operators import rules as R


def r4(x: str) -> str:
    """round to 4 places, no -0.0."""
    return f"(CASE WHEN round(({x})::DOUBLE, 4) = 0 THEN 0.0 ELSE round(({x})::DOUBLE, 4) END)"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+\\z', '', 'g')"


def f2(x: str) -> str:
    return py_strip(f"regexp_replace({x}, '\\?\\z', '')")


def word_count(x: str) -> str:
    s = py_strip(x)
    return f"(CASE WHEN {s} = '' THEN 0 ELSE len(string_split_regex({s}, '{WORD_SPLIT}')) END)"


def _lower_stripped(q: str) -> str:
    return f"lower({py_strip(f'coalesce({q}, {chr(39)}{chr(39)})')})"


def rule_sql(q: str) -> dict[str, str]:
    t = _lower_stripped(q)
    return {
        "tab_ref": f"(regexp_matches({t}, '{R.TAB_RE}') OR regexp_matches({t}, '{R.MENTION_RE}'))",
        "url": f"regexp_matches({t}, '{R.URL_RE}')",
        "time": f"regexp_matches({t}, '{R.TIME_RE}')",
        "imperative": f"regexp_matches({t}, '{R.IMPERATIVE_RE}')",
        "compare": f"regexp_matches({t}, '{R.COMPARE_RE}')",
        "short": f"({word_count(t)} < {R.MIN_QUERY_WORDS})",
        "question": f"regexp_matches({t}, '{R.QUESTION_RE}')",
    }


def weak_label_sql(q: str) -> str:
    r = rule_sql(q)
    return (f"(CASE WHEN {r['tab_ref']} THEN 'Chat' WHEN {r['url']} THEN 'Search' "
            f"WHEN {r['time']} THEN 'Search' WHEN {r['imperative']} THEN 'Chat' "
            f"WHEN {r['compare']} THEN 'Search' WHEN {r['short']} THEN 'Search' "
            f"WHEN {r['question']} THEN 'Chat' ELSE 'Search' END)")


def weak_rule_sql(q: str) -> str:
    r = rule_sql(q)
    return (f"(CASE WHEN {r['tab_ref']} THEN 1 WHEN {r['url']} THEN 2 WHEN {r['time']} THEN 3 "
            f"WHEN {r['imperative']} THEN 4 WHEN {r['compare']} THEN 5 WHEN {r['short']} THEN 6 "
            f"WHEN {r['question']} THEN 7 ELSE 8 END)")


def split_case(pos: str, n: str, a: str, b: str, c: str) -> str:
    nt = f"least({n}, floor(0.8::DOUBLE * {n})::BIGINT + 1)"
    m = f"({n} - {nt})"
    ne = f"least({m}, floor(0.5::DOUBLE * {m})::BIGINT + 1)"
    return f"(CASE WHEN {pos} < {nt} THEN {a} WHEN {pos} < {nt} + {ne} THEN {b} ELSE {c} END)"


VIEWS = f"""
queries AS (
  SELECT 'url' AS subset, page_id AS rid, url AS query FROM pages
  UNION ALL SELECT 'chat', conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'
  UNION ALL SELECT 'short', p_partkey, p_name FROM part
  UNION ALL SELECT 'general', doc_id, text FROM documents),
labeled AS (
  SELECT d.doc_id, d.text AS query, CASE WHEN l.quality = 1 THEN 'Search' ELSE 'Chat' END AS label,
         d.source, d.lang, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g0 AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('666:' || doc_id), doc_id) - 1 AS _pos,
         count(*) OVER (PARTITION BY lang) AS _n
  FROM labeled WHERE lang IN ('fr', 'en')),
groups AS (
  SELECT doc_id, query, label, source, lang, n_chars,
    {split_case('_pos', '_n', "lang || '_train'", "CASE WHEN lang = 'fr' THEN 'fr_val' ELSE 'en_eval' END", "lang || '_test'")} AS grp,
    CASE WHEN label = 'Search' THEN 1 ELSE 0 END AS y
  FROM g0),
groups_o AS (
  SELECT *, CASE grp WHEN 'fr_train' THEN 0 WHEN 'en_train' THEN 1 WHEN 'fr_val' THEN 2
                     WHEN 'en_eval' THEN 3 WHEN 'fr_test' THEN 4 ELSE 5 END AS ord
  FROM groups),
preds AS (SELECT doc_id, grp, y, least(n_chars / 25000.0::DOUBLE, 1.0::DOUBLE) AS prob FROM groups),
doc_tok AS (
  SELECT doc_id, unnest(string_split_regex(lower(text), '{WORD_SPLIT}')) AS token,
         generate_subscripts(string_split_regex(lower(text), '{WORD_SPLIT}'), 1) - 1 AS pos
  FROM documents),
tokens AS (SELECT * FROM doc_tok WHERE token <> ''),
vc AS (SELECT token, count(*) AS n FROM tokens GROUP BY token),
vocab AS (
  SELECT token, n, n / (SELECT sum(n) FROM vc)::DOUBLE AS p, ln(n / (SELECT sum(n) FROM vc)::DOUBLE) AS logp,
         row_number() OVER (ORDER BY n DESC, token) - 1 AS token_id
  FROM vc),
corpus AS (
  SELECT g.*, o.off + row_number() OVER (PARTITION BY g.grp ORDER BY g.doc_id) - 1 AS id,
         row_number() OVER (PARTITION BY g.grp ORDER BY g.doc_id) - 1 AS gpos
  FROM groups_o g JOIN (SELECT grp, (sum(count(*)) OVER (ORDER BY min(ord)))::BIGINT - count(*) AS off
                        FROM groups_o GROUP BY grp) o ON g.grp = o.grp),
rowids AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM labeled),
tr_results AS (
  SELECT row_id, row_id // 64 AS batch_id,
         CASE WHEN toxic = 1 THEN NULL ELSE {f2('query')} END AS translation,
         CASE WHEN toxic = 1 AND label = 'Search' THEN 'declined' END AS error
  FROM rowids JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id)
  WHERE row_id // 64 < (SELECT max(row_id // 64) FROM rowids))
"""


def q(select: str, ctes: str = "") -> str:
    """A full oracle statement: the shared views, optional extra CTEs, then the select."""
    extra = ",\n" + ctes.strip().rstrip(",") if ctes.strip() else ""
    return "WITH " + VIEWS.strip() + extra + "\n" + select.strip()
