"""Weak-label rules (P9), generation-rule flags (P10) and per-subset label routing.

The reference leaves labelling to a language model guided by prose definitions; here those
definitions become one ordered chain of JVM-side predicates (no Python per row):

1. tab reference or @mention                     → Chat
2. URL, ``site:``, ``localhost:<port>``           → Search
3. time-sensitive or dynamic keyword              → Search
4. leading imperative verb other than compare     → Chat
5. ``compare`` / ``vs`` / ``versus``              → Search
6. fewer than 4 words                             → Search
7. starts with a question word                    → Chat
8. anything else                                  → Search

All patterns run on ``lower(text)`` and avoid ``\\b``/``(?i)`` so Java and RE2 agree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import py_strip

# ---- Fixed values (from the labelling and generation definitions) -------------------------
TAB_PHRASES = ["my tabs", "these tabs", "open tabs", "selected tabs", "this tab", "my tab"]
IMPERATIVE_VERBS = ["write", "summarize", "explain", "help", "create", "rewrite", "brainstorm",
                    "debug", "optimize", "outline", "generate", "give", "make", "walk",
                    "translate", "fix", "simplify", "rephrase", "draft", "list"]
TIME_KEYWORDS = ["price", "prices", "stock", "stocks", "score", "scores", "news", "weather",
                 "forecast", "today", "tomorrow", "tonight", "now", "latest", "live", "open",
                 "hours", "schedule"]
COMPARE_WORDS = ["compare", "vs", "versus"]
QUESTION_WORDS = ["what", "how", "why", "who", "when", "where", "which", "is", "are", "can",
                  "could", "should", "do", "does", "will", "would"]
URL_TLDS = ["com", "org", "net", "io", "edu", "gov", "fr", "de", "uk", "co"]
FILLER_PHRASES = ["what are the pros of"]
MIN_QUERY_WORDS = 4
# Reference subset registry: subset key → labelled file name, and whether it is labelled by the
# labeler ("label") or gets the constant Search label ("search").
SUBSET_REGISTRY = {
    "general": ("general.csv", "label"),
    "chat": ("chat.csv", "label"),
    "phrases": ("phrases.csv", "search"),
    "time_sensitive": ("timebound.csv", "search"),
    "dynamic": ("dynamic.csv", "search"),
    "short": ("short.csv", "search"),
    "missed_navigation": ("hybrid_urls.csv", "search"),
    "imperative_chat": ("imperative_chat.csv", "label"),
    "ai_tool_common_query_explanation": ("ai_tool_common_query_explanation.csv", "label"),
    "ai_tool_common_query_summarization": ("ai_tool_common_query_summarization.csv", "label"),
    "ai_tool_common_query_translation": ("ai_tool_common_query_translation.csv", "label"),
    "ai_tool_common_query_coding": ("ai_tool_common_query_coding.csv", "label"),
    "ai_tool_common_query_assistance": ("ai_tool_common_query_assistance.csv", "label"),
    "ai_tool_common_query_writing": ("ai_tool_common_query_writing.csv", "label"),
    "ai_tool_common_query_math": ("ai_tool_common_query_math.csv", "label"),
    "ai_tool_common_query_comparison": ("ai_tool_common_query_comparison.csv", "label"),
    "ai_tool_common_query_rephrase": ("ai_tool_common_query_rephrase.csv", "label"),
    "ai_tool_common_query_roleplay": ("ai_tool_common_query_roleplay.csv", "label"),
    "ai_tool_common_query_analysis": ("ai_tool_common_query_analysis.csv", "label"),
    "ai_tool_common_query_learning": ("ai_tool_common_query_learning.csv", "label"),
    "ai_tool_common_query_task_management": ("ai_tool_common_query_task_management.csv", "label"),
    "ai_tool_common_query_discussion": ("ai_tool_common_query_discussion.csv", "label"),
    "ai_tool_common_query_casual_chat": ("ai_tool_common_query_casual_chat.csv", "label"),
    "ai_tool_common_query_system_setting": ("ai_tool_common_query_system_setting.csv", "label"),
    "comparison": ("comparison.csv", "label"),
}
# Subsets of the derived ``queries`` view and the registry subset each one stands for.
VIEW_SUBSETS = {"url": "missed_navigation", "chat": "chat", "short": "short", "general": "general"}
# -------------------------------------------------------------------------------------------

_NW = "[^a-z0-9_]"  # a non-word character (ASCII word definition, same in Java and RE2)
_SP = r"[\t\n\x0B\f\r ]"


def _alt(words) -> str:
    return "(" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def _word_re(words) -> str:
    return f"(^|{_NW}){_alt(words)}($|{_NW})"


TAB_RE = "(" + "|".join(p.replace(" ", f"{_SP}+") for p in TAB_PHRASES) + f")($|{_NW})"
MENTION_RE = f"(^|{_SP})@[a-z0-9_]"
URL_RE = (r"(https?://|www\.|(^|" + _NW + r")site:|localhost:[0-9]+|"
          r"(^|[^a-z0-9-])[a-z0-9-]+\." + _alt(URL_TLDS) + "($|[/?#:]|" + _SP + "))")
TIME_RE = _word_re(TIME_KEYWORDS)
IMPERATIVE_RE = f"^{_alt(IMPERATIVE_VERBS)}($|{_NW})"
COMPARE_RE = _word_re(COMPARE_WORDS)
QUESTION_RE = f"^{_alt(QUESTION_WORDS)}($|{_NW})"


_NSP = r"[^\t\n\x0B\f\r ]"
AT_LEAST_WORDS_RE = f"^{_NSP}+({_SP}+{_NSP}+){{{MIN_QUERY_WORDS - 1}}}"
CHAT_RULES = (1, 4, 7)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalized(q) -> Column:
    """The text every rule looks at: lower-cased, outer whitespace stripped, null → ''."""
    return F.lower(py_strip(F.coalesce(_c(q), F.lit(""))))


# Java-side forms of the URL rule (same matches as URL_RE, which the SQL oracle uses): literal
# searches for the fixed markers, and for a domain one [a-z0-9-] character before ".tld"
# (a run of them exists exactly when its last character does).
URL_LITERALS = ["http://", "https://", "www."]
SITE_RE = f"(^|{_NW})site:"
LOCALHOST_RE = "localhost:[0-9]"
DOMAIN_RE = r"[a-z0-9-]\." + _alt(URL_TLDS) + "($|[/?#:]|" + _SP + ")"


def _has(t: Column, s: str) -> Column:
    return F.instr(t, s) > 0


def url_rule(t) -> Column:
    t = _c(t)
    lit = None
    for s in URL_LITERALS:
        lit = _has(t, s) if lit is None else lit | _has(t, s)
    return (lit | (_has(t, "site:") & t.rlike(SITE_RE)) | (_has(t, "localhost:") & t.rlike(LOCALHOST_RE))
            | t.rlike(DOMAIN_RE))


def tab_rule(t) -> Column:
    t = _c(t)
    return (_has(t, "tab") & t.rlike(TAB_RE)) | (_has(t, "@") & t.rlike(MENTION_RE))


def word_runs(t) -> Column:
    """Maximal runs of [a-z0-9_] in a normalised text: a keyword occurs as a whole word exactly
    when it is one of these runs (what ``(^|[^a-z0-9_])kw($|[^a-z0-9_])`` tests)."""
    return F.split(_c(t), "[^a-z0-9_]+")


def _kw(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def rule_columns(t, runs=None) -> dict[str, Column]:
    """The individual predicates of the chain, on the ``normalized`` text ``t``. Keyword rules
    look the text's word runs up in the keyword list (one split instead of an alternation tried
    at every character); the word rule only reads the first words (an anchored regex)."""
    t = _c(t)
    w = word_runs(t) if runs is None else _c(runs)
    return {
        "tab_ref": tab_rule(t),
        "url": url_rule(t),
        "time": F.arrays_overlap(w, _kw(TIME_KEYWORDS)),
        "imperative": t.rlike(IMPERATIVE_RE),
        "compare": F.arrays_overlap(w, _kw(COMPARE_WORDS)),
        "short": ~t.rlike(AT_LEAST_WORDS_RE),
        "question": t.rlike(QUESTION_RE),
    }


def rule_id_of(t, runs=None) -> Column:
    """Which rule of the chain fires first (1..8) for a ``normalized`` text."""
    r = rule_columns(t, runs)
    return (F.when(r["tab_ref"], 1).when(r["url"], 2).when(r["time"], 3).when(r["imperative"], 4)
            .when(r["compare"], 5).when(r["short"], 6).when(r["question"], 7).otherwise(8))


def label_of_rule(rule) -> Column:
    return F.when(_c(rule).isin(*CHAT_RULES), F.lit("Chat")).otherwise(F.lit("Search"))


def weak_rule_id(q) -> Column:
    """Which rule fired (1..8), for audits."""
    return rule_id_of(normalized(q))


def weak_label(q) -> Column:
    """P9: 'Chat' or 'Search' by the ordered rule chain (single Column form, e.g. in lambdas)."""
    return label_of_rule(weak_rule_id(q))


def apply_rules(df: DataFrame, query: str = "query", label: str = "label", rule: str = "rule") -> DataFrame:
    """P9 over a table: the normalised text is computed once per row (a column of its own, which
    Catalyst does not inline into the seven predicates), the chain runs once, the label follows
    from the rule that fired."""
    return (df.withColumn("_t", normalized(query)).withColumn("_w", word_runs("_t"))
            .withColumn(rule, rule_id_of("_t", "_w"))
            .withColumn(label, label_of_rule(rule)).drop("_t", "_w"))


def policies() -> dict[str, str]:
    """subset → 'label' | 'search', for the registry subsets, the view's subset names, and the stems
    of the subsets' files (what S2 puts into ``source``)."""
    out = {k: p for k, (_f, p) in SUBSET_REGISTRY.items()}
    out.update({v: SUBSET_REGISTRY[r][1] for v, r in VIEW_SUBSETS.items()})
    for f, p in SUBSET_REGISTRY.values():
        out.setdefault(f.rsplit("/", 1)[-1].removesuffix(".csv"), p)
    return out


def constant_label_subsets() -> list[str]:
    """Subsets whose rows all get the constant label."""
    return sorted(k for k, p in policies().items() if p == "search")


def policy_of(subset) -> Column:
    """The subset's policy as a literal map lookup (the table is a code constant: no join)."""
    m = F.create_map(*[x for k, p in sorted(policies().items()) for x in (F.lit(k), F.lit(p))])
    return m[_c(subset)]


def policy_table(spark) -> DataFrame:
    """The fixed subset → file, policy table, for reports."""
    rows = [(k, f, p) for k, (f, p) in SUBSET_REGISTRY.items()]
    rows += [(v, SUBSET_REGISTRY[r][0], SUBSET_REGISTRY[r][1]) for v, r in VIEW_SUBSETS.items()
             if v not in SUBSET_REGISTRY]
    return spark.createDataFrame(rows, "subset string, file string, policy string")


def route_labels(df: DataFrame, subset: str = "subset", query: str = "query",
                 labeler=weak_label, name: str = "label") -> DataFrame:
    """Labeler for subsets whose policy is 'label', constant 'Search' otherwise.
    Unknown subsets are labelled by the labeler."""
    j = df.withColumn("_policy", policy_of(subset))
    if labeler is weak_label:
        j = apply_rules(j, query, "_lab", "_rule")
        lab = F.col("_lab")
    else:
        lab = labeler(F.col(query))
    return (j.withColumn(name, F.when(F.col("_policy") == "search", F.lit("Search")).otherwise(lab))
            .drop("_policy", "_lab", "_rule"))


def rule_flags(df: DataFrame, subset: str = "subset", query: str = "query") -> DataFrame:
    """P10: flags for rows that break their subset's generation rules, as one text column."""
    d = df.withColumn("_t", normalized(query))
    q = F.col("_t")
    r = rule_columns(q)
    s = F.col(subset)
    flags = F.array_compact(F.array(
        F.when((s == "short") & ~r["short"], F.lit("short_too_long")),
        F.when((s == "chat") & r["url"], F.lit("chat_has_url")),
        F.when(q.contains(FILLER_PHRASES[0]), F.lit("generic_filler")),
        F.when(s.isin("url", "short") & r["tab_ref"], F.lit("tab_ref_in_search")),
    ))
    return (d.withColumn("_f", flags).withColumn("flags", F.concat_ws(",", "_f"))
            .withColumn("n_flags", F.size("_f")).drop("_t", "_f"))
