"""The prefix trie against a plain one built in Python, with the screening switched down, long and
hot conversations, and the defined cases."""
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelforge.llm import prefix_trie as T
from labelforge.llm.queries import REGISTRY

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth bigint, node string, pos bigint, n bigint, k1 bigint, len bigint, kind string"
SF = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    """(conv_id, turn, role, text) → the nodes by the contract's words. Rows of one turn must be equal."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        worth = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += worth
            leaves[p[:d]] += not kids[p]
    return sorted((min(m), len(p), -1 if not p else min(members[p[:-1]]), len(m), kids[p], leaves[p], saved[p],
                   sha(",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)))) for p, m in members.items())


def got(df, **kw):
    t = T.trie(df, **kw)
    assert t.columns == list(T.COLUMNS)
    return sorted(tuple(-1 if v is None else v for v in r) for r in t.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, 3, 4, 5, "k") for r in rows], SCHEMA)


def talk(rnd, n, first=0, turns=12, words=3):
    rows = []
    for c in range(first, first + n):
        for t in range(rnd.randrange(1, turns)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), f"t{rnd.randrange(words)}é"))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, words", [(1, 2), (2, 5), (3, 400)])
def test_equals_a_plain_trie(spark, seed, words):
    rows = talk(random.Random(seed), 150, words=words)
    assert got(table(spark, rows).repartition(4)) == plain(rows)


def test_a_full_sketch_changes_nothing(spark):
    rows = talk(random.Random(5), 120, words=30)
    want = plain(rows)
    for cells in (T.PAGE, 64, 1):
        assert got(table(spark, rows), max_cells=cells) == want


def test_screening_keeps_single_prefixes_off_the_shuffle(spark):
    rows = [(c, t, "user", f"{c}/{t}" if c >= 40 else f"same {t}") for c in range(0, 2000, 5) for t in range(6)]
    built, _ = T.rebuild(T.turns_in_order(table(spark, rows)))
    pre = T.prefixes(built)
    kinds = Counter(r.kind for r in T.screen(pre, *T.sketch(pre)).collect())
    shared = sum(n for p, n in Counter(r.node for r in pre.collect()).items() if n > 1)
    assert shared <= kinds["shared"] <= 1.3 * shared and kinds["tail"] > 1500


def test_hot_first_turn_and_copies(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"x{c % 7 if t < 3 else c}") for c in range(900) for t in range(4)]
    rows += [(c, t, "user", "copy") for c in range(900, 1500) for t in range(3)]
    assert got(table(spark, rows).repartition(6)) == plain(rows)


def test_ids_of_an_end_run_over_several_strings(spark, monkeypatch):
    monkeypatch.setattr(T, "IDS", 7)
    rows = [(c, t, "user", "copy") for c in range(0, 3000, 5) for t in range(2)] + [(1, 0, "user", "a"), (2, 0, "user", "b")]
    assert got(table(spark, rows)) == plain(rows)


def test_a_long_conversation_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 16)
    rows = [(c, t, "user", f"w{t % 9}") for c in (0, 3, 5, 8, 10) for t in range(150 if c != 3 else 90)]
    rows += [(20, t, "user", f"w{t % 9}" if t < 77 else f"v{t}") for t in range(200)] + talk(random.Random(8), 30, first=100)
    assert got(table(spark, rows)) == plain(rows)


def test_defined_cases(spark):
    rows = [(None, 1, "user", "lost"), (0, None, "user", "first"), (0, 1, None, None), (0, 2, "", ""), (1, 5, "user", "only"), (7, 0, "user", "x" * 300_000),
            (3, 0, "a", "b"), (3, 0, "a", "b"), (10, 1, "user", "ß"), (12, 1, "user", None), (14, 9, "q", "é" * 50)]
    assert got(table(spark, rows)) == plain(rows)
    assert got(table(spark, rows).limit(0)) == [] and got(table(spark, rows[:1])) == []
    only_turnless = [(c, 0, "user", "t") for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0]
    assert got(table(spark, only_turnless)) == plain(only_turnless)


def test_rows_of_one_turn_have_one_order(spark):
    rows = [(0, 1, "b", "x"), (0, 1, "a", "z"), (0, 1, "a", "y"), (5, 1, "a", "y"), (5, 1, "b", "x"), (5, 1, "a", "z")]
    a, b = got(table(spark, rows)), got(table(spark, rows[::-1]).repartition(3))
    assert a == b and sum(r[3] for r in a) == 2 * 4  # both conversations give the same three turns


def test_registered_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    q = REGISTRY["op12_prefix_trie"][0](spark, SF)
    assert sorted(tuple(-1 if v is None else v for v in r) for r in q.collect()) == plain(rows)
    assert [f.dataType.simpleString() for f in q.schema] == ["bigint"] * 7 + ["string"]
