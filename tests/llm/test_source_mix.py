"""Source mixing: targets against a plain recomputation, the schedule against the plain van der Corput
map, the mix against the contract's rules, and the defined cases."""
import random
import re
from collections import Counter, defaultdict

import pytest

from labelforge.llm import source_mix as M
from labelforge.llm.queries import REGISTRY

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, src bigint, slot bigint, start bigint, block bigint, rank bigint, target double, h bigint"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4, 5, 6, 7, 0.5, 8) for i, t, s in rows], SCHEMA)


def shares(sizes):
    """The contract's targets: share all words by weight, cut what is above, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, fixed, rest = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        above = [s for s in free if target[s] > 3 * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = 3 * sizes[s]
            fixed.add(s)
            rest -= target[s]


def texts(rnd, n, sources, longest=60):
    return [(i, " ".join(f"w{rnd.randrange(99)}" for _ in range(rnd.randrange(longest))), rnd.choices(sources, [60] + [3] * (len(sources) - 1))[0]) for i in range(n)]


def check(rows, out):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = shares(sizes)
    took = Counter()
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((i, s, len(WORD.findall(t or ""))) for i, t, s in rows)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        took[r.source] += r.taken
    for s, n in sizes.items():
        assert abs(took[s] - want[s]) <= 0.5 + 1e-6


@pytest.mark.parametrize("seed, sources, block", [(1, ["hot", "b", "c", None, "é", "Z"], 16), (2, ["only"], 7), (3, [f"s{i}" for i in range(40)], 64), (4, ["a", "tiny"], 512)])
def test_targets_and_taken_words(spark, seed, sources, block):
    rows = texts(random.Random(seed), 700, sources)
    df = table(spark, rows).repartition(5)
    out = M.taken(df, block).collect()
    check(rows, out)
    again = M.taken(table(spark, rows[::-1]).repartition(3), block).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_many_small_sources_cascade_of_caps(spark):
    rows = [(i, "w " * (2 ** (i // 3)), f"s{i:02d}") for i in range(36)]
    check(rows, M.taken(table(spark, rows), 32).collect())


def test_defined_cases(spark):
    rows = [(None, "a b c", "x"), (None, None, None), (1, "", "x"), (2, "  \n\t ", "y"), (3, "p q r s", "x"), (3, "p q r s", "x"), (3, "other words", "x"),
            (4, "é è Ω", None), (5, "l " * 200_000, "z")]
    check(rows, M.taken(table(spark, rows), 64).collect())
    empty = table(spark, rows).limit(0)
    assert M.taken(empty).collect() == [] and M.mixture(empty).collect() == []
    blank = table(spark, [(1, None, "a"), (2, " ", None)])
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in M.taken(blank).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_schedule_is_the_van_der_corput_map(spark):
    sizes = spark.createDataFrame([("a", 5000), ("b", 900), (None, 77), ("d", 0), ("c", 30_000)], "source string, source_size long")
    planned = M.plan(M.targets(sizes), 16)
    plan = sorted(planned.collect(), key=lambda r: r["rank"])
    got = sorted(M.schedule(planned, 16).collect(), key=lambda r: r.slot)
    bits = (sum(r.slots for r in plan) - 1).bit_length()
    ends, seen, want = [r.first_point + r.slots for r in plan], Counter(), []
    for k in range(1 << bits):
        y = int(format(k, f"0{bits}b")[::-1], 2)  # the point of time k, in slots
        src = next((i for i, e in enumerate(ends) if y < e), None)
        if src is not None:
            want.append((k, src, seen[src]))
            seen[src] += 1
    assert [(r.slot, r.src, r.nth) for r in got] == want
    for r in got:
        p = plan[r.src]
        assert r.block == r.nth % p.n_blocks and r["pass"] == r.nth // p.n_blocks and 0 < r.tokens <= 16
    # every stretch holds each source in its share, to a few slots
    total = len(got)
    for a in range(0, total - 256, 97):
        part = Counter(r.src for r in got[a:a + 256])
        for i, p in enumerate(plan):
            assert abs(part[i] - 256 * p.slots / total) <= 2 * bits


def test_mixture_holds_whole_words_in_order(spark):
    rnd = random.Random(9)
    rows = [(i, "\n".join(f"d{i}w{k}" for k in range(rnd.randrange(80))), rnd.choice(["a", "b", None])) for i in range(200)]
    df = table(spark, rows)
    mix = sorted(M.mixture(df, 32).collect(), key=lambda r: (r.slot, r.at))
    words = {i: WORD.findall(t) for i, t, _ in rows}
    count = Counter()
    for r in mix:
        assert r.text.split(" ") == words[r.doc_id][r.first:r.first + r.n_words]
        count[r.doc_id] += r.n_words
    for a, b in zip(mix, mix[1:]):
        assert a.slot != b.slot or (b.at == a.at + a.n_words and a.source == b.source and a["pass"] == b["pass"])
    assert {r.doc_id: r.taken for r in M.taken(df, 32).collect()} == {i: count[i] for i, _, _ in rows}
    seen = Counter((r.doc_id, r["pass"], w) for r in mix for w in range(r.first, r.first + r.n_words))
    assert max(seen.values()) == 1  # a pass takes no word twice


def test_registered_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    q = REGISTRY["op11_source_schedule"][0](spark, SF)
    assert q.columns == ["doc_id", "size", "source_size", "target", "taken"]
    check(rows, M.taken(spark.read.parquet(f"{SF}/documents.parquet")).collect())
