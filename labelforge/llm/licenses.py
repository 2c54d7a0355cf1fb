"""License scan by template-markup matching.

A template is license wording with markup: ``[[...]]`` is an optional region, ``{{n}}`` a
replaceable region of at most n words; regions may nest. ``compile_template`` turns it into an
automaton over words; a text holds the template at a word if the automaton accepts from there with
all mandatory wording matched exactly, optional regions present or absent, and replaceable regions
filled by up to n words. The longest acceptance counts.

Words are found and hashed for a whole Arrow batch at once; the automata start only where the
hashes of the template's first mandatory words stand (every template begins with two mandatory
words), so the bulk of a corpus costs one comparison per word. Base phrases are compared by hash
and then by their bytes.

Edge cases: a null or empty text has no words and no labels; texts are read whole; overlapping
places all count; repeated rows give equal results; other columns are left alone.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.llm import tokens as T

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

CATALOGUE = Path(__file__).with_name("licenses.txt")  # the wordings; a caller may name files of its own
MENTION, NOTICE, TEXT = 0.5, 0.8, 1.0  # a bare phrase; a line that names a licence; all of its wording
KINDS = {"text": TEXT, "notice": NOTICE}
DENIALS = {"not", "never", "no", "isn", "aren", "wasn", "nor", "without"}  # such a word shortly before a notice denies it
DENIED_WITHIN = 3


@dataclass(frozen=True)
class Template:
    """Wording with markup; ``score`` of a text that holds it."""
    label: str
    score: float
    wording: str


def catalogue(*paths: str | Path) -> list[Template]:
    """The templates of catalogue files (format: ``licenses.txt``), read on the driver: a few hundred
    kilobytes at most, sent to the tasks."""
    out = []
    for path in paths or (CATALOGUE,):
        lines = [x for x in Path(path).read_text("utf-8").splitlines() if not x.startswith("#")]
        for part in "\n".join(lines).split("== ")[1:]:
            head, _, wording = part.partition("\n")
            label, _, kind = head.strip().partition(" ")
            if kind.strip() not in KINDS:
                raise ValueError(f"{path}: {head!r} is no label and kind ({', '.join(KINDS)})")
            out.append(Template(label, KINDS[kind.strip()], wording))
    return out


FREE, ACCEPT = -1, -2


@dataclass(frozen=True)
class Automaton:
    """States 0..; ``arcs[s]``: (word or FREE for any word, next state); ``empty[s]``: states reached
    without a word; the last state accepts. ``lead``: the mandatory words it starts with;
    ``mandatory``: how many mandatory words there are."""
    label: str
    lead: tuple[str, ...]
    arcs: tuple[tuple[tuple[str | int, int], ...], ...]
    empty: tuple[tuple[int, ...], ...]
    mandatory: int
    score: float = TEXT

    def close(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts(self, words, start: int, end: int) -> int:
        """End of the longest acceptance from word ``start`` (words(i) is word i), or -1."""
        states, best, i, final = self.close({0}), -1, start, len(self.arcs) - 1
        while states:
            if final in states:
                best = i
            if i >= end:
                break
            w = words(i)
            states = self.close({t for s in states for a, t in self.arcs[s] if a == FREE or a == w})
            i += 1
        return best


def compile_template(label: str, text: str, score: float = TEXT) -> Automaton:
    arcs: list[list] = [[]]
    empty: list[list] = [[]]

    def state() -> int:
        arcs.append([])
        empty.append([])
        return len(arcs) - 1

    at, opened, mandatory, lead, leading = 0, [], 0, [], True
    for m in re.finditer(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)):
        tok = m.group()
        if tok == "[[":
            leading = False
            opened.append(at)
        elif tok == "]]":
            out = state()
            empty[at].append(out)
            empty[opened.pop()].append(out)
            at = out
        elif m.group(1):
            leading = False
            out, here = state(), at
            for _ in range(int(m.group(1))):
                empty[here].append(out)
                nxt = state()
                arcs[here].append((FREE, nxt))
                here = nxt
            empty[here].append(out)
            at = out
        else:
            nxt = state()
            arcs[at].append((tok, nxt))
            at = nxt
            if not opened:
                mandatory += 1
                if leading:
                    lead.append(tok)
    if opened or len(lead) < 2:
        raise ValueError(f"{label}: unbalanced markup, or fewer than two mandatory words at the start")
    final = state()
    empty[at].append(final)
    return Automaton(label, tuple(lead), tuple(map(tuple, arcs)), tuple(map(tuple, empty)), mandatory, score)


def lower(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def _places(h: np.ndarray, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Starts where the words of ``key`` stand consecutively in one text."""
    k = len(key)
    if len(h) < k:
        return np.empty(0, np.int64)
    n = len(h) - k + 1
    at = np.flatnonzero(h[:n] == key[0])
    for j in range(1, k):
        at = at[h[at + j] == key[j]]
    return at[owner[at] == owner[at + k - 1]]


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint>>"


def _scan(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], templates: list[Template]) -> Iterator[pa.RecordBatch]:
    autos = [compile_template(t.label, t.wording, t.score) for t in templates]
    base = [(p.split(), label, T.hash_of(p.split())) for p, label in phrases.items()]
    leads = [T.hash_of(list(a.lead)) for a in autos]
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                     ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])))])
    for batch in batches:
        for a, b, data, off in T.text_chunks(batch, "text"):
            w = T.Words(data, off, T.ALNUM_WORDS)
            h, owner = w.hashes(), w.owner()
            starts: dict[int, list[int]] = {}
            labels: dict[int, set[str]] = {}
            spans: dict[int, list] = {}
            scores: dict[int, float] = {}
            for ws, label, key in base:
                for p in _places(h, owner, key).tolist():
                    if all(w.text(p + j) == ws[j].encode() for j in range(len(ws))):
                        d = int(owner[p])
                        starts.setdefault(d, []).append(p - int(w.bounds[d]))
                        labels.setdefault(d, set()).add(label)
            for auto, key in zip(autos, leads):
                for p in _places(h, owner, key).tolist():
                    d = int(owner[p])
                    end = auto.accepts(lambda i: w.text(i).decode("utf-8", "replace"), p, int(w.bounds[d + 1]))
                    first = int(w.bounds[d])
                    if end > p and not (auto.score < TEXT and any(w.text(i).decode("utf-8", "replace") in DENIALS for i in range(max(first, p - DENIED_WITHIN), p))):
                        spans.setdefault(d, []).append((auto.label, p - first, end - first))
                        scores[d] = max(scores.get(d, 0.0), auto.score)
            rows = []
            for d in range(b - a):
                found = sorted(set(spans.get(d, [])))
                st, lb = starts.get(d, []), labels.get(d, set())
                scores.setdefault(d, MENTION if st else 0.0)
                rows.append((int(w.bounds[d + 1] - w.bounds[d]), len(st), min(st, default=None), max(st, default=None),
                             ",".join(sorted(lb)), ",".join(sorted(lb | {s[0] for s in found})), scores[d],
                             [dict(zip(("label", "first", "last"), s)) for s in found]))
            ids = batch.column(batch.schema.get_field_index("doc_id")).slice(a, b - a)
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([ids] + [pa.array(c, f.type) for c, f in zip(cols, list(out)[1:])], schema=out)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES,
         templates: list[Template] | None = None) -> DataFrame:
    """One row per document: word count, base places, labels, score and the templates' word spans;
    ``templates``: default the package's ``catalogue()``. The score is that of the most certain find: 1.0
    where all mandatory wording of a licence stands, 0.8 for a line that names one, 0.5 for a bare phrase, 0
    for none. A notice with a denial up to three words before it ("not released under ...") is no find.
    No shuffle: each text is read once where it lies."""
    templates = catalogue() if templates is None else templates
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(lambda batches: _scan(batches, phrases, templates), SCHEMA)
