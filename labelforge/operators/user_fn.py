"""User functions over rows (M1-M3): a labeler, a translator and a generator supplied by the
caller (for example a client of an external service), run inside Arrow-batched
``mapInPandas`` tasks. Concurrency is the number of partitions, not a thread pool; each call is
retried with growing, jittered waits and a final failure becomes an error row, never a crash.

Spark may run a task twice (executor loss, speculation), so the functions must be idempotent:
their results are only committed through Spark's output commit protocol.
"""
from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelforge.functions.text import strip_trailing_qmark

LABEL_SCHEMA = "id long, label string, error string, attempts int"
TRANSLATION_SCHEMA = "row_id long, translation string, error string, attempts int"
GENERATED_SCHEMA = "request_id long, pos int, query string, error string, attempts int"


@dataclass(frozen=True)
class Policy:
    """How often a user function is called. The waits between calls double from ``first_wait`` to
    ``longest_wait``, each cut by a random share so that tasks don't come back together; after
    ``deadline`` seconds no further call is begun. Errors in ``hopeless`` aren't repeated."""
    calls: int = 3
    first_wait: float = 0.0
    longest_wait: float = 60.0
    deadline: float = 600.0
    hopeless: tuple[type[Exception], ...] = (TypeError, NotImplementedError)

    def waits(self) -> list[float]:
        return [min(self.longest_wait, self.first_wait * 2 ** k) * random.uniform(0.5, 1.0) for k in range(self.calls - 1)]


def guarded(fn: Callable, policy: Policy) -> Callable:
    """``fn`` as a function that returns (value, error text or None, calls made) and never raises."""
    def call(*args):
        opened, waits, n = time.monotonic(), iter(policy.waits()), 0
        while True:
            n += 1
            try:
                return fn(*args), None, n
            except policy.hopeless as e:
                return None, f"{type(e).__name__}: {e}", n
            except Exception as e:  # noqa: BLE001 - a failure of the user function becomes a row
                wait = next(waits, None)
                if wait is None or time.monotonic() + wait - opened > policy.deadline:
                    return None, str(e) or type(e).__name__, n
                time.sleep(wait)
    return call


def label_with(df: DataFrame, fn: Callable[[str], str], id_col: str = "id", text: str = "query",
               max_retries: int = 3, sleep: float = 0.0,
               valid: tuple[str, ...] = ("Chat", "Search")) -> DataFrame:
    """M1: one ``fn(query) -> label`` call per row; a label outside ``valid`` is an error row."""
    ask = guarded(fn, Policy(max_retries, sleep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, q in zip(pdf[id_col], pdf[text]):
                lab, err, n = ask(q)
                if err is None and lab not in valid:
                    lab, err = None, f"invalid label: {lab!r}"
                out.append((int(i), lab, err, n))
            yield pd.DataFrame(out, columns=["id", "label", "error", "attempts"])
    return df.select(id_col, text).mapInPandas(run, LABEL_SCHEMA)


def label_batches_with(batches: DataFrame, fn: Callable[[list[str]], list[str]], batch: str = "batch_id",
                       items: str = "items", max_retries: int = 3, sleep: float = 0.0) -> DataFrame:
    """M1 batched form: one call per request batch (W3); the reply must have as many labels as
    the batch has queries (F14), else it is retried, then recorded as an error."""
    def checked(qs):
        r = list(fn(list(qs)))
        if len(r) != len(qs):
            raise ValueError(f"reply has {len(r)} labels for {len(qs)} queries")
        return r

    ask = guarded(checked, Policy(max_retries, sleep))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for b, qs in zip(pdf[batch], pdf[items]):
                r, err, n = ask(list(qs))
                out.append((int(b), r, err, n))
            yield pd.DataFrame(out, columns=[batch, "replies", "error", "attempts"])
    return batches.select(batch, items).mapInPandas(
        run, f"{batch} long, replies array<string>, error string, attempts int")


def translate_with(df: DataFrame, fn: Callable[[str, str], str], lang: str, row_id: str = "row_id",
                   text: str = "query", max_retries: int = 3, sleep: float = 2.0, carry: Sequence[str] = ()) -> DataFrame:
    """M2: ``fn(query, lang)`` per row under a ``Policy``; replies are cleaned by F2; a row that keeps
    failing gets a null translation and the error. Columns in ``carry`` (a batch id) pass through."""
    ask = guarded(fn, Policy(max_retries, sleep))

    def one(q):
        return (None, "missing query text", 0) if q is None else ask(q, lang)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = pd.DataFrame([one(q) for q in pdf[text]], columns=["translation", "error", "attempts"], index=pdf.index)
            yield pd.concat([pdf[[row_id, *carry]].rename(columns={row_id: "row_id"}), done], axis=1)

    extra = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)
    schema = TRANSLATION_SCHEMA.replace("row_id long,", f"row_id long{extra},")
    out = df.select(row_id, text, *carry).mapInPandas(run, schema)
    return out.withColumn("translation", F.when(F.col("translation").isNotNull(), strip_trailing_qmark("translation")))


def generate_with(requests: DataFrame, fn: Callable[[str, int], list[str]], request_id: str = "request_id",
                  prompt: str = "prompt", n: str = "n", max_retries: int = 3, sleep: float = 0.0) -> DataFrame:
    """M3: one request row → its generated query rows, with the calls made; a request that keeps
    failing gives one row with null pos and query and the error."""
    ask = guarded(fn, Policy(max_retries, sleep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rid, p, k in zip(pdf[request_id], pdf[prompt], pdf[n]):
                qs, err, calls = ask(p, int(k))
                out += [(int(rid), j, x, None, calls) for j, x in enumerate(qs or [])] if err is None else [(int(rid), None, None, err, calls)]
            got = pd.DataFrame(out, columns=["request_id", "pos", "query", "error", "attempts"])
            yield got.astype({"pos": "Int32"})
    return requests.select(request_id, prompt, n).mapInPandas(run, GENERATED_SCHEMA)
