"""Benchmark decontamination by one Aho-Corasick automaton over word windows.

The automaton's size is proven before it is broadcast: it holds items of at most ``MAX_CHARS`` characters, which take some 0.13 GB as windows and
0.7 GB as nodes, and a worker process builds it once.  A larger benchmark is scanned in passes over stored rows, each with the automaton of its
share of the items, so a task never holds more than one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._arrow import bounded, byte_texts
from leafmill.llm._store import discard, stored

#: Bytes outside words become spaces and A-Z become a-z; digits, letters and everything above ASCII are words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before folding
#: Benchmark text that one automaton may hold, in characters.
MAX_CHARS = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(items: list[tuple[str, str | None]], width: int = 10) -> dict[str, list[str]]:
    """Each window's normalised text, spaces around, and the sorted ids of the items that have it.

    An item of fewer than ``width`` words, but not none, is one window; null texts and null ids have none.
    """
    found: dict[str, set[str]] = {}
    for name, text in items:
        if name is None:
            continue
        w = words_of((text or "").encode())
        for i in range(max(1, len(w) - width + 1) if w else 0):
            found.setdefault(" " + b" ".join(w[i : i + width]).decode() + " ", set()).add(name)
    return {k: sorted(v) for k, v in found.items()}


def automaton(found: dict[str, list[str]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for key, names in found.items():
        machine.add_word(key, (len(key), names))
    machine.make_automaton()
    return machine


#: The automaton of the part that this process scanned with last.
_BUILT: dict[int, tuple[dict, ahocorasick.Automaton | None]] = {}


def _built(shipped: Broadcast) -> ahocorasick.Automaton | None:
    """The automaton of a broadcast part, built by the first task of a worker process."""
    part = shipped.value  # one object for each process and broadcast
    if id(part) not in _BUILT:
        _BUILT.clear()
        _BUILT[id(part)] = (part, automaton(part) if part else None)
    return _BUILT[id(part)][1]


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: bytes, machine: ahocorasick.Automaton | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """The number of words, the merged runs of hit words (first, last + 1) and the items found in ``text``."""
    folded = text.translate(_FOLD).split()
    n = len(folded)
    if not n or machine is None:
        return n, [], set()
    line = " " + b" ".join(folded).decode() + " "
    starts: list[int] | None = None
    runs: list[tuple[int, int]] = []
    items: set[str] = set()
    for end, (length, names) in machine.iter(line):
        if starts is None:
            ends = np.cumsum([len(w.decode()) + 1 for w in folded])
            starts = [1, *(ends[:-1] + 1).tolist()]
        runs.append((bisect_left(starts, end - length + 2), bisect_right(starts, end)))
        items.update(names)
    return n, merged(runs), items


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", width: int = 10) -> Iterator[dict[str, list[str]]]:
    """The windows of ``benchmark``, one share of its items after the other, dealt by a hash of their ids into shares of about ``MAX_CHARS`` at most.

    An item longer than that has a share's windows to itself.
    """
    size = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    parts = 1 + size // MAX_CHARS
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    for p in range(parts):
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p) if parts > 1 else rows
        yield windows([(r.id, r.text) for r in some.toLocalIterator()], width)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", width: int = 10, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with ``n_words``, ``n_hit``, ``items`` and ``hits``.

    A document word inside any occurrence of a window is hit.  ``items`` are the sorted ids of
    the items with occurring windows; ``hits`` are the hit runs as character offsets ``start, end``
    of the original text, end exclusive.  Columns of these names are replaced.  A null text has
    no words; an empty benchmark hits nothing; repeated rows are scanned each.  Items of equal ids are one item with the
    windows of all; items of equal windows are all named; a repeated item changes nothing.
    """
    added = ["n_words", "n_hit", "items", "hits"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    context = docs.sparkSession.sparkContext
    rows = bounded(docs).select(*keep, F.col(text).alias("__leafmill_text"))
    run_kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    pair = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    names = T.ArrayType(T.StringType())

    def found(batch: pa.RecordBatch, first: bool, machine: ahocorasick.Automaton | None) -> Iterator[tuple[bytes, int, list[tuple[int, int]], list[str]]]:
        """Each text with its words, runs and items, those of earlier passes among them."""
        at = batch.schema.get_field_index("__leafmill_text")
        before = [([], [])] * batch.num_rows if first else zip(batch.column(at + 1).to_pylist(), batch.column(at + 2).to_pylist())
        for raw, (runs, items) in zip(byte_texts(batch.column(at)), before):
            n, more, some = scan(raw, machine)
            yield raw, n, merged([*((r["a"], r["b"]) for r in runs), *more]), sorted({*items, *some})

    def gathered(shipped, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _built(shipped)
            for batch in batches:
                got = list(found(batch, first, machine))
                new = [pa.array([[{"a": a, "b": b} for a, b in runs] for _, _, runs, _ in got], run_kind), pa.array([items for *_, items in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], *new], names=[*keep, "__leafmill_text", "__leafmill_runs", "__leafmill_items"])

        return run

    def finished(shipped, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _built(shipped)
            for batch in batches:
                n_words, n_hit, items, hits = [], [], [], []
                for raw, n, runs, mine in found(batch, first, machine):
                    n_words.append(n)
                    n_hit.append(sum(b - a for a, b in runs))
                    items.append(mine)
                    spans = [m.span() for m in _WORD.finditer(raw.decode())] if runs else []
                    hits.append([{"start": spans[a][0], "end": spans[b - 1][1]} for a, b in runs])
                new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*keep, *added])

        return run

    parts = list_ahead(benchmark_windows(benchmark, width=width))
    first = True
    for part, last in parts:
        shipped = context.broadcast(part)
        if last:
            break
        wide = T.StructType([*rows.schema[: len(keep) + 1], T.StructField("__leafmill_runs", pair), T.StructField("__leafmill_items", names)])
        before, rows = rows, stored(rows.mapInArrow(gathered(shipped, first), wide))
        discard(before)
        first = False
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(span)]
    schema = T.StructType([*docs.select(*keep).schema, *map(T.StructField, added, kinds)])
    return rows.mapInArrow(finished(shipped, first), schema)


def list_ahead(parts: Iterator[dict[str, list[str]]]) -> Iterator[tuple[dict[str, list[str]], bool]]:
    """Each part, and whether it is the last."""
    held = next(parts)
    for part in parts:
        yield held, False
        held = part
    yield held, True
