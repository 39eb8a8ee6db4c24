"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is a set of windows of 13 consecutive words, a window a set of
five-word shingles.  A document contains a window only if it contains every
shingle of it, so at containment 1 the necessary prefix of a window is its one
rarest shingle.  Shingles are ordered by the number of documents that have
them, counted over all documents.  The scan looks up the prefix shingles of a
document, bounds each candidate by position and length (the window must lie
inside the document), and compares the item-sized window word by word.

Defined results for odd input: a null or empty text has no words and is never
contaminated; an item without words has no window; an item of fewer than 13
words is one window; a null item_id counts as the empty string; repeated rows
and repeated items each keep their own result; further columns are ignored.

Distinct windows with their items are read in blocks of at most about
``BLOCK_ROWS`` rows, chosen by hash; every block is sent to the executors in
turn, so what is broadcast is bounded while every window is looked up.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import batched, releasing, rows_of, words, written

WINDOW = 13
SHINGLE = 5
BLOCK_ROWS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20

_SPANS = "array<struct<start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (window, item_id) rows; a window is its words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for item, text in rows_of(batches):
                found = words(text)
                for start in range(max(1, len(found) - window + 1) if found else 0):
                    yield b" ".join(found[start : start + window]), item or ""

        yield from batched(rows(), pa.schema([("window", pa.binary()), ("item_id", pa.string())]), 20_000)

    chosen = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(run, "window binary, item_id string").distinct()


class _Lookup:
    """Sorted 64-bit codes behind a bit table that turns most misses away."""

    def __init__(self, codes: list[int]):
        self.codes = np.array(sorted(set(codes)), dtype=np.uint64)
        self.bits = np.zeros(1 << _SLOT_BITS, dtype=bool)
        self.bits[self._slots(self.codes)] = True

    @staticmethod
    def _slots(codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known codes and the codes' places in the sorted list."""
        positions = np.flatnonzero(self.bits[self._slots(codes)])
        wanted = codes[positions]
        places = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        known = self.codes[places] == wanted
        return positions[known], places[known]


class WindowIndex:
    """The windows of one block and, once rarity is known, their prefix shingles."""

    def __init__(self, rows: list[tuple[bytes, str]], shingle: int):
        self.shingle = shingle
        self.items: dict[bytes, tuple[str, ...]] = {}
        for window, item in rows:
            self.items[window] = (*self.items.get(window, ()), item)
        self.ids: dict[bytes, int] = {}
        for window in self.items:
            for word in window.split(b" "):
                self.ids.setdefault(word, len(self.ids) + 1)
        self.windows = [self.word_ids(window.split(b" ")) for window in self.items]
        by_size: dict[int, list[int]] = defaultdict(list)
        for ids in self.windows:
            by_size[min(shingle, len(ids))] += self.shingles(ids, min(shingle, len(ids))).tolist()
        self.lookups = {size: _Lookup(codes) for size, codes in by_size.items()}
        self.offsets: dict[int, list[tuple[tuple[int, int], ...]]] = {}

    def word_ids(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, found, repeat(0)), np.uint64, len(found))

    @staticmethod
    def shingles(ids: np.ndarray, size: int) -> np.ndarray:
        if len(ids) < size:
            return np.empty(0, np.uint64)
        codes = ids[: len(ids) - size + 1].copy()
        for k in range(1, size):
            codes *= _MIX
            codes += ids[k : len(ids) - size + 1 + k]
        return codes

    def order_by_rarity(self, counts: dict[tuple[int, int], int]) -> None:
        """Keep of each window only its rarest shingle, with the shingle's offset and the window's length."""
        prefixes: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        for ids in self.windows:
            size = min(self.shingle, len(ids))
            codes = self.shingles(ids, size).tolist()
            offset = min(range(len(codes)), key=lambda k: (counts.get((size, codes[k]), 0), codes[k]))
            prefixes[size][codes[offset]].add((offset, len(ids)))
        self.lookups = {size: _Lookup(list(found)) for size, found in prefixes.items()}
        self.offsets = {
            size: [tuple(sorted(prefixes[size][int(code)])) for code in lookup.codes] for size, lookup in self.lookups.items()
        }
        self.windows = []

    def count(self, found: list[bytes], into: Counter) -> None:
        ids = self.word_ids(found)
        for size, lookup in self.lookups.items():
            _, places = lookup.find(self.shingles(ids, size))
            into.update((size, place) for place in np.unique(places).tolist())

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of all windows that occur in a document, and their items."""
        ids, spans, items = self.word_ids(found), [], set()
        for size, lookup in self.lookups.items():
            positions, places = lookup.find(self.shingles(ids, size))
            for position, place in zip(positions.tolist(), places.tolist()):
                for offset, length in self.offsets[size][place]:
                    start = position - offset
                    if start < 0 or start + length > len(found):
                        continue
                    hit = self.items.get(b" ".join(found[start : start + length]))
                    if hit:
                        spans.append((start, start + length))
                        items.update(hit)
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _indexes(documents: DataFrame, windows: DataFrame, shingle: int, block_rows: int) -> Iterator:
    """One broadcast index for each block of windows, prefixes chosen by document counts."""
    context = documents.sparkSession.sparkContext
    blocks = max(1, -(-windows.count() // block_rows))
    for block in range(blocks):
        chosen = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        index = WindowIndex([(bytes(r[0]), r[1]) for r in chosen.collect()], shingle)
        if not index.items:
            continue
        sent = context.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for (text,) in rows_of(batches):
                sent.value.count(words(text), total)
            rows = ((size, place, n) for (size, place), n in total.items())
            yield from batched(rows, pa.schema([("size", pa.int32()), ("place", pa.int64()), ("n", pa.int64())]), 20_000)

        # At most one row for each shingle of the block comes back.
        counted = (
            documents.select(F.col("text").cast("string").alias("text"))
            .mapInArrow(count, "size int, place long, n long")
            .groupBy("size", "place")
            .agg(F.sum("n").alias("n"))
            .collect()
        )
        index.order_by_rarity({(r.size, int(index.lookups[r.size].codes[r.place])): r.n for r in counted})
        yield context.broadcast(index)


def find_items(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, spans, item_ids (sorted as strings)."""
    windows = written(item_windows(items, window), "item_windows")
    frame = documents.select(
        "doc_id",
        F.col("text").cast("string").alias("text"),
        F.expr(f"cast(array() as {_SPANS})").alias("spans"),
        F.expr("cast(array() as array<string>)").alias("item_ids"),
    )
    sent = list(_indexes(documents, windows, shingle, block_rows)) or [None]
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    for number, index in enumerate(sent):
        last = number == len(sent) - 1

        def scan(batches: Iterator[pa.RecordBatch], index=index, last=last) -> Iterator[pa.RecordBatch]:
            for batch in releasing(batches):
                texts = batch.column(1).to_pylist()
                n_words, spans, item_ids = [], [], []
                for text, old, seen in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    found = words(text)
                    hit, known = index.value.scan(found) if index and found else ([], set())
                    n_words.append(len(found))
                    spans.append([{"start": a, "end": b} for a, b in merged(hit + [(s["start"], s["end"]) for s in old])])
                    item_ids.append(sorted(known.union(seen)))
                rest = [
                    pa.array(n_words, pa.int64()),
                    pa.array([sum(s["end"] - s["start"] for s in x) for x in spans], pa.int64()),
                ] if last else [batch.column(1)]
                names = ["doc_id", *(["n_words", "n_hit"] if last else ["text"]), "spans", "item_ids"]
                columns = [batch.column(0), *rest, pa.array(spans, _SPAN_TYPE), pa.array(item_ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names)

        middle = "n_words long, n_hit long" if last else "text string"
        frame = frame.mapInArrow(scan, f"doc_id {doc_type}, {middle}, spans {_SPANS}, item_ids array<string>")
    return frame


def contamination(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``find_items`` with the verdict: at least a twentieth of the words is hit."""
    found = find_items(documents, items, **how)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
