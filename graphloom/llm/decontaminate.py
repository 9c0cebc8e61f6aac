"""Benchmark passages in documents, by edit distance over words.

An item of n words leaks into a document if some span of it is within floor(0.2 n) word edits
(insert, delete, replace), that is at a similarity of 0.8 or more. Candidate windows of the
item's size come from exact seeds: floor(0.2 n) edits leave at least one of floor(0.2 n) + 1
disjoint pieces of the item whole, so every leak holds one. Item and window are then mapped by CGK
random walks (each step emits the current word and moves on or not by a shared random bit of step
and word), which turns few edits into a small Hamming distance. Windows that agree with the item on
all places of any sampled band are verified first, by the exact distance, and end the search if one
is a verbatim copy. The walks reject nothing: all other candidates are verified by the exact distance
too, overlapping ones as one stretch of text. So no leak within the bound is missed.

The benchmark is a stated query set: it is taken in blocks of at most ``block_bytes`` of text, and
each block is compared with all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, of_bytes, row_key, word_bounds

DISTANCE = 0.2
WALKS, BANDS, SAMPLES = 3, 32, 2
BLOCK_BYTES = 8 << 20
_FOLD = bytearray(range(256))
for _c in range(128):
    _FOLD[_c] = ord(chr(_c).lower()) if chr(_c).isalnum() else 0x20
_FOLD = bytes(_FOLD)


def words(data: bytes) -> np.ndarray:
    """Hashes of the words: A-Z lower-cased, other ASCII signs count as white space."""
    data = data.translate(_FOLD)
    start, end = word_bounds(data)
    return of_bytes(data).slices(start, end) if len(start) else np.zeros(0, np.uint64)


def embed(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """CGK walks over the windows ``symbols[start : start + size]``, side by side: (steps, windows)."""
    bits = np.random.default_rng(7919 + walk).integers(0, 1 << 64, steps, dtype=np.uint64)
    padded = np.append(symbols, np.uint64(0))
    out = np.zeros((steps, len(start)), np.uint64)
    at, end = start.copy(), np.minimum(start + size, len(symbols))
    for k in range(steps):
        x = np.where(at < end, padded[np.minimum(at, len(symbols))], np.uint64(0))
        out[k] = x
        at += ((bits[k] >> (x >> np.uint64(58))) & np.uint64(1)).astype(np.int64)
    return out


def places(n: int, walk: int, bands: int, samples: int) -> np.ndarray:
    """Sampled steps of the bands for an item of n words: (bands, samples)."""
    return np.random.default_rng(104729 + walk * 131 + n).integers(0, 2 * n, (bands, samples))


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least word edits between ``item`` and any span of ``text``, and where that span ends."""
    place = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != np.uint64(w)), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    end = int(np.argmin(row))
    return int(row[end]), end


def _stretches(start: np.ndarray, before: int, after: int) -> list[tuple[int, int]]:
    """The spans start - before to start + after of sorted starts, overlapping ones as one."""
    if not len(start):
        return []
    a, b = np.maximum(start - before, 0), start + after
    cut = np.flatnonzero(a[1:] >= b[:-1]) + 1
    return list(zip(a[np.append(0, cut)].tolist(), b[np.append(cut - 1, len(b) - 1)].tolist()))


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    edits: int


class Block:
    """A block of the benchmark, with its seeds and its walks."""

    def __init__(self, rows: list[tuple[int, str]], share: float):
        self.items = []
        for item_id, text in rows:
            w = words((text or "").encode())
            if len(w):
                self.items.append(Item(item_id, w, int(share * len(w) + 1e-9)))
        seeds: dict[int, list] = {}
        for k, item in enumerate(self.items):
            size = len(item.words) // (item.edits + 1)
            h = Rolling(item.words).windows(size)
            for p in range(item.edits + 1):
                seeds.setdefault(size, []).append((int(h[p * size]), k, p * size))
        self.seeds = {}
        for size, rows in seeds.items():
            rows.sort()
            self.seeds[size] = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
        self.walks = {}
        for k, item in enumerate(self.items):
            n = len(item.words)
            for w in range(WALKS):
                e = embed(item.words, np.zeros(1, np.int64), np.array([n]), w, 2 * n)[:, 0]
                at = places(n, w, BANDS, SAMPLES)
                self.walks[k, w] = (at, e[at])

    def leaks(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, about the first word, past the last word) for every item in the text."""
        found: set[tuple[int, int]] = set()
        for size, (seed, item, offset) in self.seeds.items():
            h = Rolling(text).windows(size)
            if not len(h):
                continue
            first = np.searchsorted(seed, h)
            hit = np.flatnonzero(seed[np.minimum(first, len(seed) - 1)] == h)
            for p in hit.tolist():
                k = int(first[p])
                while k < len(seed) and seed[k] == h[p]:
                    found.add((int(item[k]), p - int(offset[k])))
                    k += 1
        by_item: dict[int, list[int]] = {}
        for k, start in found:
            by_item.setdefault(k, []).append(start)
        out = []
        for k, starts in by_item.items():
            item = self.items[k]
            n = len(item.words)
            start = np.maximum(np.array(sorted(starts), np.int64), 0)
            start = np.unique(start)
            near = np.zeros(len(start), bool)
            for w in range(WALKS):
                at, want = self.walks[k, w]
                for i in range(0, len(start), 512):  # bounded memory for items met very often
                    e = embed(text, start[i : i + 512], np.full(len(start[i : i + 512]), n), w, 2 * n)
                    near[i : i + 512] |= (e[at] == want[:, :, None]).all(1).any(0)
            best = None
            for some in (start[near], start[~near]):
                for a, b in _stretches(some, item.edits, n + item.edits):
                    d, end = distance(item.words, text[a:b])
                    if d <= item.edits and (best is None or d < best[1]):
                        best = (item.item_id, d, max(a, a + end - n), a + end)
                        if not d:
                            break
                if best is not None and not best[1]:
                    break
            if best is not None:
                out.append(best)
        return out


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark's rows in blocks of bounded text, read one partition after the other."""
    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        rows.append((r.item_id, r.text))
        size += 4 * len(r.text) + 64
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = DISTANCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, edits, start, end: benchmark items found in documents, the best span of each.

    ``start`` (approximate) and ``end`` count words of the folded text. Null and wordless texts and
    items match nothing; items of fewer than 5 words match only exactly. Rows with null or repeated
    ids are compared like others, and repeated rows give repeated results. Other columns are
    ignored. Empty tables give an empty table.
    """
    return _leaks(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, share, block_bytes)


def _leaks(texts: DataFrame, benchmark: DataFrame, share: float, block_bytes: int) -> DataFrame:
    """``leaks`` of a table whose first column, of any type, names the rows and whose second is the text."""
    spark, out = texts.sparkSession, None
    name, kind = texts.dtypes[0]
    kinds = f"{name} {kind}, item_id long, edits int, start long, end long"
    for rows in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Block(rows, share))  # size bound by block_bytes

        def run(batches, shared=shared):
            block = shared.value
            for batch in batches:
                got = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                    if text.is_valid:
                        got.extend((doc, *x) for x in block.leaks(words(text.as_py())))
                cols = list(zip(*got)) or [[]] * 5
                types = (batch.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[name, "item_id", "edits", "start", "end"])

        part = texts.mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], kinds) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, share: float = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without any leak, all columns kept.

    Rows are told apart by doc_id and text: a leak takes no other row that shares its id or the lack of one.
    """
    keyed = docs.withColumn("_key", row_key())
    bad = _leaks(keyed.select("_key", "text"), benchmark, share, BLOCK_BYTES).select("_key").distinct()
    return keyed.join(bad, "_key", "left_anti").select(*docs.columns)
