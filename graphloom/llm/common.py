"""Shared pieces of the training-data operators: shared storage, hashing, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut

__all__ = ["components", "cut", "local_forest", "minimizers", "mix", "of_bytes", "partitions", "Rolling", "row_key", "table", "word_bounds", "word_hashes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """A key of the row's doc_id and text, never null: rows without an id, or with a shared one, differ by their texts."""
    text = F.when(F.col("text").isNull(), "n").otherwise(F.concat(F.lit("t"), "text"))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- hashing inside tasks

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240601).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Prefix hashes of a sequence of 64-bit symbols: the hash of any slice in constant time."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _power_tables(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def windows(self, k: int) -> np.ndarray:
        """Hash of every slice of length k, in order."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def of_bytes(data: bytes) -> Rolling:
    return Rolling(_BYTES[np.frombuffer(data, np.uint8)])


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in UTF-8 bytes."""
    edge = np.zeros(len(data) + 2, np.int8)
    edge[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: bytes) -> np.ndarray:
    start, end = word_bounds(data)
    return of_bytes(data).slices(start, end) if len(start) else np.zeros(0, np.uint64)


_PLACE_BITS = 24
_PLACE = np.uint64((1 << _PLACE_BITS) - 1)


def minimizers(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``width`` hashes that have one smallest hash (its upper 40 bits; leftmost on ties).

    Returns (place of the smallest hash, first window, one past the last window) for each run.
    Equal windows have their smallest hash at the same place, wherever they are.
    """
    parts, step = [], (1 << _PLACE_BITS) - width
    for base in range(0, max(0, len(h) - width + 1), step):
        part = h[base : base + step + width - 1]
        m, s = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * s <= width:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        if s < width:
            m = np.minimum(m[: len(m) - (width - s)], m[width - s :])
        place = (m & _PLACE).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parts.append((place[at] + base, at + base, np.append(at[1:], len(place)) + base))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its group) of the groups that links a-b form among n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for every node of ``edges(a, b)``: columns node, component.

    Alternates large-star and small-star rounds; each round is an aggregation and a join of
    tables in the shared folder, so a node with very many links is split by the skew join.
    Null ends and self links are ignored; an empty input gives an empty table.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b").distinct()
    )
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        big = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        big = cut(big)
        # small star: u and its smaller neighbours point to the smallest of them
        low = cut(big.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))
        new = (
            big.withColumnRenamed("a", "u").join(low, "u").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        new = cut(new)
        now = new.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        e = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
