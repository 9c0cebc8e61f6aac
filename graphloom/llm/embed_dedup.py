"""Near pairs of vectors by spherical-cap filters.

A filter is the sum of one random direction of each block of coordinates (a random product code,
after a fixed random rotation). Each vector is list-decoded to all filters that it exceeds ``cap``
with: blocks are added one after the other, and a partial sum stays only while the best remaining
blocks can still lift it over the cap. Vectors meet at common filters and are verified by their
cosine in double precision; a pair counts only at its first common filter, so no pair is
shuffled: a task returns link counts and a spanning forest.

The code grows with the table (``shape``): there is one filter for every two vectors, and the cap is what a
random vector exceeds with 28 of them, so a filter holds some 56 vectors and the work grows as the table does. For a
vector that exceeds fewer than 16 filters the cap is lowered. Two vectors at cosine 0.95 share about half of their filters.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, local_forest, partitions

COSINE = 0.95
FILTERS, LEAST = 28, 16  # of each vector: expected, and at least
WORDS = 256  # most directions of a block
TILE = 1024


def shape(n: int) -> tuple[int, int, float]:
    """Blocks, directions of each block and cap (in standard deviations of a random vector) for ``n`` vectors."""
    filters, blocks = max(256, n // 2), 2
    while filters > WORDS**blocks:
        blocks += 1
    words = 2
    while words**blocks < filters:
        words += 1
    return blocks, words, NormalDist().inv_cdf(1 - FILTERS / words**blocks)


class Code:
    """Random product code for vectors of one dimension."""

    def __init__(self, dim: int, blocks: int, words: int, cap: float, seed: int = 20240607):
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.parts = np.array_split(np.arange(dim), min(blocks, dim))
        self.words = [rng.standard_normal((len(p), words)) for p in self.parts]
        for w in self.words:
            w /= np.linalg.norm(w, axis=0) * np.sqrt(len(self.parts))
        self.cap = cap / np.sqrt(dim)

    def decode(self, unit: np.ndarray, least: int) -> list[np.ndarray]:
        """Filters of each row: numbers in base ``words``, one digit for each block.

        A row that exceeds the cap with fewer than ``least`` filters is decoded again with a lower cap.
        """
        step = max(16, (1 << 16) // max(w.shape[1] for w in self.words))  # partial sums of many words take memory
        if len(unit) > step:
            return [f for i in range(0, len(unit), step) for f in self.decode(unit[i : i + step], least)]
        x = unit @ self.turn
        scores = [x[:, p] @ w for p, w in zip(self.parts, self.words)]
        least = min(least, int(np.prod([s.shape[1] for s in scores])))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
        open_, cap = np.arange(len(x)), self.cap
        while len(open_):
            found = self._exceeding([s[open_] for s in scores], cap)
            enough = np.array([len(f) >= least for f in found], bool)
            for i, f in zip(open_[enough].tolist(), (f for f, e in zip(found, enough) if e)):
                out[i] = f
            open_, cap = open_[~enough], cap - 0.1 * abs(self.cap)
        return out

    @staticmethod
    def _exceeding(scores: list[np.ndarray], cap: float) -> list[np.ndarray]:
        n = len(scores[0])
        best = [s.max(1) for s in scores]
        rest = np.concatenate([np.cumsum(best[::-1], 0)[::-1], np.zeros((1, n))])
        row, value, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        for k, s in enumerate(scores):
            sums = total[:, None] + s[row]
            i, j = np.nonzero(sums + rest[k + 1][row][:, None] >= cap)
            row, value, total = row[i], value[i] * s.shape[1] + j, sums[i, j]
        order = np.argsort(row, kind="stable")
        return np.split(value[order], np.cumsum(np.bincount(row, minlength=n))[:-1])


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id and key of each row, usable: key tells equal arrays; null if the vector links with nothing."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    key = F.sha2(F.array_join(F.transform("embedding", lambda v: v.cast("string")), ","), 256)
    return vectors.select("vec_id", "embedding", F.when(F.coalesce(sound, F.lit(False)), key).alias("key"))


def _filters(blocks: int, words: int, cap: float, least: int, kind: str):
    def run(batches):
        codes: dict[int, Code] = {}
        for batch in batches:
            rep, size, vectors = (batch.column(k) for k in range(3))
            lengths = np.array([len(v) for v in vectors.to_pylist()]) if batch.num_rows else np.zeros(0, int)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = np.array(vectors.take(pa.array(at)).flatten()).reshape(-1, dim)
                unit = _unit(x)
                code = codes.setdefault(int(dim), Code(int(dim), blocks, words, cap))
                found = code.decode(unit, least)
                n = [len(f) for f in found]
                row = np.repeat(np.arange(len(at)), n)
                lists = [f.astype("<i8").tobytes() for f in found]
                bodies = [v.tobytes() for v in x.astype(kind)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(found or [np.zeros(0, np.int64)])),
                        pa.array(np.full(len(row), dim, np.int64)),
                        rep.take(pa.array(at[row])),
                        size.take(pa.array(at[row])),
                        pa.array([bodies[i] for i in row], pa.binary()),
                        pa.array([lists[i] for i in row], pa.binary()),
                    ],
                    names=["filter", "dim", "rep", "size", "body", "filters"],
                )

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verify(cosine: float, kind: str):
    def pairs(x, y, lists_x, lists_y, own: int, same: bool):
        for a in range(0, len(x), 256):
            i, j = np.nonzero(x[a : a + 256] @ y.T >= cosine)
            i = i + a
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            first = np.fromiter((min(lists_x[p] & lists_y[q]) == own for p, q in zip(i.tolist(), j.tolist())), bool, len(i))
            yield i[first], j[first]

    def group(rows: pa.Table):
        """Rows of one filter and tile pair: link counts and a forest."""
        tile, ta, tb = (rows.column(k).to_numpy() for k in ("tile", "ta", "tb"))
        rep, size = rows.column("rep").to_numpy(), rows.column("size").to_numpy()
        unit = _unit(np.frombuffer(b"".join(rows.column("body").to_pylist()), kind).reshape(len(rep), -1))
        lists = [frozenset(np.frombuffer(b, "<i8").tolist()) for b in rows.column("filters").to_pylist()]
        own, same = int(rows.column("filter")[0].as_py()), ta[0] == tb[0]
        left = np.arange(len(rep)) if same else np.flatnonzero(tile == ta[0])
        right = left if same else np.flatnonzero(tile == tb[0])
        links, a, b = np.zeros(len(rep), np.int64), [], []
        for i, j in pairs(unit[left], unit[right], [lists[k] for k in left], [lists[k] for k in right], own, same):
            i, j = left[i], right[j]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            a.append(i)
            b.append(j)
        if not links.any():
            return
        node, root = local_forest(len(rep), np.concatenate(a), np.concatenate(b))
        some = np.flatnonzero(links)
        yield rep[some], np.full(len(some), -1), links[some], np.ones(len(some), bool)
        yield rep[node], rep[root], np.zeros(len(node), np.int64), np.zeros(len(node), bool)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            whole = pa.Table.from_batches([*held, batch])
            key = np.stack([whole.column(k).to_numpy() for k in ("dim", "filter", "ta", "tb")])
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1]) if key.shape[1] else [0]
            for a, b in zip(starts[:-1], starts[1:]):
                yield from map(batch_of, group(whole.slice(a, b - a)))
            held = whole.slice(int(starts[-1])).combine_chunks().to_batches()
        if held:
            yield from map(batch_of, group(pa.Table.from_batches(held)))

    def batch_of(cols):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "links", "count"])

    return run


def near_pairs(reps: DataFrame, cosine: float = COSINE, blocks: int | None = None, words: int | None = None, cap: float | None = None, least: int = LEAST, tile: int = TILE) -> DataFrame:
    """From rep, size, embedding: rows (a, links, count=true) with partial link counts, and (a, b) forest edges.

    A filter met by more than ``tile`` vectors is dealt out in tiles, and every pair of its tiles is
    compared in a task of its own. The code is that of ``shape`` where it is not given.
    """
    own = shape(reps.count())
    blocks, words, cap = (x if x is not None else y for x, y in zip((blocks, words, cap), own))
    kinds = "filter long, dim long, rep long, size long, body binary, filters binary"
    kind = "<f4" if reps.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    met = cut(reps.select("rep", "size", "embedding").mapInArrow(_filters(blocks, words, cap, least, kind), kinds))
    tiles = met.groupBy("dim", "filter").agg(F.ceil(F.count("*") / tile).cast("int").alias("k"))
    dealt = (
        met.join(tiles, ["dim", "filter"])
        .withColumn("tile", F.pmod(F.xxhash64("rep"), "k").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})
        .drop("k", "other")
    )
    n = partitions(reps.sparkSession)
    keys = ["dim", "filter", "ta", "tb"]
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(_verify(cosine, kind), "a long, b long, links long, count boolean")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **code) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Equal arrays are one class before any comparison and link with each other. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of
    different dimensions. Rows with a null vec_id take part and count as links; they name no
    component unless all members are such rows (component null, not kept). Other columns are
    ignored. An empty table gives an empty table.
    """
    rows = classes(vectors)
    found = cut(
        rows.where("key is not null").groupBy("key")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("embedding").alias("embedding"))
        .withColumn("rep", F.xxhash64("key"))
    )
    out = cut(near_pairs(found, cosine, **code))
    links = out.where("count").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    groups = components(out.where("not count").select("a", "b")).withColumnsRenamed({"node": "rep", "component": "group"})
    named = cut(
        found.drop("embedding").join(links, "rep", "left").join(groups, "rep", "left")
        .withColumn("group", F.coalesce("group", "rep"))
    )
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    by_key = cut(
        named.join(least, "group").select("key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    linked = rows.select("vec_id", "key").join(by_key, "key", "left")
    return linked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("key").isNull() | (F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
