"""Where windows of a fixed length repeat: the distributed frame of both substring operators.

A window's smallest k-gram hash (its anchor) has the same place in every equal window, so equal
windows meet at one anchor value. Steps, each a Spark job over all documents:

1. count anchor values, with counts pre-added in each task; keep those met more than once;
2. join them back to (anchor, document) pairs: a hot value is split by the skew join;
3. join each document's repeated anchors to its text and cut one segment for each anchor run (the
   consecutive windows with that anchor); equal segments of a batch are one row with a count;
4. bring segments with one anchor together and let the operator look at them (``grouped``); anchors with more
   than ``HOT`` rows are taken apart into windows, which are aggregated by their hashes (``split``);
5. join what the operator found back to the texts.

Texts travel compressed. Documents are told apart by doc_id and hash of the text (d, x); a null doc_id
counts as larger than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, minimizers, partitions

LAST = (1 << 63) - 1
HOT = 2000


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``grams`` gives the hashes of all k-grams of a text."""

    window: int
    gram: int
    grams: Callable[[bytes, int], np.ndarray]
    segment: Callable[[bytes, np.ndarray, np.ndarray], list[bytes]]  # text, first, past the last window

    @property
    def width(self) -> int:
        return self.window - self.gram + 1

    def runs(self, data: bytes):
        h = self.grams(data, self.gram)
        place, lo, hi = minimizers(h, self.width)
        return h[place], place, lo, hi


@dataclass
class Segments:
    """Distinct segments with complete anchor groups, in the order of their anchors."""

    anchor: np.ndarray
    off: np.ndarray  # place of the anchor in the segment
    n: np.ndarray  # windows
    body: list[bytes]
    count: np.ndarray
    doc: np.ndarray
    text: np.ndarray
    lo: np.ndarray  # first window of the first occurrence
    sid: list[bytes]


def signed(data: bytes) -> int:
    x = xxhash.xxh64_intdigest(data)
    return x - (1 << 64) if x >> 63 else x


def _ints(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def packed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rest (the columns to keep), d (doc_id, the largest long for null), x (hash of the text), z (compressed text, null: empty)."""
    rows = docs.select(
        F.struct(*keep).alias("rest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), "text"
    )

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            x, z = pa.array([signed(t) for t in texts], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), x, z], names=["rest", "d", "x", "z"])

    fields = [rows.schema["rest"], *T.StructType.fromDDL("d long, x long, z binary").fields]
    return rows.mapInArrow(run, T.StructType(fields))


def _values(docs: DataFrame, unit: Unit) -> DataFrame:
    def run(batches):
        for batch in batches:
            h = [unit.runs(x.as_py() or b"")[0] for x in batch.column(1).cast(pa.binary())]
            v, n = np.unique(np.concatenate(h or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, n long")


def _pairs(docs: DataFrame, unit: Unit) -> DataFrame:
    def run(batches):
        for batch in batches:
            d = _ints(batch.column(0).fill_null(LAST))
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            h = [np.unique(unit.runs(t)[0]) for t in texts]
            n = [len(v) for v in h]
            of, x = np.repeat(d, n), np.repeat(np.array([signed(t) for t in texts], np.int64), n)
            v = np.concatenate(h or [np.zeros(0, np.uint64)]).view(np.int64)
            for i in range(0, len(v), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)]) for c in (v, of, x)], names=["h", "d", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h long, d long, x long")


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """d, x, hs: the repeated anchor values of each document that has any; equal documents are one row."""
    counted = _values(docs, unit).groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    repeated = cut(counted)
    return cut(_pairs(docs, unit).join(repeated, "h").groupBy("d", "x").agg(F.collect_set("h").alias("hs")))


_SEGMENT = "h long, off int, n int, body binary, count long, d long, x long, lo long, sid binary"
_PLACES = "places array<struct<d:long,x:long,lo:long>>"


def segments(packed_docs: DataFrame, found: DataFrame, unit: Unit, places: bool = False) -> DataFrame:
    """One row for each distinct segment of a batch: its count, its first occurrence and a hash (sid); its ``places``, if wanted."""

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            rows: dict[tuple, list] = {}
            for d, x, z, hs in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                data = unpress.decompress(z)
                h, place, lo, hi = unit.runs(data)
                at = np.flatnonzero(np.isin(h, _ints(hs.values).view(np.uint64)))
                if not len(at):
                    continue
                bodies = unit.segment(data, lo[at], hi[at])
                for key, n, a in zip(zip(h[at].tolist(), (place - lo)[at].tolist(), bodies), (hi - lo)[at].tolist(), lo[at].tolist()):
                    row = rows.get(key)
                    if row is None:
                        rows[key] = [n, 1, (d, x, a), [(d, x, a)]]
                    else:
                        row[1] += 1
                        row[2] = min(row[2], (d, x, a))
                        if places:
                            row[3].append((d, x, a))
            sid = [xxhash.xxh3_128_digest(k[2], (k[0] + k[1]) & LAST) for k in rows]
            cols = [
                pa.array(np.array([k[0] for k in rows], np.uint64).view(np.int64)),
                pa.array([k[1] for k in rows], pa.int32()),
                pa.array([v[0] for v in rows.values()], pa.int32()),
                pa.array([k[2] for k in rows], pa.binary()),
                pa.array([v[1] for v in rows.values()], pa.int64()),
                *(pa.array([v[2][k] for v in rows.values()], pa.int64()) for k in range(3)),
                pa.array(sid, pa.binary()),
            ]
            if places:
                flat = np.array([p for v in rows.values() for p in v[3]], np.int64).reshape(-1, 3)
                ends = np.cumsum([0, *(len(v[3]) for v in rows.values())])
                inner = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["d", "x", "lo"])
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kinds = T.StructType.fromDDL(f"{_SEGMENT}, {_PLACES}" if places else _SEGMENT)
    names = kinds.names
    both = packed_docs.join(found, ["d", "x"]).select("d", "x", "z", "hs")
    return both.mapInArrow(run, kinds)


def split(parts: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Segments of anchors with at most ``hot`` rows, which fit one task, and those of the others."""
    many = cut(parts.groupBy("h").count().where(F.col("count") > hot).select("h"))
    return parts.join(many, "h", "left_anti"), parts.join(many, "h", "left_semi")


def _distinct(table: pa.Table) -> Segments:
    rows: dict[tuple, int] = {}
    h, off, n, count, d, x, lo = (table.column(k).to_numpy() for k in ("h", "off", "n", "count", "d", "x", "lo"))
    body = table.column("body").to_pylist()
    kept, count, first = [], count.copy(), []
    for i, key in enumerate(zip(h.tolist(), off.tolist(), body)):
        k = rows.setdefault(key, i)
        if k == i:
            kept.append(i)
            first.append(i)
        else:
            count[k] += count[i]
    best = {i: (d[i], x[i], lo[i]) for i in kept}
    for i, key in enumerate(zip(h.tolist(), off.tolist(), body)):
        k = rows[key]
        if k != i:
            best[k] = min(best[k], (d[i], x[i], lo[i]))
    at = np.array(kept, np.int64)
    where = np.array([best[i] for i in kept], np.int64).reshape(-1, 3)
    return Segments(h[at], off[at].astype(np.int64), n[at].astype(np.int64), [body[i] for i in kept], count[at], *where.T, table.column("sid").take(pa.array(at)).to_pylist())


_STAYS = "d long, x long, a long, b long"


def grouped(found: DataFrame, handle: Callable[[Segments], Iterator[pa.RecordBatch]], schema: str, rows: int = 12_000) -> DataFrame:
    """Deal segments out by anchor and apply ``handle`` to about ``rows`` of them at a time, anchor groups whole."""

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < rows:
                continue
            whole = pa.Table.from_batches(held)
            h = whole.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1]))  # the last group may go on
            for a, b in _starts(h[:end], rows):
                yield from handle(_distinct(whole.slice(a, b - a)))
            held = whole.slice(end).combine_chunks().to_batches()
            size = whole.num_rows - end
        if size:
            whole = pa.Table.from_batches(held)
            for a, b in _starts(whole.column("h").to_numpy(), rows):
                yield from handle(_distinct(whole.slice(a, b - a)))

    n = partitions(found.sparkSession)
    return found.repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, schema)


def stay_ranges(s: Segments, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, text, first window, past the last) of the runs that ``table`` marks, by segment and distance to the anchor."""
    stay = np.zeros((len(s.n), table.shape[1] + 2), bool)
    stay[:, 1:-1] = table
    step = np.diff(stay.astype(np.int8), axis=1)
    (seg, g0), (_, g1) = np.nonzero(step == 1), np.nonzero(step == -1)
    place = (s.lo + s.off)[seg]
    return s.doc[seg], s.text[seg], place - g1 + 1, place - g0 + 1


def survivors(found: DataFrame, analyse: Callable[[Segments], np.ndarray]) -> DataFrame:
    """d, x, a, b: windows a to b - 1 of that document that ``analyse`` says stay.

    ``analyse`` returns a table of booleans: by segment, and by distance from window to anchor.
    """

    def handle(s: Segments):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in stay_ranges(s, analyse(s))], names=["d", "x", "a", "b"])

    return grouped(found, handle, _STAYS)


def _starts(h: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """Slices of about ``rows`` sorted values that don't split a value."""
    out, a = [], 0
    while a < len(h):
        b = min(len(h), a + rows)
        if b < len(h):
            c = int(np.searchsorted(h, h[b]))
            b = c if c > a else int(np.searchsorted(h, h[b], side="right"))
        out.append((a, b))
        a = b
    return out


def marked(data: bytes, hs: np.ndarray, stays: list, unit: Unit) -> np.ndarray | None:
    """Which units of the text a repeated window covers, None if it holds no window. stays: (a, b) of windows that stay."""
    h, _, lo, hi = unit.runs(data)
    if not len(h):
        return None
    n = int(hi[-1]) + unit.window
    step = np.zeros(n + 1, np.int64)
    keep = np.isin(h, hs)
    np.add.at(step, lo[keep], 1)
    np.add.at(step, hi[keep], -1)
    windows = np.cumsum(step)[: n - unit.window] > 0
    for s in stays:
        windows[s["a"] : s["b"]] = False
    return _covered(windows, unit.window)


def _covered(windows: np.ndarray, length: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(windows)])
    n = len(windows) + length - 1
    i = np.arange(n)
    return total[np.minimum(i + 1, len(windows))] > total[np.maximum(i - length + 1, 0)]


def resolve(docs: DataFrame, unit: Unit, find: Callable[..., DataFrame], finish: Callable[..., tuple], schema: str, keep: tuple[str, ...], places: bool = False) -> DataFrame:
    """Apply ``finish(text, hs, notes)`` to every row of ``docs``: the columns of ``keep``, then its columns.

    ``find(segments, anchors)`` gives d, x, hs and notes for documents; others get None for both.
    """
    texts = packed(docs, keep)
    found = anchors(docs, unit)
    known = cut(find(cut(segments(texts, found, unit, places)), found).select("d", "x", "hs", "notes"))

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for z, hs, notes in zip(batch.column("z").to_pylist(), batch.column("hs"), batch.column("notes")):
                out.append(finish(unpress.decompress(z), _ints(hs.values).view(np.uint64) if hs.is_valid else None, notes.as_py()))
            cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), *cols], names=["rest", *names])

    added = T.StructType.fromDDL(schema)
    names = added.names
    kinds = [{"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()] for f in added]
    both = texts.join(known, ["d", "x"], "left").select("rest", "z", "hs", "notes")
    done = both.mapInArrow(run, T.StructType([both.schema["rest"], *added.fields]))
    return done.select("rest.*", *(F.col(f"`{n}`") for n in names))
