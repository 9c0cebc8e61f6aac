"""Exact removal of repeated byte strings through sorted suffixes.

Segments that hold a repeated anchor (see ``repeats``) are sorted by the suffixes that begin at
the anchor: the blocks of each segment are the symbols of one text for ``suffixes.suffix_array``.
In that order, windows with equal bytes right of the anchor are neighbours; comparing bytes of
neighbours and the bytes left of the anchor settles each class of equal windows exactly up to a
64-bit hash of the left part, and the class's earliest window survives. An anchor with more segments than
one task should hold is taken apart: its windows are aggregated by their hashes, to the earliest of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTES, of_bytes
from .repeats import Segments, Unit, marked, resolve, split, survivors
from .suffixes import suffix_array

LENGTH = 100
GRAM = 24
BLOCK = 38
HOT = 20_000  # segments of one anchor that a task may hold, some 4 MB; taking one apart makes up to 77 windows of it


def _grams(data: bytes, k: int) -> np.ndarray:
    return of_bytes(data).windows(k)


def unit(length: int = LENGTH, gram: int = GRAM) -> Unit:
    def segment(data, lo, hi):
        return [data[a : b + length - 1] for a, b in zip(lo.tolist(), hi.tolist())]

    return Unit(length, gram, _grams, segment)


def _sorted(bodies: list[bytes], off: np.ndarray) -> np.ndarray:
    """Order of the segments by their bytes from the anchor on."""
    blocks = [[b[i : i + BLOCK] for i in range(a, len(b), BLOCK)] for b, a in zip(bodies, off.tolist())]
    rank = {b: k + 1 for k, b in enumerate(sorted({b for bs in blocks for b in bs}))}
    text, begin = [], np.zeros(len(blocks), np.int64)
    for k, bs in enumerate(blocks):
        begin[k] = len(text)
        text.extend(rank[b] for b in bs)
        text.append(0)
    of = np.full(len(text), -1, np.int64)
    of[begin] = np.arange(len(blocks))
    order = of[np.array(suffix_array(text), np.int64)]
    return order[order >= 0]


def analyser(length: int = LENGTH, gram: int = GRAM):
    width = length - gram + 1

    def analyse(s: Segments) -> np.ndarray:
        stay = np.zeros((len(s.n), width), bool)
        g = np.arange(width)
        has = (g <= s.off[:, None]) & (g > (s.off - s.n)[:, None])
        kinds, inverse, size = np.unique(s.anchor, return_inverse=True, return_counts=True)
        alone = size[inverse] == 1
        stay[alone] = has[alone]
        many = np.flatnonzero(~alone)
        if not len(many):
            return stay
        many = many[_sorted([s.body[i] for i in many], s.off[many])]
        off = s.off[many]
        right = np.zeros((len(many), length), np.uint8)
        left = np.zeros((len(many), width), np.uint8)
        for k, i in enumerate(many.tolist()):
            b = np.frombuffer(s.body[i], np.uint8)
            right[k, : len(b) - off[k]] = b[off[k] :]
            left[k, : off[k]] = b[: off[k]][::-1]
        place = (s.lo + s.off)[many]
        rank = np.empty(len(many), np.int64)
        rank[np.lexsort((place, s.text[many], s.doc[many]))] = np.arange(len(many))
        anchor, inside = s.anchor[many], has[many]
        prefix = np.zeros(len(many), np.uint64)
        for k in range(width):
            if k:
                prefix = (prefix ^ _BYTES[left[:, k - 1]]) * np.uint64(0x9E3779B97F4A7C15)
                prefix ^= prefix >> np.uint64(29)
            at = np.flatnonzero(inside[:, k])
            if not len(at):
                continue
            r = right[at, : length - k]
            new = (r[1:] != r[:-1]).any(1) | (anchor[at[1:]] != anchor[at[:-1]])
            run = np.concatenate([[0], np.cumsum(new)])
            order = np.lexsort((rank[at], prefix[at], run))
            run, p = run[order], prefix[at][order]
            first = np.concatenate([[True], (run[1:] != run[:-1]) | (p[1:] != p[:-1])])
            stay[many[at[order[first]]], k] = True
        return stay

    return analyse


def _spans(marks: np.ndarray) -> list[tuple[int, int]]:
    step = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def _kept(data: bytes, marks: np.ndarray | None) -> tuple[bytes, list[tuple[int, int]]]:
    if marks is None or not marks.any():
        return data, []
    return np.frombuffer(data, np.uint8)[~marks].tobytes(), _spans(marks)


def _first_windows(parts: DataFrame, length: int, most: int = 1 << 18) -> DataFrame:
    """d, x, a, b: the earliest place of every window of ``parts``, by the window's hash and its anchor; first inside each task."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                cols = windows(batch.slice(i, 256))
                held.append(cols)
                size += len(cols[0])
                if size >= most:
                    held = [earliest(held)]
                    size = len(held[0][0])
                    if 2 * size >= most:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in earliest(held)], names=names)

    def windows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        h, off, n, d, x, lo = (np.asarray(part.column(k)).astype(np.int64) for k in ("h", "off", "n", "d", "x", "lo"))
        e = [of_bytes(body).windows(length) for body in part.column("body").to_pylist()]
        seg = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        return h[seg], off[seg] - nth, np.concatenate(e).view(np.int64), d[seg], x[seg], lo[seg] + nth

    def earliest(held: list) -> list[np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort(cols[::-1])
        key = [c[order] for c in cols[:3]]
        first = np.concatenate([[True], (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])])
        return [c[order[first]] for c in cols]

    names = ["h", "g", "e", "d", "x", "a"]
    found = parts.drop("sid").mapInArrow(run, "h long, g long, e long, d long, x long, a long")
    first = found.groupBy("h", "g", "e").agg(F.min(F.struct("d", "x", "a")).alias("at"))
    return first.select("at.d", "at.x", "at.a", (F.col("at.a") + 1).alias("b"))


def finder(length: int = LENGTH, hot: int = HOT):
    def find(parts: DataFrame, anchors: DataFrame) -> DataFrame:
        cold, many = split(parts, hot)
        stays = survivors(cold, analyser(length)).unionByName(_first_windows(many, length))
        notes = stays.groupBy("d", "x").agg(F.collect_list(F.struct("a", "b")).alias("notes"))
        return anchors.join(notes, ["d", "x"], "left")

    return find


def _marks(data: bytes, hs: np.ndarray | None, notes: list | None, length: int) -> np.ndarray | None:
    return None if hs is None else marked(data, hs, notes or [], unit(length))


def dedup(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Every row of ``docs`` with ``text`` less its repeated bytes; all other columns are kept.

    A byte goes if a ``length``-byte string that also starts earlier (in a smaller doc_id, or
    earlier in the same document) covers it; strings are judged on the input. Null texts become
    empty. A null doc_id comes after all others; rows with one doc_id and different texts are
    ordered by a hash of the text, and rows equal in both are one document and keep the same.
    Anchors with more than ``hot`` distinct segments are split; the result does not depend on it.
    Bytes left over from a character that was cut apart are dropped from the text. An empty table
    gives an empty table.
    """

    def finish(data, hs, notes):
        return (_kept(data, _marks(data, hs, notes, length))[0].decode("utf-8", "ignore"),)

    keep = tuple(c for c in docs.columns if c != "text")
    done = resolve(docs, unit(length), finder(length, hot), finish, "text string", keep)
    return done.select(*docs.columns)


def digests(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left) by row; see ``dedup``."""

    def finish(data, hs, notes):
        kept, spans = _kept(data, _marks(data, hs, notes, length))
        return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return resolve(docs, unit(length), finder(length, hot), finish, schema, ("doc_id",))
