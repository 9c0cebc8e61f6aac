"""Best-fit packing of token sequences by length patterns.

Documents are tokenized inside tasks; only the histogram of piece lengths (at most ``size`` rows,
whatever the input) reaches the driver. There, patterns of few lengths that fill a sequence are
fitted to the histogram by non-negative least squares, rounded, and what is left is packed by
best fit on the histogram, many equal sequences at a time. The plan, again bounded by ``size``
and not by the input, is joined back to the pieces by length and by rank within the length.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SIZE = 2048
END = 0
_state: dict[str, Encoder] = {}


# ---------------------------------------------------------------- tokenizing, inside tasks


class Encoder:
    """Token ids as bytes (little-endian unsigned 32-bit), by a tokenizer file of the ``tokenizers`` library.

    A plain byte-level tokenizer always begins a new word at a space between two other characters that are no
    white space, whatever stands around them; its texts are cut there, and each distinct word is encoded
    once and remembered. A word of Latin letters with signs behind it goes to the tokenizer's model at once, since
    only its letters and its signs can be one unit each; all others, and texts for any other file, go through
    the whole tokenizer. So do texts in which the string of a special token stands: it is that token, as for the file as it loads.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)  # for texts and words in which no special token stands: it need not look for any
        self.words.encode_special_tokens = True
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = _starts_words_at_spaces(spec)
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}

    def _encode(self, texts: list[str], whole: bool = False) -> list[bytes]:
        found = (self.tokenizer if whole else self.words).encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _unit(self, shown: str) -> bytes:
        if shown not in self.units:
            self.units[shown] = array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()
        return self.units[shown]

    def _word(self, word: str) -> bytes | None:
        """Ids of a space and ``word``, or None if it has anything but letters, signs behind them and single line feeds."""
        parts, out = [_SIMPLE.fullmatch(x) for x in word.split("\n")], []
        if None in parts:
            return None
        for k, m in enumerate(parts):
            out += [self._unit(_SHOWN["\n"])] if k else []
            out.append(self._unit(("" if k else _SHOWN[" "]) + m[1].translate(_LETTERS)))
            out += [self._unit(m[2])] if m[2] else []
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._encode(texts, whole=True)
        marked = [k for k, x in enumerate(texts) if any(m in x for m in self.marks)]
        if marked:
            whole = dict(zip(marked, self._encode([texts[k] for k in marked], whole=True)))
            plain = iter(self.encode([x for k, x in enumerate(texts) if k not in whole]))
            return [whole[k] if k in whole else next(plain) for k in range(len(texts))]
        known = self.known
        for cache in (known, self.units):
            if len(cache) > _CACHE:
                cache.clear()
        words = [_CUT.split(x) if _RUN.search(x) else x.split(" ") for x in texts]
        rest = []
        for w in {w for ws in words for w in ws[1:]}:
            if w not in known:
                ids = self._word(w)
                if ids is None:
                    rest.append(w)
                else:
                    known[w] = ids
        known.update(zip(rest, self._encode([f" {w}" for w in rest])))
        first = self._encode([ws[0] for ws in words])
        return [a + b"".join(map(known.__getitem__, ws[1:])) for a, ws in zip(first, words)]


_CACHE = 400_000  # words of one worker, some 70 MB
_CUT = re.compile(r"(?<=\S) (?=\S)")
_RUN = re.compile(r"\s (?:\s|\Z)")  # a space that is part of a longer run or ends one: not every space begins a word there
_SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-/:-@\[-`{-~]*)")


def _shown() -> dict[str, str]:
    """How byte-level tokenizers write the characters up to U+024F: visible bytes as they are, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [x for x in range(256) if x not in visible]
    of = {x: chr(x) for x in visible} | {x: chr(256 + k) for k, x in enumerate(hidden)}
    return {chr(c): "".join(of[b] for b in chr(c).encode()) for c in range(0x250)}


_SHOWN = _shown()
_LETTERS = str.maketrans({c: s for c, s in _SHOWN.items() if c.isalpha()})


def _starts_words_at_spaces(spec: dict) -> bool:
    """Whether the file is a byte-level one that takes words by its usual pattern, from the text as it is."""
    before = spec.get("pre_tokenizer") or {}
    return spec.get("normalizer") is None and all(t["special"] for t in spec["added_tokens"]) and (
        before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)
    ) == ("ByteLevel", False, True)


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, kept between tasks."""
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and where a task met it: task, nth (of that length)."""

    def run(batches):
        enc, stop = encoder(tokenizer), np.array([end], "<u4").tobytes()
        met = np.zeros(size + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows: list[list] = [[] for _ in range(5)]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode([x or "" for x in part.column(1).to_pylist()])):
                    ids += stop
                    n = len(ids) // 4
                    first = n % size or size  # the first piece may be shorter, the rest are full
                    at = 0
                    for k, length in enumerate([first] + [size] * ((n - first) // size)):
                        for col, v in zip(rows, (doc, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]))):
                            col.append(v)
                        at += length
                lengths = np.array(rows[3], np.int64)
                order = np.argsort(lengths, kind="stable")
                kinds, begin, count = np.unique(lengths[order], return_index=True, return_counts=True)
                nth = np.empty(len(lengths), np.int64)
                nth[order] = np.arange(len(lengths)) - np.repeat(begin, count) + np.repeat(met[kinds], count)
                met[kinds] += count
                cols = [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(rows)]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(np.full(len(lengths), task)), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
                )

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


# ---------------------------------------------------------------- the plan, on the histogram


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    repeats: int


def _candidates(hist: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """Patterns of two to four lengths that fill a sequence exactly, over lengths that occur."""
    there = np.flatnonzero(hist)
    have, found = hist > 0, set()
    for a in there:
        if a <= size - a and have[size - a]:
            found.add((size - a, a))
    weight = hist / max(1, hist.sum())
    for a in there:  # for each length, the most frequent ways to fill what it leaves
        left = size - a
        b = there[there <= left // 2]
        b = b[have[left - b]]
        if len(b):
            for x in b[np.argsort(-(weight[b] * weight[left - b]), kind="stable")[:4]]:
                found.add(tuple(sorted((int(a), int(x), int(left - x)), reverse=True)))
        small = there[there <= max(1, left // 3)]
        for x in small[np.argsort(-weight[small], kind="stable")[:2]]:
            rest = left - x
            c = there[there <= rest // 2]
            c = c[have[rest - c]]
            if len(c):
                y = c[np.argmax(weight[c] * weight[rest - c])]
                found.add(tuple(sorted((int(a), int(x), int(y), int(rest - y)), reverse=True)))
    return sorted((tuple(int(v) for v in p) for p in found), reverse=True)


def _nnls(patterns: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeats x >= 0 that bring A x close to the histogram (least squares, accelerated gradient)."""
    col = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.concatenate([np.array(p) for p in patterns])
    scale = max(1.0, float(hist.max()))
    h = hist / scale
    x = y = np.zeros(len(patterns))
    # the largest eigenvalue of A'A is at most the largest row sum of A times its largest column sum
    bound = max(np.bincount(row, minlength=len(hist)).max() * 4.0, 1.0)
    for k in range(1, rounds + 1):
        gap = np.bincount(row, y[col], len(hist)) - h
        new = np.maximum(0, y - np.bincount(col, gap[row], len(patterns)) / bound)
        y = new + (k - 1) / (k + 2) * (new - x)
        x = new
    return x * scale


def plan(hist: np.ndarray, size: int = SIZE) -> list[Pattern]:
    """Patterns with repeats that use up ``hist`` (count by length, index 0 unused) exactly."""
    left = hist.astype(np.int64).copy()
    out = []

    def take(lengths: tuple[int, ...], wish: int | None = None) -> None:
        kinds, need = np.unique(lengths, return_counts=True)
        n = int((left[kinds] // need).min())
        n = n if wish is None else min(n, wish)
        if n > 0:
            left[kinds] -= n * need
            out.append(Pattern(tuple(lengths), n))

    if left[size]:
        take((size,))
    patterns = _candidates(left, size)
    if patterns:
        x = _nnls(patterns, left)
        for k in np.argsort(-x, kind="stable"):
            if x[k] >= 0.5:
                take(patterns[k], int(round(x[k])))
    for big in range(size, 0, -1):  # what is left: the largest length, then the best fits
        while left[big]:
            lengths, room = [big], size - big
            left[big] -= 1
            while room:
                fits = np.flatnonzero(left[1 : room + 1])
                if not len(fits):
                    break
                k = int(fits[-1]) + 1
                lengths.append(k)
                left[k] -= 1
                room -= k
            for k in lengths:
                left[k] += 1
            take(tuple(lengths))
    return out


def placements(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, past the last rank, first sequence, offset) for each slot of the plan."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for p in patterns:
        offset = 0
        for length in p.lengths:
            a = used.get(length, 0)
            rows.append((length, a, a + p.repeats, sequence, offset))
            used[length] = a + p.repeats
            offset += length
        sequence += p.repeats
    return rows


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pack all rows of ``docs`` into sequences of at most ``size`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is its end token alone. Rows with null or repeated doc_id are packed like others.
    Only documents longer than ``size`` are cut. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    found = cut(pieces(docs, tokenizer, size, end))
    counts = cut(found.groupBy("task", "length").agg(F.count("*").alias("n")))
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        hist[r.length] = r.n
    slots = placements(plan(hist, size))
    before = counts.select(
        "task", "length",
        (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"),
    )
    ranked = found.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    # the ranks of a length fall into intervals in order; the plan's size depends on `size` alone
    by_length: dict[int, list] = {}
    for s in slots:
        by_length.setdefault(s[0], []).append(s)

    def place(batches):
        known = shared.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                lows, first, shift = known[int(k)]
                s = np.searchsorted(lows, rank[at], side="right") - 1
                sequence[at] = first[s] + rank[at] - lows[s]
                offset[at] = shift[s]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    shared = spark.sparkContext.broadcast(
        {k: tuple(np.array([v[i] for v in vs], np.int64) for i in (1, 3, 4)) for k, vs in by_length.items()}
    )
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, kinds)
