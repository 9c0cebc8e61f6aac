"""Repeated word spans through a compacted de Bruijn graph.

Token k-mers (k = the window) are edges between the (k-1)-mers at their ends. Edges are grouped
by their anchor (see ``repeats``), so all occurrences of an edge meet in one bucket, or, for a hot anchor,
by the edge itself; edges met once leave the graph. The rest is compacted: two edges belong to one path if
every occurrence of either stands beside one of the other. Inside a bucket that gives pieces;
pieces are laid along the source coordinates of all their occurrences, and Spark joins glue those that always
follow each other, with doubling steps (``glue``). As a path's end always goes on elsewhere, no
path closes to a cycle, also in periodic texts.

What is removed are the occurrences of the paths: each begins with an occurrence of its first edge,
and is verified in that document by the path's first and last edge and by the sum over all its edges.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, cut, word_hashes
from .repeats import HOT, Segments, Unit, anchors, grouped, packed, resolve, segments, split

WINDOW = 35
GRAM = 8
_LOW = np.uint64((1 << 32) - 1)


def _grams(data: bytes, k: int) -> np.ndarray:
    return Rolling(word_hashes(data)).windows(k)


def unit(window: int = WINDOW, gram: int = GRAM) -> Unit:
    def segment(data, lo, hi):
        """The hashes of the edges of each segment."""
        edges = Rolling(word_hashes(data)).windows(window)
        return [edges[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())]

    return Unit(window, gram, _grams, segment)


_PIECE = "sid binary, nth long, edges long, head long, tail long, total long"


def _pieces_of(s: Segments) -> pa.RecordBatch:
    """Runs of repeated edges that always go together, in each segment of complete anchor groups."""
    seg = np.repeat(np.arange(len(s.n)), s.n)
    nth = np.arange(len(seg)) - np.repeat(np.cumsum(s.n) - s.n, s.n)
    edge = np.frombuffer(b"".join(s.body), np.uint64)
    g = s.off[seg] - nth
    order = np.lexsort((edge, g, s.anchor[seg]))
    a, b, c = s.anchor[seg][order], g[order], edge[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    kind = np.empty(len(seg), np.int64)
    kind[order] = np.cumsum(new) - 1
    met = np.bincount(kind, s.count[seg]).astype(np.int64)  # occurrences of each distinct edge
    joint = np.flatnonzero(seg[1:] == seg[:-1])  # this edge and the next one stand side by side
    pair, of = np.unique(kind[joint] * len(met) + kind[joint + 1], return_inverse=True)
    beside = np.bincount(of, s.count[seg[joint]], len(pair)).astype(np.int64)[of]
    again = met[kind] >= 2
    through = np.zeros(len(kind), bool)  # this edge goes on from the one before it
    through[joint + 1] = again[joint] & (beside == met[kind[joint]]) & (beside == met[kind[joint + 1]])
    first = np.flatnonzero(again & ~through)
    run = np.cumsum(again & ~through) - 1
    size = np.bincount(run[again], minlength=len(first))
    sums = np.concatenate([[0], np.cumsum((edge & _LOW).astype(np.int64))])
    cols = (nth[first], size, edge[first].view(np.int64), edge[first + size - 1].view(np.int64), sums[first + size] - sums[first])
    sid = pa.array(s.sid, pa.binary()).take(pa.array(seg[first]))
    return pa.RecordBatch.from_arrays([sid, *(pa.array(v.astype(np.int64)) for v in cols)], names=["sid", "nth", "edges", "head", "tail", "total"])


def _hot_pieces(parts: DataFrame, most: int = 1 << 17) -> DataFrame:
    """Repeated edges of hot anchors, each a piece by itself: counted by their hashes, equal ones of a task in one row."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                held.append(part)
                size += int(np.asarray(part.column("n")).sum())
                if size >= most:
                    yield gathered(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield gathered(pa.Table.from_batches(held))

    def gathered(part: pa.Table) -> pa.RecordBatch:
        n, count = (part.column(k).to_numpy().astype(np.int64) for k in ("n", "count"))
        edge = np.frombuffer(b"".join(part.column("body").to_pylist()), np.int64)
        seg = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        head, of = np.unique(edge, return_inverse=True)
        order = np.argsort(of, kind="stable")
        sid = part.column("sid").combine_chunks().take(pa.array(seg[order]))
        at = pa.StructArray.from_arrays([sid, pa.array(nth[order])], names=["sid", "nth"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(head)))]).astype(np.int32)
        met = np.bincount(of, count[seg], len(head)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(head), pa.array(met), pa.ListArray.from_arrays(pa.array(ends), at)], names=["head", "count", "places"])

    kinds = "head long, count long, places array<struct<sid:binary,nth:long>>"
    edges = cut(parts.select("n", "count", "body", "sid").mapInArrow(run, kinds))
    again = edges.groupBy("head").agg(F.sum("count").alias("met")).where("met > 1").select("head")
    total = F.col("head").bitwiseAND(F.lit(0xFFFFFFFF))
    found = edges.join(again, "head").select("head", F.explode("places").alias("at"))
    return found.select("at.sid", "at.nth", F.lit(1).cast("long").alias("edges"), "head", F.col("head").alias("tail"), total.alias("total")).distinct()


def occurrences(parts: DataFrame, hot: int = HOT) -> DataFrame:
    """d, x, start, head, edges, tail, total, times: every occurrence of every piece (times: in rows that repeat each other)."""
    cold, many = split(parts, hot)

    def handle(s: Segments):
        yield _pieces_of(s)

    pieces = grouped(cold.drop("places"), handle, _PIECE).unionByName(_hot_pieces(many))
    places = parts.select("sid", F.explode("places").alias("at")).select("sid", "at.*")
    found = places.join(pieces, "sid").select("d", "x", (F.col("lo") + F.col("nth")).alias("start"), "head", "edges", "tail", "total")
    return cut(found.groupBy("d", "x", "start", "head").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("edges", "tail", "total"))))


_PATH = ("head", "tail", "edges", "total", "times", "at")


def glue(found: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Maximal paths of pieces, from all occurrences: head, tail (first and last edge), edges, total, times, at (a source coordinate).

    A piece goes on into another if all its occurrences are followed by that one, and all occurrences of that one come
    so. Each round joins every piece to what its end points at, so a path of n pieces takes about log2 n rounds.
    """
    w = Window.partitionBy("d", "x").orderBy("start")
    beside = F.lead("start").over(w) == F.col("start") + F.col("edges")
    laid = found.withColumn("to", F.when(beside, F.lead("head").over(w)))
    pieces = cut(
        laid.groupBy("head").agg(
            F.sum("times").alias("times"), F.sum(F.when(F.col("to").isNotNull(), F.col("times"))).alias("followed"), F.min("to").alias("to"), F.max("to").alias("other"),
            F.min(F.struct("d", "x", "start")).alias("at"), *(F.first(c).alias(c) for c in ("edges", "tail", "total")),
        )
    )
    steps = pieces.where("followed = times and to = other").select("head", "to", "times")
    single = cut(steps.join(pieces.select(F.col("head").alias("to"), F.col("times").alias("n")), "to").where("n = times").select("head", "to"))
    now = cut(pieces.select(*_PATH).join(single.withColumnRenamed("to", "next"), "head", "left"))
    for _ in range(max_rounds):
        if now.where("next is not null").isEmpty():
            return now.join(single.select(F.col("to").alias("head")), "head", "left_anti").select(*_PATH)
        b = now.select(F.col("head").alias("next"), *(F.col(c).alias(f"b_{c}") for c in ("tail", "edges", "total", "next")))
        zero = F.lit(0)
        now = cut(
            now.join(b, "next", "left").select(
                "head", F.coalesce("b_tail", "tail").alias("tail"), (F.col("edges") + F.coalesce("b_edges", zero)).alias("edges"),
                (F.col("total") + F.coalesce("b_total", zero)).alias("total"), "times", "at", F.col("b_next").alias("next"),
            )
        )
    raise RuntimeError("the paths did not end")


def finder(hot: int = HOT):
    def find(parts: DataFrame, _: DataFrame) -> DataFrame:
        found = occurrences(parts, hot)
        spans = found.select("d", "x", "start", "head").join(cut(glue(found).drop("times")), "head")  # a hot path is split by the skew join
        source = (F.col("at.d") == F.col("d")) & (F.col("at.x") == F.col("x")) & (F.col("at.start") == F.col("start"))
        notes = F.collect_list(F.struct("start", "edges", "head", "tail", "total", source.alias("source"))).alias("notes")
        return spans.groupBy("d", "x").agg(notes).withColumn("hs", F.lit(None).cast("array<long>"))

    return find


def _resolve(docs: DataFrame, window: int, text: bool, hot: int) -> DataFrame:
    schema = "kept string, " * text + "n_words long, n_removed long, kept_sha256 string, n_paths long"
    return resolve(docs, unit(window), finder(hot), _finish(text, window), schema, ("doc_id",), places=True)


def dedup(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, kept, n_words, n_removed, kept_sha256, n_paths for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a word goes if a window of ``window``
    words covers it whose word sequence starts anywhere else too, in this document or another,
    judged on the input. ``kept`` joins the other words by one space. Null and wordless texts
    keep nothing. ``n_paths`` counts the compacted paths with their source in the document. Repeated rows repeat each
    other. Rows with a null doc_id take part like others. Other columns are ignored. An empty table gives an empty table.
    Anchors with more than ``hot`` distinct segments are split; the result does not depend on it.
    """
    return _resolve(docs, window, True, hot)


def digests(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """As ``dedup``, without the kept text."""
    return _resolve(docs, window, False, hot)


def _verified(data: bytes, spans: list[dict], window: int) -> tuple[np.ndarray, int]:
    """Words covered by the paths that stand at their coordinates in this text, and how many have their source here."""
    edges = Rolling(word_hashes(data)).windows(window)
    sums = np.concatenate([[0], np.cumsum((edges & _LOW).astype(np.int64))])
    step, sources, edges = np.zeros(len(edges) + window, np.int64), 0, edges.view(np.int64)
    for p in spans:
        a, b = p["start"], p["start"] + p["edges"]
        if b <= len(edges) and edges[a] == p["head"] and edges[b - 1] == p["tail"] and sums[b] - sums[a] == p["total"]:
            step[a] += 1
            step[b + window - 1] -= 1
            sources += p["source"]
    return np.cumsum(step)[:-1] > 0, sources


def _finish(text: bool, window: int):
    def finish(data: bytes, _, spans: list[dict] | None):
        words = kept = data.split()  # bytes.split() cuts at the six ASCII white-space characters
        sources = 0
        if spans:
            marks, sources = _verified(data, spans, window)
            kept = [w for w, m in zip(words, marks.tolist()) if not m]
        body = b" ".join(kept)
        found = len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), sources
        return (body.decode(), *found) if text else found

    return finish


def paths(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Maximal unbranched paths of edges met more than once.

    Columns: head (first edge), tail (last edge), edges, total (sum of the edges' lower halves), times, at (a source coordinate:
    document d, hash of its text x, first word start).
    """
    u = unit(window, gram)
    parts = cut(segments(packed(docs), anchors(docs, u), u, places=True))
    return glue(occurrences(parts, hot))
