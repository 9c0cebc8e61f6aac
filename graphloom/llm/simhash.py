"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared exactly: numpy exclusive-or and bit counts over pairs of tiles. A tile
holds fingerprints whose two halves have one pair of population counts; two tiles meet only if
those counts differ by the radius at most in sum, since a fingerprint cannot change its population
count by more than the number of differing bits. Equal fingerprints are one class before any
comparison, and each tile pair reports a spanning forest, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, partitions, row_key

SHINGLE = 3
SEED = 42
RADIUS = 3
TILE = 8192

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(data: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of UTF-8 bytes; no word gives 0."""
    words = (data or b"").translate(_LOWER).split()
    if not words:
        return 0
    text, digest, n = b" ".join(words), xxhash.xxh64_intdigest, len(words) - shingle + 1
    if n <= 1:
        return digest(text, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:n] - np.fromiter(map(len, words[:n]), np.int64, n) - 1).tolist()
    h = np.fromiter(
        (digest(text[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, n
    )
    total = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = h[i : i + 4096]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, fp (signed 64-bit) for every row of ``docs``; a null text has no words."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", *keep)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fp = [fingerprint(x.as_py(), shingle, seed) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", *keep, "fp"]
            )

    kinds = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, kinds)


def _compare(radius: int):
    def run(batches):
        for batch in batches:
            out_a, out_b = [], []
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2)):
                x = a.values.to_numpy(zero_copy_only=False).view(np.uint64)
                y = b.values.to_numpy(zero_copy_only=False).view(np.uint64)
                i, j = [], []
                for s in range(0, len(x), 64):
                    near = np.bitwise_count(x[s : s + 64, None] ^ y[None, :]) <= radius
                    p, q = np.nonzero(near)
                    i.append(p + s)
                    j.append(q)
                i, j = np.concatenate(i), np.concatenate(j)
                if same.as_py():
                    keep = i < j
                    nodes, i, j = x, i[keep], j[keep]
                else:
                    nodes, j = np.concatenate([x, y]), j + len(x)
                p, q = _forest(len(nodes), i, j)
                out_a.append(nodes[p])
                out_b.append(nodes[q])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v or [np.zeros(0, np.uint64)]).view(np.int64)) for v in (out_a, out_b)],
                names=["x", "y"],
            )

    from .common import local_forest as _forest

    return run


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links x-y that connect the distinct values ``fp`` at ``radius`` or fewer differing bits.

    The links join the same groups as all near pairs do; inside a tile pair only a spanning
    forest is returned. The counts by cell are at most 33 x 33 rows, whatever the input.
    """
    mask = F.lit(0xFFFFFFFF)
    cells = fps.select(
        "fp",
        F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int").alias("hi"),
        F.bit_count(F.col("fp").bitwiseAND(mask)).cast("int").alias("lo"),
    )
    sizes = cells.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))
    tiles = cut(
        cells.join(F.broadcast(sizes), ["hi", "lo"])
        .groupBy("hi", "lo", F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("chunk"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = [(p, q) for p in range(radius + 1) for q in range(-radius, radius + 1) if abs(p) + abs(q) <= radius and (p, q) >= (0, 0)]
    left = tiles.withColumn(
        "step", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in steps]))
    ).select(
        (F.col("hi") + F.col("step.p")).alias("hi"),
        (F.col("lo") + F.col("step.q")).alias("lo"),
        F.col("fps").alias("fps_a"),
        F.col("chunk").alias("chunk_a"),
        ((F.col("step.p") == 0) & (F.col("step.q") == 0)).alias("own"),
    ).join(F.broadcast(sizes), ["hi", "lo"])
    # each tile goes to every tile of the other cell by that tile's number, so that a full cell spreads over tasks
    first = F.when(F.col("own"), F.col("chunk_a")).otherwise(F.lit(0))
    left = left.withColumn("chunk", F.explode(F.sequence(first, F.col("chunks") - 1)))
    pairs = left.repartition(partitions(fps.sparkSession), "hi", "lo", "chunk").join(tiles, ["hi", "lo", "chunk"])
    pairs = pairs.select("fps_a", "fps", (F.col("own") & (F.col("chunk_a") == F.col("chunk"))).alias("same"))
    return pairs.mapInArrow(_compare(radius), "x long, y long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing
    bits, itself included. Null and wordless texts have fingerprint zero and link like any other.
    Rows with a null doc_id keep a row; they join groups but never name one (a group of such rows
    only has a null component_id). Repeated rows give repeated rows. Other columns are ignored.
    """
    return _groups(docs, shingle, seed, radius).select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, all columns kept.

    It is the row with the smallest doc_id, null as the largest, and among equal ids with the
    smallest hash of id and text. Rows without an id, and different texts that share one, are judged each by itself.
    """
    keyed = docs.withColumn("_key", row_key())
    found = _groups(keyed, shingle, seed, radius, ("_key",))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first")
    kept = found.groupBy("group").agg(first).select("first._key")
    return keyed.join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


def _groups(docs: DataFrame, shingle: int, seed: int, radius: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, fp, group, component_id for every row of ``docs``."""
    fps = cut(fingerprints(docs, shingle, seed, keep))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = components(
        links(classes.select("fp"), radius).select(F.col("x").alias("a"), F.col("y").alias("b"))
    ).withColumnsRenamed({"node": "fp", "component": "group"})
    named = cut(classes.join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp")))
    smallest = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    by_fp = cut(named.join(smallest, "group").select("fp", "group", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", *keep, "fp", "group", "component_id")
