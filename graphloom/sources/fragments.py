"""Snapshots as JSON fragments: one document for each source file, and an aggregate that points at them.

Layout below a root: ``aggregate`` holds one JSON document with ``sources`` (file to folder) and the counts;
``fragments/shard=<n>/`` hold the fragments. Only folders that the aggregate points at are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT = 64 * 1024  # characters of a fragment beyond which a file is written class by class
VERSION = 6
_NODE = "map<string,string>"
_DOCUMENT = f"file string, serializer_version int, nodes array<{_NODE}>, edges array<struct<from:string,to:string,calls:bigint>>"
_KINDS = {
    "symbol": "string", "kind": "string", "klass": "string", "branches": "long", "decisions": "long", "entrypoint": "boolean", "entrypoint_kind": "string",
    "escapes": "boolean", "outcome_arity": "long", "toll_booth": "boolean", "score": "double",
}


@dataclass
class Vintage:
    """One snapshot: nodes with their ``keys_present``, edges, and the source files that could not be read."""

    nodes: DataFrame
    edges: DataFrame
    corrupt: DataFrame


def canonical(columns: list[str]):
    """A JSON object with sorted keys, numbers at six places, keys without a value left out."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "true"})


def write(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Write a snapshot: an edge goes to the file of its source; files over ``LIMIT`` characters are split by class.

    Each file's fragment is one line of text; folders are chosen by a hash, so that no task holds more than its files.
    """
    cols = [c for c in _KINDS if c in nodes.columns]
    kept = nodes.where("symbol is not null")
    rounded = [F.round(c, 6).alias(c) if _KINDS[c] == "double" else F.col(c) for c in cols]
    klass = F.col("klass") if "klass" in nodes.columns else F.substring_index("symbol", "#", 1)
    rows = kept.select("file", klass.alias("_class"), *rounded).select("file", "_class", "symbol", canonical(cols).alias("text"))
    size = rows.groupBy("file").agg((F.sum(F.length("text")) > LIMIT).alias("split"))
    part = F.when(F.col("split"), F.col("_class")).otherwise(F.lit("")).alias("part")
    rows = rows.join(size, "file").select("file", part, "symbol", "text")
    of = rows.groupBy("symbol").agg(F.min(F.struct("file", "part")).alias("at"))
    links = edges.withColumnRenamed("from", "symbol").join(of, "symbol").select("at.*", F.to_json(F.struct("calls", F.col("symbol").alias("from"), "to")).alias("text"))
    both = rows.groupBy("file", "part").agg(F.array_sort(F.collect_list("text")).alias("nodes")).join(
        links.groupBy("file", "part").agg(F.array_sort(F.collect_list("text")).alias("edges")), ["file", "part"], "full"
    )  # a fragment is what one source file, or one class of it, holds
    quoted = F.to_json(F.struct("file"))  # {"file":"..."}: left open for the lists
    listed = [F.concat(F.lit(f',"{c}":['), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ","), F.lit("]")) for c in ("nodes", "edges")]
    body = F.concat(F.substr(quoted, F.lit(1), F.length(quoted) - 1), *listed, F.lit(f',"serializer_version":{VERSION}}}'))
    out = both.select(F.pmod(F.xxhash64("file"), F.lit(64)).alias("shard"), "file", body.alias("value"))
    out.select("shard", "value").write.partitionBy("shard").text(f"{root}/fragments")
    folders = out.select("file", F.concat(F.lit("fragments/shard="), F.col("shard").cast("string")).alias("folder")).distinct()
    folders.write.json(f"{root}/aggregate")


def read(spark: SparkSession, root: str) -> Vintage:
    """Nodes (without those that have no symbol), edges (equal triples once) and corrupt files of a snapshot.

    A file with a fragment that can't be parsed is left out whole and listed. A key that is there with a null is in
    ``keys_present``, one that is missing is not.
    """
    folders = spark.read.schema("file string, folder string").json(f"{root}/aggregate")
    lines = spark.read.text(f"{root}/fragments", recursiveFileLookup=True).withColumn("folder", F.regexp_extract(F.col("_metadata.file_path"), r"(fragments/shard=\d+)/", 1))
    pointed = lines.join(F.broadcast(folders.select("folder").distinct()), "folder", "left_semi")  # 64 folders at most
    parsed = pointed.select("value", F.from_json("value", _DOCUMENT).alias("d"))
    named = F.coalesce("d.file", F.regexp_extract("value", r'"file":"((?:[^"\\]|\\.)*)"', 1)).alias("file")
    parsed = parsed.select(named, "d").join(folders.select("file").distinct(), "file", "left_semi")
    corrupt = parsed.where("d is null or d.nodes is null or d.edges is null").select("file").distinct()
    sound = parsed.join(corrupt, "file", "left_anti")
    nodes = sound.select("file", F.col("d.serializer_version").alias("serializer_version"), F.explode("d.nodes").alias("n")).where("n['symbol'] is not null")
    nodes = nodes.select(
        "file", *(F.col(f"n.{c}").try_cast(k).alias(c) if k != "string" else F.col(f"n.{c}").alias(c) for c, k in _KINDS.items()),
        "serializer_version", F.array_sort(F.map_keys("n")).alias("keys_present"),
    )
    edges = sound.select(F.explode("d.edges").alias("e")).select("e.from", "e.to", "e.calls").distinct()
    return Vintage(nodes, edges, corrupt)


def csv(spark: SparkSession, path: str, allow: list[str]) -> DataFrame:
    """Columns of an allowlist from a CSV file with a header; names that tell who did something are refused."""
    bad = [c for c in allow if any(w in c.lower() for w in ("author", "login", "user", "actor", "email"))]
    if bad:
        raise ValueError(f"columns not allowed: {', '.join(bad)}")
    return spark.read.csv(path, header=True, quote='"', escape='"').select(*allow)
