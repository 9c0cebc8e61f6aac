"""Snapshots as they are committed: an aggregate file whose ``sources`` point at one JSON file for a source file, or at a folder of them.

The names of the aggregate and of the tree are parameters. Only files that a pointer leads to are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fragments import LIMIT, VERSION, Vintage, canonical

SINGLE, PER_CLASS, PER_METHOD = "single", "per_class", "per_method"
_POINTERS = "sources map<string, struct<path:string, shard_mode:string>>"
_NODES = "array<map<string,string>>"
_DOCUMENT = f"file string, serializer_version int, nodes {_NODES}, edges array<struct<from:string,to:string,calls:bigint>>"
_KINDS = {
    "symbol": "string", "kind": "string", "class": "string", "branches": "long", "decisions": "long", "entrypoint": "boolean", "entrypoint_kind": "string", "escapes": "boolean", "outcome_arity": "long",
    "toll_booth": "boolean", "quadrant": "string", "leverage": "double", "collapse": "double", "score": "double", "score_band": "int", "score_raw": "double", "absorb": "double", "absorb_raw": "double",
}


def _files(spark: SparkSession, root: str, path: str | None, tree: tuple[str, str]) -> list[str]:
    """The files a pointer leads to, sorted: itself, or all JSON files of its folder; from the undotted tree where the dotted one has none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if path is None:
        return []
    for name in dict.fromkeys((path, path.replace(tree[0], tree[1], 1) if path.startswith(tree[0]) else path)):
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            if fs.getFileStatus(at).isFile():
                return [at.toString()]
            found, every = [], fs.listFiles(at, True)
            while every.hasNext():
                found.append(every.next().getPath().toString())
            return sorted(f for f in found if f.endswith(".json"))
    return []


def pointers(spark: SparkSession, root: str, aggregate: str) -> DataFrame:
    """file, path, shard_mode: what the aggregate's ``sources`` say."""
    text = spark.read.text(f"{root}/{aggregate}", wholetext=True).select(F.from_json("value", _POINTERS).alias("a"))
    return text.select(F.explode("a.sources").alias("file", "p")).select("file", "p.path", "p.shard_mode")


def read(spark: SparkSession, root: str, aggregate: str, tree: tuple[str, str]) -> Vintage:
    """Nodes (the columns of a committed node, with ``keys_present``), edges (equal triples once) and corrupt source files.

    A source file is corrupt, and left out whole, if its pointer leads nowhere or one of its fragments can't be parsed. A node without a symbol is
    skipped. A fragment that names another file than its pointer keeps that name. Pointers, not fragments, pass the driver.
    """
    found = [(r.file, f) for r in pointers(spark, root, aggregate).collect() for f in _files(spark, root, r.path, tree) or [None]]
    listed = spark.createDataFrame(found, "source string, at string")
    missing = listed.where("at is null").select("source")
    paths = [f for _, f in found if f is not None]
    if paths:
        lines = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("at"))
    else:
        lines = spark.createDataFrame([], "value string, at string")
    plain = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/+", "/")
    known = listed.where("at is not null").select("source", F.regexp_replace("at", "^file:/+", "/").alias("at"))
    parsed = lines.select(plain(F.col("at")).alias("at"), F.from_json("value", _DOCUMENT).alias("d"), F.from_json("value", "map<string,string>").alias("keys")).join(known, "at")
    broken = parsed.where("keys is null or d is null or (keys['nodes'] is not null and d.nodes is null) or (keys['edges'] is not null and d.edges is null)").select("source").union(missing).distinct()
    sound = parsed.join(broken, "source", "left_anti")
    nodes = sound.select(F.coalesce("d.file", "source").alias("file"), "d.serializer_version", F.explode("d.nodes").alias("n")).where("n['symbol'] is not null")
    value = lambda c, k: F.col("n")[c].try_cast(k) if k != "string" else F.col("n")[c]
    nodes = nodes.select("file", *(value(c, k).alias("klass" if c == "class" else c) for c, k in _KINDS.items()), "serializer_version", F.array_sort(F.map_keys("n")).alias("keys_present"))
    edges = sound.select(F.explode("d.edges").alias("e")).select("e.from", "e.to", "e.calls").distinct()
    return Vintage(nodes, edges, broken.withColumnRenamed("source", "file"))


def _safe(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_.-]", "_")


def documents(nodes: DataFrame, edges: DataFrame, tree: str, limit: int = LIMIT) -> DataFrame:
    """file, shard_mode, path, text: the fragments of a snapshot with canonical text: one for a source file; one for each class where that is over ``limit``
    bytes; one for each method of a class that is over it too. An edge goes with the node of its file that it leaves.

    What one source file, class or method holds is put together in one task; a file's mode is that of its smallest fragments.
    """
    cols = [c for c in _KINDS if (c if c != "class" else "klass") in nodes.columns]
    rows = nodes.where("symbol is not null").withColumnRenamed("klass", "class") if "class" in cols else nodes.where("symbol is not null")
    rounded = [F.round(c, 6).alias(c) if _KINDS[c] == "double" else F.col(c) for c in cols]
    owner = F.coalesce("class", "symbol") if "class" in cols else F.col("symbol")
    rows = rows.select("file", owner.alias("owner"), *rounded).select("file", "owner", "symbol", canonical(cols).alias("node"))
    calls = edges.groupBy(F.col("from").alias("symbol")).agg(F.array_sort(F.collect_list(F.to_json(F.struct("calls", "from", "to")))).alias("calls"))  # of one node
    rows = rows.join(calls, "symbol", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))

    def fragments(df: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
        parts = df.groupBy(*keys).agg(F.array_sort(F.collect_list("node")).alias("nodes"), F.array_sort(F.flatten(F.collect_list("calls"))).alias("edges"))
        quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
        method = [F.lit('"method":'), quoted("symbol"), F.lit(",")] if "symbol" in extra else []
        first = [F.lit('"class":'), quoted("owner"), F.lit(",")] if "owner" in extra else []
        body = F.concat(
            F.lit("{"), *first, F.lit('"edges":['), F.array_join("edges", ","), F.lit('],"file":'), quoted("file"), F.lit(","), *method, F.lit('"nodes":['), F.array_join("nodes", ","), F.lit(f'],"serializer_version":{VERSION}}}\n')
        )
        return parts.select(*keys, body.alias("text"))

    whole = fragments(rows, ["file"], [])
    large = whole.where(F.octet_length("text") > limit).select("file")
    by_class = fragments(rows.join(large, "file", "left_semi"), ["file", "owner"], ["owner"])
    wide = by_class.where(F.octet_length("text") > limit).select("file", "owner")
    by_method = fragments(rows.join(wide, ["file", "owner"], "left_semi"), ["file", "owner", "symbol"], ["owner", "symbol"])
    folder = F.concat(F.lit(f"{tree}/"), "file", F.lit("/"))
    deep = wide.select("file").distinct().withColumn("deep", F.lit(True))
    single = whole.where(F.octet_length("text") <= limit).select("file", F.lit(SINGLE).alias("shard_mode"), F.concat(F.lit(f"{tree}/"), "file", F.lit(".json")).alias("path"), "text")
    mode = F.when(F.col("deep"), PER_METHOD).otherwise(PER_CLASS).alias("shard_mode")
    classes = by_class.where(F.octet_length("text") <= limit).join(deep, "file", "left").select("file", mode, F.concat(folder, _safe(F.col("owner")), F.lit(".json")).alias("path"), "text")
    methods = by_method.select("file", F.lit(PER_METHOD).alias("shard_mode"), F.concat(folder, _safe(F.col("owner")), F.lit("/"), _safe(F.col("symbol")), F.lit(".json")).alias("path"), "text")
    return single.unionByName(classes).unionByName(methods)


def aggregate_text(docs: DataFrame, tree: str) -> DataFrame:
    """value: one row, the aggregate that points at ``documents``."""
    folder = F.when(F.col("shard_mode") == SINGLE, F.concat(F.lit(f"{tree}/"), "file", F.lit(".json"))).otherwise(F.concat(F.lit(f"{tree}/"), "file"))
    rows = docs.select("file", F.struct(folder.alias("path"), "shard_mode").alias("p")).distinct()
    every = F.map_from_entries(F.array_sort(F.collect_list(F.struct("file", "p")))).alias("sources")  # pointers, a row for each source file
    return rows.agg(every).select(F.to_json(F.struct(F.lit(VERSION).alias("serializer_version"), "sources")).alias("value"))
