"""Findings and hotspots joined to what a report says about them, and their reshaping for other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .report import medians

# fixed values: the metrics shown beside the hotspots of each dimension
DRIVING = {
    "reverse_traceability": ("fan_in", "centrality", "in_cycle"),
    "forward_discoverability": ("path_length", "fan_out"),
}

# fixed values: title, axis and summary of each type of finding
EXPLANATIONS = {
    "high_fan_in": ("High fan-in", "reverse traceability", "Called from many places — risky to change."),
    "high_fan_out": ("High fan-out", "forward discoverability", "Calls many other things — hard to follow."),
    "high_centrality": ("High centrality", "both directions", "A chokepoint on many call paths — fragile hub."),
    "orphan": ("Orphan", "reverse traceability", "No callers reach it — unreachable from entrypoints."),
    "dead": ("Dead", "forward discoverability", "Reaches nothing and nothing reaches it — likely removable."),
    "long_path": ("Long path", "forward discoverability", "A deep call chain — poor forward discoverability."),
    "cycle": ("Cycle", "both directions", "A call cycle — tangles forward and reverse reasoning."),
}

# fixed values: names of the severities in the two exchange formats
CLIMATE = {"error": "major", "warn": "minor", "info": "info"}
SARIF = {"error": "error", "warn": "warning", "info": "note"}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's value for a key, null for any other key and for null."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def hotspots(lists: DataFrame, metrics: DataFrame) -> DataFrame:
    """list, dimension, pos, id and each driving metric that ``metrics`` has: null outside its dimension or for an unknown id."""
    rows = lists.select("list", "dimension", F.posexplode("ids").alias("pos", "id")).withColumn("pos", F.col("pos").cast("long"))
    known = {m: [d for d, ms in DRIVING.items() if m in ms] for m in metrics.columns if m != "id"}
    shown = [F.when(F.col("dimension").isin(ds), F.col(m)).alias(m) for m, ds in known.items() if ds]
    return rows.join(metrics, "id", "left").select("list", "dimension", "pos", "id", *shown)


def explained(findings: DataFrame) -> DataFrame:
    """``findings`` with a line of text by type; those of a path say its length, unknown types say that nothing is registered."""
    title, axis, summary = (_lookup(F.col("type"), {k: v[i] for k, v in EXPLANATIONS.items()}) for i in range(3))
    chain = F.when(F.col("path").isNotNull(), F.concat(F.lit(" ("), F.size("path").cast("string"), F.lit("-node chain)"))).otherwise("")
    line = F.concat(title, F.lit(" — "), summary, chain, F.lit(" ["), axis, F.lit("]"))
    return findings.withColumn("line", F.coalesce(line, F.concat("type", F.lit(": (no explanation registered)"))))


def exchanged(findings: DataFrame) -> DataFrame:
    """rule, message, path, line and the severity's name in both formats; a finding without a file is one of the root."""
    return findings.select(
        F.col("rule").alias("check_name"), F.col("message").alias("description"), "fingerprint", _lookup(F.col("severity"), CLIMATE).alias("severity"),
        _lookup(F.col("severity"), SARIF).alias("level"), F.coalesce("file", F.lit(".")).alias("path"), F.coalesce("line", F.lit(1)).cast("long").alias("begin"),
    )


def enriched(findings: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``findings`` with columns of their node, null on a snapshot where no node says whether it escapes."""
    analyzed = nodes.groupBy("vintage").agg(F.bool_or(F.col("escapes").isNotNull()).alias("_analyzed"))
    found = findings.join(nodes.select("vintage", "file", "symbol", *columns), ["vintage", "file", "symbol"], "left").join(analyzed, "vintage", "left")
    return found.withColumns({c: F.when(F.col("_analyzed"), F.col(c)) for c in columns}).drop("_analyzed")


def equation(score: Column, variety: Column, mass: Column) -> Column:
    """The two means beside a score: as its sum where they reconcile within 0.05, else listed, empty where one is missing."""
    def one(c: Column) -> Column:
        return F.format_string("%.1f", c)

    total = F.concat(F.lit(" = variety "), one(variety), F.lit(" + mass "), one(mass))
    apart = F.concat(F.lit(", variety "), one(variety), F.lit(", mass "), one(mass))
    return F.when(variety.isNull() | mass.isNull(), "").when(F.abs(score - (variety + mass)) <= 0.05, total).otherwise(apart)


def bottlenecks(proxies: DataFrame, names: DataFrame) -> DataFrame:
    """id, location, clutter_score of the listed proxies; an id without a name gets a placeholder."""
    located = F.coalesce("name", F.concat(F.lit("<unresolved:"), "id", F.lit(">")))
    return proxies.select(F.col("symbol").alias("id"), F.col("added_coupling").alias("clutter_score")).join(names.select("id", "name"), "id", "left").select("id", located.alias("location"), "clutter_score")


def routed_actions(routes: DataFrame, methods: DataFrame) -> DataFrame:
    """symbol of every route ``to`` (path#action below ``modules``) that names a method there is; malformed routes name none."""
    def camel(name: Column) -> Column:
        return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")

    path, action = F.split_part("to", F.lit("#"), F.lit(1)), F.substring_index("to", "#", -1)
    parts = F.transform(F.concat(F.coalesce("modules", F.array().cast("array<string>")), F.split(path, "/")), camel)
    symbol = F.concat(F.array_join(parts, "::"), F.lit("Controller#"), action)
    named = routes.where(F.col("to").contains("#") & (action != "")).select(symbol.alias("symbol")).distinct()
    return named.join(methods.select("symbol"), "symbol", "left_semi")


def class_ids(nodes: DataFrame, order: list[str]) -> DataFrame:
    """class_id, file, class_symbol, line (of the first node by ``order``), members: one row per class of a file, nodes without a class left out."""
    minted = F.concat(F.lit("cls_"), F.substring(F.sha2(F.concat_ws("|", F.coalesce("file", F.lit("")), "class_symbol"), 256), 1, 16))
    first = F.min_by("line", F.struct(*order))
    return nodes.where("class_symbol is not null").groupBy("file", "class_symbol").agg(first.alias("line"), F.count("*").alias("members")).select(minted.alias("class_id"), "file", "class_symbol", "line", "members")


def touched_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """change, n_files, n_nodes: the base nodes with a branch count in the files a change touches; nodes are counted by file before they meet changes."""
    sizes = nodes.where("branches >= 1").groupBy("file").agg(F.count("*").alias("n"))
    rows = files.where("file is not null").select("change", "file").distinct().join(sizes, "file")
    return rows.groupBy("change").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_nodes"))


def cohort_medians(changes: DataFrame, cohort: DataFrame, limit: float) -> DataFrame:
    """n, n_flagged, flagged_median, q1_median over the changes that the cohort's table keeps; one row, of zeros and nulls for no change."""
    kept = changes.join(cohort.where("kept").select("change", "quartile"), "change")
    flagged = F.coalesce(F.col("max_log2") > limit, F.lit(False))
    parts = F.array_compact(F.array(F.when(flagged, F.lit("flagged")), F.when(F.col("quartile") == 1, F.lit("q1"))))
    meds = medians(kept.select("latency", F.explode(parts).alias("part")), ["part"], "latency")
    one = meds.agg(*(F.max(F.when(F.col("part") == p, F.col("med"))).alias(f"{p}_median") for p in ("flagged", "q1")))
    return kept.agg(F.count("*").alias("n"), F.count_if(flagged).alias("n_flagged")).crossJoin(one)  # one row each


def manifest(now: DataFrame, version: Column) -> DataFrame:
    """file, hash: what a later run compares its files with; the version is part of the hash."""
    return now.select("file", F.sha2(F.concat_ws(":", version, "content"), 256).alias("hash"))
