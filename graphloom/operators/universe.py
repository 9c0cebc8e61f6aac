"""Which files, nodes and entrypoints a rule looks at, and layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import glob_match


def in_universe(file: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Include globs, where there are any, then exclude globs."""
    kept = glob_match(file, include) if include else F.lit(True)
    return kept & ~glob_match(file, exclude or [])


def settings(files: DataFrame, layers: list[tuple[list[str] | None, dict]]) -> DataFrame:
    """file and one column for each key: the last layer that has the key and matches the file wins; no patterns match all."""
    keys = list(dict.fromkeys(k for _, values in layers for k in values))
    cols = []
    for k in keys:
        value = F.lit(None)
        for patterns, values in layers:
            if k in values:
                value = F.lit(values[k]) if patterns is None else F.when(glob_match(F.col("file"), patterns), F.lit(values[k])).otherwise(value)
        cols.append(value.alias(k))
    return files.select("file").distinct().select("file", *cols)


def rule_nodes(nodes: DataFrame, resolved: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, rule_exclude: list[str] | None = None) -> DataFrame:
    """Nodes of the global universe whose file has the rule enabled and is not excluded by the rule itself."""
    on = resolved.where("enabled").select("file")
    return nodes.where(in_universe(F.col("file"), include, exclude) & ~glob_match(F.col("file"), rule_exclude or [])).join(on, "file", "left_semi")


def emitted(metrics: DataFrame, exclude_entrypoints: list[str]) -> DataFrame:
    """Entrypoints that may be reported; their cones are what they are."""
    return metrics.where(~glob_match(F.col("ep"), exclude_entrypoints, path=False))


def diff_universe(delta: DataFrame, head: DataFrame) -> DataFrame:
    """Head nodes that are new or have grown."""
    return head.join(delta.where(F.col("classification").isin("NEW", "GROWN")), ["file", "symbol"], "left_semi")


def touched(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A snapshot restricted to files; an edge stays if its source does."""
    kept = nodes.join(files.select("file").distinct(), "file", "left_semi")
    return kept, edges.join(kept.select(F.col("symbol").alias("from")).distinct(), "from", "left_semi")


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    kept = nodes.select("symbol").distinct()
    return edges.join(kept.withColumnRenamed("symbol", "from"), "from", "left_semi").join(kept.withColumnRenamed("symbol", "to"), "to", "left_semi")


def absorb_candidates(rows: DataFrame, least: float, top: int = 5) -> DataFrame:
    """The ``top`` rows with absorb >= least and a score of 0 or more: absorb descending, file, symbol."""
    return rows.where((F.col("absorb") >= least) & (F.col("score") >= 0)).orderBy(F.desc("absorb"), "file", "symbol").limit(top)


def changed_paths(files: DataFrame, prefix: str) -> DataFrame:
    """change, path: the paths a change touches, old and new ones, of scorable rows, without the service prefix."""
    both = files.where("scorable").select("change", F.explode(F.array("path", "previous_path")).alias("path")).where("path is not null")
    return both.select("change", F.regexp_replace("path", f"^{prefix}", "").alias("path")).distinct()


def base_paths(files: DataFrame) -> DataFrame:
    """change, path, base_path: where a scorable file is found before the change; null if it was added or copied."""
    base = F.when(F.col("status").isin("added", "copied"), None).when(F.col("status") == "renamed", F.col("previous_path")).otherwise(F.col("path"))
    return files.where("scorable").select("change", "path", base.alias("base_path"))


def captured(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """column, captured: whether any node ever had the key, by ``keys_present``; a null under a present key counts."""
    keys = nodes.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # a few names
    met = nodes.select(F.explode(F.array_distinct("keys_present")).alias("column")).distinct().withColumn("has", F.lit(True))
    return keys.join(met, "column", "left").select("column", F.coalesce("has", F.lit(False)).alias("captured"))


def identifiers(rows: DataFrame, text: str) -> DataFrame:
    """The input with handles and emails: how many of each the text holds."""
    t = F.coalesce(F.col(text), F.lit(""))
    return rows.withColumns({
        "handles": F.size(F.regexp_extract_all(t, F.lit(r"(?:^|\s)(@[A-Za-z0-9_-]+)"), F.lit(1))).cast("long"),
        "emails": F.size(F.regexp_extract_all(t, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+)"), F.lit(1))).cast("long"),
    })
