"""Scores from their published formula, joins of a report's parts, carried columns and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import band

# fixed values: the published constants of the reusability score
DEADBAND = 1.0
ESCAPE_FLOOR = 1.0
AMP_DIVISOR = 4.0
NEG_DIVISOR = 8.0
POS_DIVISOR = 3.0


def reusability(rows: DataFrame) -> DataFrame:
    """The input with score, score_band and score_raw from branches, outcome_arity, escapes, toll_booth, blast and mass_savings."""
    collapse = F.col("branches") / F.greatest(F.coalesce("outcome_arity", F.lit(1)), F.lit(1))
    gap = F.when(collapse > 0, F.greatest(F.lit(0.0), F.log2(collapse))).otherwise(0.0)
    own = F.greatest(F.lit(0.0), gap - DEADBAND)
    own = F.when(F.coalesce("escapes", F.lit(False)), F.greatest(own, F.lit(ESCAPE_FLOOR))).otherwise(own)
    n = own * (1 + F.coalesce(F.log2(1.0 + F.col("blast")) / AMP_DIVISOR, F.lit(0.0)))
    p = F.when(F.coalesce("toll_booth", F.lit(False)), F.log2(1.0 + F.col("mass_savings"))).otherwise(0.0)
    score = F.when(n > 0, -5 * (1 - F.exp(-n / NEG_DIVISOR))).when(p > 0, 5 * (1 - F.exp(-p / POS_DIVISOR))).otherwise(0.0)
    raw = F.when(n > 0, -n).when(p > 0, p).otherwise(0.0)
    return rows.withColumns({"score": score, "score_band": band(score), "score_raw": F.round(raw, 3)})


def attached(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, findings: how many findings each node carries; one of a path belongs to the path's first node."""
    key = F.coalesce("node", F.get("path", F.lit(0)))
    return nodes.select("id").join(findings.groupBy(key.alias("id")).agg(F.count("*").alias("findings")), "id", "left").select("id", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


def named_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows by id with their file and symbol; those whose id leads to no file are dropped."""
    return rows.join(ids.select("id", "file", "symbol"), "id").where("file is not null").drop("id")


def carried(now: DataFrame, before: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``now`` with columns taken over from ``before`` where the earlier row had the key, also where its value is null."""
    old = before.select(key, F.col("keys_present").alias("_keys"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = now.join(old, key, "left")
    return both.withColumns({c: F.when(F.array_contains("_keys", c), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_keys", *(f"_{c}" for c in columns))


def capped_graph(nodes: DataFrame, edges: DataFrame, top: int) -> DataFrame:
    """Edges among the ``top`` nodes by score, unscored ones last."""
    kept = nodes.orderBy(F.desc_nulls_last("score"), "symbol").limit(top).select("symbol")
    return edges.join(F.broadcast(kept.withColumnRenamed("symbol", "from")), "from", "left_semi").join(F.broadcast(kept.withColumnRenamed("symbol", "to")), "to", "left_semi")


def stale_files(now: DataFrame, stored: DataFrame, version: Column) -> DataFrame:
    """file of what has to be read again: no stored hash, or another one. The version is part of the hash."""
    hashed = F.sha2(F.concat_ws(":", version, "content"), 256)
    return now.select("file", hashed.alias("hash")).join(stored.select("file", "hash"), ["file", "hash"], "left_anti").select("file")


def is_fresh(now: DataFrame, stored: DataFrame) -> DataFrame:
    """fresh: one row, true if both sides have the same files with the same hashes."""
    both = now.select("file", F.col("hash").alias("x")).join(stored.select("file", F.col("hash").alias("y")), "file", "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(F.col("x") == F.col("y"), F.lit(False))), F.lit(True)).alias("fresh"))


def ordered_changes(changes: DataFrame, n: int) -> DataFrame:
    """The first ``n`` changes by repository and number."""
    w = Window.orderBy("repo", "number")
    return changes.orderBy("repo", "number").limit(n).withColumn("nth", F.row_number().over(w).cast("long"))
