"""Relational parts of symbol resolution: tiers, definitions, arities, ancestors, categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def first_definition(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in the order of encounter."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def first_tier(sites: DataFrame, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """site_id, target, provenance: the match of the first tier that has one (ties: smallest target); none gives nulls.

    Each tier is (provenance, matches(site_id, target)); all are unioned and folded by rank, whatever their number.
    """
    found = None
    for rank, (name, matches) in enumerate(tiers):
        rows = matches.select("site_id", F.struct(F.lit(rank).alias("rank"), "target", F.lit(name).alias("provenance")).alias("m"))
        found = rows if found is None else found.unionByName(rows)
    best = found.groupBy("site_id").agg(F.min("m").alias("m"))
    return sites.select("site_id").join(best, "site_id", "left").select("site_id", "m.target", "m.provenance")


def symbol_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The input with ``id``: by file and symbol, else by a symbol that only one file has, else null (ambiguous tells these apart)."""
    exact = ids.groupBy("file", "symbol").agg(F.min("id").alias("exact"))
    alone = ids.groupBy("symbol").agg(F.count("*").alias("n"), F.min("id").alias("alone"))
    both = rows.join(exact, ["file", "symbol"], "left").join(alone, "symbol", "left")
    found = F.coalesce("exact", F.when(F.col("n") == 1, F.col("alone")))
    return both.withColumns({"id": found, "ambiguous": found.isNull() & (F.coalesce("n", F.lit(0)) > 1)}).drop("exact", "n", "alone")


def arities(tokens: DataFrame, refs: DataFrame) -> DataFrame:
    """fq, arity: how many distinct outcomes a method has once references are replaced by what they refer to.

    ``tokens(fq, token)`` are plain outcomes, ``refs(fq, callee)`` references. A missing callee and a reference into a cycle count
    as 'value'; 'unresolved' anywhere gives null. Tokens walk up the references, so a method has a row for each token.
    """
    every = tokens.select("fq").union(refs.select("fq")).distinct()
    known = refs.join(every.withColumnRenamed("fq", "callee"), "callee", "left_semi")
    pairs = known.select(F.col("fq").alias("a"), F.col("callee").alias("b")).distinct()
    comps = graph.components(every.withColumnRenamed("fq", "symbol"), pairs)
    ring = comps.groupBy("comp").agg(F.count("*").alias("n")).where("n > 1").join(comps, "comp").select(F.col("symbol").alias("fq"))
    value = ring.union(pairs.where("a = b").select("a")).union(refs.join(every.withColumnRenamed("fq", "callee"), "callee", "left_anti").select("fq"))
    rows = tokens.select("fq", "token").union(value.select("fq", F.lit("value"))).distinct()
    up = pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).union(rows.select(F.concat(F.lit("token "), "token"), "fq")).distinct()
    sources = rows.select(F.concat(F.lit("token "), "token").alias("symbol")).distinct()  # a closed vocabulary
    met = graph.reach(up, sources).where("ep <> v").groupBy(F.col("v").alias("fq"))
    n = met.agg(F.count("*").alias("n"), F.bool_or(F.col("ep") == "token unresolved").alias("open"))
    return every.join(n, "fq", "left").select("fq", F.when(~F.col("open"), F.col("n")).alias("arity"))


def ancestors(classes: DataFrame) -> DataFrame:
    """fq_name, ancestor: all classes up the chain, a cycle once around; ``classes(fq_name, superclass)``."""
    up = classes.where("superclass is not null").select(F.col("fq_name").alias("a"), F.col("superclass").alias("b")).distinct()
    return graph.reach(up, classes.select(F.col("fq_name").alias("symbol"))).where("ep <> v").select(F.col("ep").alias("fq_name"), F.col("v").alias("ancestor"))


def category(*rules: tuple[Column, str]) -> Column:
    """The first category whose condition holds; null if none does."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def closed_tally(rows: DataFrame, column: str, words: list[str], rest: str | None = None) -> DataFrame:
    """column, n: a count for each word of a closed vocabulary, zeros kept; others are counted as ``rest`` or left out."""
    every = rows.sparkSession.createDataFrame([(w,) for w in [*words, *([rest] if rest else [])]], f"{column} string")
    named = F.when(F.col(column).isin(words), F.col(column)).otherwise(F.lit(rest))
    counts = rows.select(named.alias(column)).groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def edges_of_calls(calls: DataFrame, known: DataFrame) -> DataFrame:
    """from, to, calls: call records by pair; ends that are not in ``known(symbol)`` go."""
    k = known.select("symbol").distinct()
    kept = calls.join(k.withColumnRenamed("symbol", "from"), "from", "left_semi").join(k.withColumnRenamed("symbol", "to"), "to", "left_semi")
    return kept.groupBy("from", "to").agg(F.count("*").alias("calls"))


def opaque_id(prefix: str, *keys: Column) -> Column:
    """An id of the published format: a prefix and twelve hexadecimal digits."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *keys), 256), 1, 12))
