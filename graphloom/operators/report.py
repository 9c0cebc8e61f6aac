"""Joins to names, rankings, rollups and distributions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import band, round6
from . import selection


def resolve_names(scores: DataFrame, names: DataFrame) -> DataFrame:
    """Left join on id; a missing id gets a placeholder and resolved = false."""
    hit = F.col("name").isNotNull()
    return scores.join(names.select("id", "name"), "id", "left").select("id", F.coalesce("name", F.concat(F.lit("<unresolved:"), "id", F.lit(">"))).alias("label"), hit.alias("resolved"), "score")


def ranked(rows: DataFrame, value: str, tie: str, top: int | None = None) -> DataFrame:
    """Largest value first, nulls last, ``tie`` ascending on equal values."""
    out = rows.orderBy(F.desc_nulls_last(value), F.asc(tie))
    return out if top is None else out.limit(top)


def class_rollup(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(round6(F.sum(F.coalesce(value, F.lit(0.0)))).alias("total"), F.count("*").alias("members"))


def extremes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """least, most, n, n_negative, n_positive and the negative-first headline of each group."""
    least, most = F.min(value), F.max(value)
    headline = F.when(least <= -1, least).when(most >= 1, most).when(F.count(value) > 0, F.lit(0.0))
    return rows.groupBy(key).agg(
        least.alias("least"), most.alias("most"), F.count(value).alias("n"), F.count_if(F.col(value) <= -1).alias("n_negative"),
        F.count_if(F.col(value) >= 1).alias("n_positive"), headline.alias("headline"),
    )


def band_histogram(rows: DataFrame, value: str) -> DataFrame:
    n = F.sum("n").over(Window.partitionBy())
    return rows.where(F.col(value).isNotNull()).groupBy(band(F.col(value)).alias("band")).agg(F.count("*").alias("n")).select("band", "n", round6(F.col("n") / n).alias("share"))


def percentiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Median (mean of the two middles) and nearest-rank percentiles by group, whatever its size."""
    most = rows.groupBy(key).agg(F.max(value).alias("most"))
    found = selection.percentiles(rows, [key], value, {f"p{p}": p / 100 for p in (50, 75, 90, 95, 99)}, "med").withColumnRenamed(key, "_key")
    return most.join(found, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, med: how many rows a group has and the median of their values, at six places; null where all are."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    found = selection.percentiles(rows, keys, value, {}, "med").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return n.join(found, same, "left").select(*keys, "n", round6(F.col("med")).alias("med"))


def capped_share(rows: DataFrame, key: str, capped: Column, value: str, least: float) -> DataFrame:
    """key, share of the group's rows that are capped, at_cap: the median of their values where the share is ``least`` or more."""
    held = rows.select(key, F.coalesce(capped, F.lit(False)).alias("_capped"), F.col(value).alias("_v"))
    share = held.groupBy(key).agg((F.count_if("_capped") / F.count("*")).alias("s"))
    med = medians(held.where("_capped"), [key], "_v").select(F.col(key).alias("_key"), "med")
    return share.join(med, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, round6(F.col("s")).alias("share"), F.when(F.col("s") >= least, F.col("med")).alias("at_cap"))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """One row: most, p90, med and mean of a column of all rows."""
    found = selection.percentiles(rows, [], value, {"p90": 0.9}, "med")
    both = rows.agg(F.max(value).alias("most"), round6(F.avg(value)).alias("mean")).join(found, F.lit(True), "left")  # one row each
    return both.select("most", F.col("p90").cast("double").alias("p90"), F.col("med").cast("double").alias("med"), "mean")


def top_by_group(rows: DataFrame, key: str, value: str, tie: str, top: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(value), F.asc(tie))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= top)


def numbered(rows: DataFrame, order: list, top: int) -> DataFrame:
    """The first ``top`` rows in this order, with their number: sorted in parts, numbered over those rows alone."""
    nth = F.row_number().over(Window.orderBy(*order)).cast("long")
    return rows.orderBy(*order).limit(top).withColumn("nth", nth)


def labelled_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """from_label, to_label, calls: both ends through the names, a placeholder where one is missing."""
    def end(df: DataFrame, c: str) -> DataFrame:
        n = names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_label"))
        return df.join(n, c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", F.concat(F.lit("<unresolved:"), c, F.lit(">"))))

    return end(end(edges, "from"), "to").select("from_label", "to_label", "calls")


def resolved_paths(paths: DataFrame, names: DataFrame) -> DataFrame:
    """path_id, chain: the names of each path's ids in their order."""
    rows = paths.select("path_id", F.posexplode("ids").alias("pos", "id")).join(names.select("id", "name"), "id", "left")
    step = F.struct("pos", F.coalesce("name", F.concat(F.lit("<unresolved:"), "id", F.lit(">"))).alias("label"))
    return rows.groupBy("path_id").agg(F.array_sort(F.collect_list(step)).alias("s")).select("path_id", F.array_join("s.label", " > ").alias("chain"))


def worst_members(rows: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """key, tie, value of the largest value in each group, the smaller tie first."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(tie).alias("t")))
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(best.alias("m")).select(key, F.col("m.t").alias(tie), (-F.col("m.v")).alias(value))


def cohort(rows: DataFrame, value: str, k: int) -> DataFrame:
    """Rows whose value is at least the k-th largest, ties included."""
    kth = rows.select(value).where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(k).agg(F.min(value).alias("_least"))
    return rows.join(F.broadcast(kth), F.col(value) >= F.col("_least")).drop("_least")  # one row


def quadrant_by_sign(quadrant: Column, score: Column) -> Column:
    """A negative score makes a node underused or load-bearing whatever its quadrant, a positive one a bypass candidate."""
    return F.when(score < 0, F.when(quadrant == "hot", "load_bearing").otherwise("underused")).when(score > 0, "bypass_candidate").otherwise(quadrant)
