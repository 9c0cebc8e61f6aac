"""Exact order statistics of groups of any size: no group is sorted, or held, in one task.

Equal values of a group become one row with a number first, so a value that stands there very often is one row. The distinct
values are dealt out by ranges of (group, value); how many rows lie in each range says which range holds a rank, and only that
range of a group is counted through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def _parts(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows dealt out by ranges of ``order``, each with the number ``_part`` of its range; written, so that the numbers stay."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with a long that grows along ``order``, all different: sorted by ranges, numbered inside them. Numbers have gaps."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, and for each name the value at its rank (from 1, an expression of the group's number ``n`` of values), lowest first.

    Null values are left out; a group without any other has no row. Null keys are a group. Without keys there is one row, or
    none.
    """
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_s{j}") for j, k in enumerate(keys)] + [F.col(k).isNull().alias(f"_n{j}") for j, k in enumerate(keys)]
    group = [f"_s{j}" for j in range(len(keys))] + [f"_n{j}" for j in range(len(keys))]
    some = rows.where(F.col(value).isNotNull()).select(*keys, *same, F.col(value).alias("_x"))
    counted = some.groupBy(*keys, *group, "_x").agg(F.count("*").alias("_m"))
    parts = _parts(counted, [*map(F.col, group), F.col("_x")])
    by = Window.partitionBy(*group)
    blocks = parts.groupBy(*keys, *group, "_part").agg(F.sum("_m").alias("_k"))  # a row for each group and range: the windows below are over those
    blocks = blocks.withColumn("n", F.sum("_k").over(by)).withColumn("_before", F.sum("_k").over(by.orderBy("_part")) - F.col("_k"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))).alias("w")
    asked = blocks.select(*keys, *group, "_part", "_before", "_k", wanted).select(*keys, *group, "_part", "_before", "w.name", "w.rank", "_k")
    asked = cut(asked.where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_before") + F.col("_k"))))
    at = [*group, "_part"]
    held = parts.select(*at, "_x", "_m").join(asked.select(*at, "_before").distinct(), at)
    run = Window.partitionBy(*at).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("_to", F.col("_before") + F.sum("_m").over(run)).drop("_before")
    hit = asked.join(held, at).where((F.col("rank") <= F.col("_to")) & (F.col("rank") > F.col("_to") - F.col("_m")))
    out = hit.groupBy(*keys, *group).agg(*(F.max(F.when(F.col("name") == k, F.col("_x"))).alias(k) for k in ranks))
    return out.select(*keys, *ranks)


def nearest(p: float) -> Column:
    """The rank of the nearest-rank percentile."""
    return F.greatest(F.ceil(F.col("n") * F.lit(p)), F.lit(1))


def percentiles(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], median: str | None = None) -> DataFrame:
    """keys, the nearest-rank percentile of each name, and the median (mean of the two middles) under the name ``median``."""
    ranks = {k: nearest(p) for k, p in fractions.items()}
    if median is None:
        return at_ranks(rows, keys, value, ranks)
    ranks |= {"_low": F.floor((F.col("n") + 1) / 2), "_high": F.floor(F.col("n") / 2) + 1}
    out = at_ranks(rows, keys, value, ranks)
    return out.withColumn(median, (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")
