from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.plans.registry import QUERIES, query


@pytest.fixture
def sizes(spark):
    before = spark.conf.get("spark.sql.sources.fileCompressionFactor")
    yield
    spark.conf.set("spark.sql.sources.fileCompressionFactor", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_many_short_rows_does_not_go_through_the_driver(spark, sizes):
    """The files of 1.2 million rows have some megabytes, their rows have many more."""
    name = lambda k: F.concat(F.lit("P"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10_000_000)))
    rows = storage.cut(spark.range(1_200_000).select(name(1).alias("symbol"), name(2).alias("comp")))
    try:
        both = lambda: rows.join(rows.select("symbol", F.col("comp").alias("c")), "symbol")
        spark.conf.set(storage.SIZES, "1.0")
        assert "BroadcastHashJoin" in plan(both())  # what a plan did without
        query(None)(lambda spark, sf_dir: rows)
        QUERIES["<lambda>"](spark, "")
        assert "BroadcastHashJoin" not in plan(both())
        few = storage.cut(rows.limit(100))
        assert "BroadcastHashJoin" in plan(rows.join(few.select("symbol"), "symbol"))
        spark.conf.set(storage.SIZES, "3.0")
        storage.plain_sizes(spark)
        assert spark.conf.get(storage.SIZES) == "3.0"  # what the user set stays
    finally:
        QUERIES.pop("<lambda>", None)
