from __future__ import annotations

import math
import random
import statistics

from pyspark.sql import functions as F

from graphloom.operators import report, selection


def test_percentiles_of_groups_of_every_size(spark):
    rng = random.Random(1)
    groups = {"hot": [rng.choice([1.0, 2.0, 2.0, 3.5]) for _ in range(3000)], "wide": [rng.random() for _ in range(2001)], "one": [7.0], "two": [1.0, 2.0], None: [3.0, None, 5.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(3)
    got = {r.k: r for r in report.percentiles(df, "k", "v").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        s = sorted(v for v in vs if v is not None)
        if not s:
            assert (got[k].med, got[k].p50, got[k].most) == (None, None, None)
            continue
        assert math.isclose(got[k].med, statistics.median(s)) and got[k].most == s[-1]
        for p in (50, 75, 90, 95, 99):
            assert got[k][f"p{p}"] == s[max(math.ceil(len(s) * (p / 100)) - 1, 0)]


def test_no_group_is_in_one_task(spark):
    """A million rows of one group: the ranges that are counted through hold a small share of it."""
    df = spark.range(1_000_000).select(F.lit("g").alias("k"), (F.xxhash64("id") % 500_000).alias("v"))
    out = selection.percentiles(df, ["k"], "v", {"p90": 0.9}, "med").first()
    want = df.select(F.expr("percentile_disc(0.9) within group (order by v)").alias("p"), F.median("v").alias("m")).first()
    assert (out.p90, out.med) == (want.p, want.m)
    assert selection.percentiles(df.where("v is null"), ["k"], "v", {"p90": 0.9}).count() == 0


def test_places_follow_the_order(spark):
    df = spark.createDataFrame([(x, y) for x in range(20) for y in "cab"], "x int, y string").repartition(5)
    rows = sorted(selection.placed(df, [F.desc("x"), F.asc("y")]).collect(), key=lambda r: r.place)
    assert [(r.x, r.y) for r in rows] == [(x, y) for x in range(19, -1, -1) for y in "abc"] and len({r.place for r in rows}) == 60
