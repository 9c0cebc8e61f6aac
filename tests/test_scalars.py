from __future__ import annotations

import re

from pyspark.sql import functions as F

from graphloom.functions.scalars import band, glob_match, glob_regex


def test_globs():
    assert re.match(glob_regex("app/*.rb"), "app/a.rb") and not re.match(glob_regex("app/*.rb"), "app/x/a.rb")
    assert re.match(glob_regex("**/a.rb"), "x/y/a.rb") and not re.match(glob_regex("**/a.rb"), ".git/a.rb")
    assert re.match(glob_regex("{a,b}/c?"), "b/cd") and re.match(glob_regex("A::*", path=False), "A::B/C")


def test_exact_symbol_comes_before_brackets(spark):
    df = spark.createDataFrame([("X#GET[0]",), ("X#GET0",), ("Y",)], "s string")
    assert [r[0] for r in df.where(glob_match(F.col("s"), ["X#GET[0]"], path=False)).collect()] == ["X#GET[0]", "X#GET0"]


def test_band(spark):
    df = spark.createDataFrame([(-7.0,), (-2.5,), (0.49,), (2.5,)], "x double")
    assert [r[0] for r in df.select(band(F.col("x"))).collect()] == [-5, -3, 0, 3]
