"""Review documents: nested JSON of capped lists and blocks, put together in one row.

A list keeps its first rows in order and says how many more there are; a block is there if its source is. Only what a document shows meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import report


def listed(rows: DataFrame, order: list[Column], fields: list[str], cap: int) -> DataFrame:
    """One row, ``block``: items (the first ``cap`` rows in this order, their fields) and more, the number of the others."""
    first = report.numbered(rows.select("*"), order, cap).agg(F.array_sort(F.collect_list(F.struct("nth", *fields))).alias("s"))
    items = F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in fields))).alias("items")
    n = rows.agg(F.count("*").alias("n"))
    return first.crossJoin(n).select(F.struct(items, F.greatest(F.col("n") - cap, F.lit(0)).alias("more")).alias("block"))  # one row each


def block(rows: DataFrame) -> DataFrame:
    """One row, ``block``: the columns of the only row of ``rows``; null if it has none."""
    return rows.agg(F.first(F.struct("*")).alias("block"))


def assembled(schema: str, blocks: dict[str, DataFrame | None]) -> DataFrame:
    """One row, ``document``: JSON with ``schema`` and the blocks that have a source, by name; nulls are left out."""
    out, names = None, sorted(k for k, v in blocks.items() if v is not None)
    for name in names:
        one = blocks[name].select(F.col("block").alias(f"_{name}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.select(F.to_json(F.struct(F.lit(schema).alias("schema"), *(F.col(f"_{k}").alias(k) for k in names))).alias("document"))


def markdown(items: Column, line: Column, more: Column) -> Column:
    """The items of a list as lines, and how many more there are."""
    return F.concat_ws("\n", F.transform(items, lambda x: line(x)), F.when(more > 0, F.format_string("- +%d more", more)))


def dot(edges: DataFrame) -> DataFrame:
    """line: the edges of ``labelled_edges`` (from_label, to_label, calls) as a graph's lines; quotes in names are escaped."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quoted(F.col("from_label")), F.lit(" -> "), quoted(F.col("to_label")), F.lit(' [label="'), F.col("calls").cast("string"), F.lit('"];')).alias("line"))
