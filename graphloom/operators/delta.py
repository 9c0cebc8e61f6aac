"""Differences of two snapshots, row by row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import changed, log2_branches, milli, round6
from .graph import Packed, adjacency, callers, vertices
from .selection import placed


def node_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """file, symbol, classification, base_branches, head_branches, delta_log2; unchanged rows are left out."""
    attributes = [c for c in ("escapes", "toll_booth", "outcome_arity") if c in base.columns and c in head.columns]

    def side(df: DataFrame, p: str) -> DataFrame:
        cols = [F.col(c).alias(f"{p}_{c}") for c in ("branches", *attributes)]
        return df.select("file", "symbol", *cols, F.lit(True).alias(f"{p}_in"))

    both = side(base, "base").join(side(head, "head"), ["file", "symbol"], "full")
    b, h = F.col("base_branches"), F.col("head_branches")
    kind = (
        F.when(F.col("base_in").isNull(), "NEW").when(F.col("head_in").isNull(), "REMOVED")
        .when(changed(b, h), F.when(h.isNull() | (b > h), "SHRUNK").otherwise("GROWN"))
        .when(reduce(or_, (changed(F.col(f"base_{c}"), F.col(f"head_{c}")) for c in attributes), F.lit(False)), "CHANGED_ATTRS")
    )
    change = F.when(kind == "CHANGED_ATTRS", F.lit(0.0)).otherwise(log2_branches(h) - log2_branches(b))
    return both.withColumns({"classification": kind, "delta_log2": round6(change)}).where("classification is not null").select(
        "file", "symbol", "classification", b.cast("long").alias("base_branches"), h.cast("long").alias("head_branches"), "delta_log2"
    )


def ep_delta(base: DataFrame, head: DataFrame, metrics: list[str]) -> DataFrame:
    """ep, status (new, removed, moved, same) and the change of each metric, a missing side being 0 in it."""
    x = base.select("ep", *(F.col(m).alias(f"b_{m}") for m in metrics), F.lit(True).alias("b_in"))
    y = head.select("ep", *(F.col(m).alias(f"h_{m}") for m in metrics), F.lit(True).alias("h_in"))
    moved = F.lit(False)
    for m in metrics:
        moved = moved | changed(F.col(f"b_{m}"), F.col(f"h_{m}"))
    status = F.when(F.col("b_in").isNull(), "new").when(F.col("h_in").isNull(), "removed").when(moved, "moved").otherwise("same")
    zero = F.lit(0)
    return x.join(y, "ep", "full").select(
        "ep", status.alias("status"),
        *(round6(F.coalesce(F.col(f"h_{m}"), zero) - F.coalesce(F.col(f"b_{m}"), zero)).alias(f"delta_{m}") for m in metrics),
    )


def ep_moves(base: DataFrame, head: DataFrame, metrics: list[str]) -> DataFrame:
    """ep, status (new, removed, moved) and the change of each metric of entrypoints that are new, removed or moved in any metric.

    A change is null where a side, or its value, is missing; a value that comes or goes is a move, a missing one on both sides is none.
    """
    x = base.select("ep", *(F.col(m).alias(f"b_{m}") for m in metrics), F.lit(True).alias("b_in"))
    y = head.select("ep", *(F.col(m).alias(f"h_{m}") for m in metrics), F.lit(True).alias("h_in"))
    moved = reduce(or_, (changed(F.col(f"b_{m}"), F.col(f"h_{m}")) for m in metrics), F.lit(False))
    status = F.when(F.col("b_in").isNull(), "new").when(F.col("h_in").isNull(), "removed").when(moved, "moved")
    rows = x.join(y, "ep", "full").withColumn("status", status).where("status is not null")
    return rows.select("ep", "status", *(round6(F.col(f"h_{m}") - F.col(f"b_{m}")).alias(f"delta_{m}") for m in metrics))


@dataclass
class Side:
    """One snapshot as the review surface needs it: pairs(a, b, calls), ``blast`` by symbol, and the hull of pairs if there is one."""

    nodes: DataFrame
    pairs: DataFrame
    blast: DataFrame
    hull: DataFrame | None = None


def review_surface(delta: DataFrame, base: Side, head: Side) -> DataFrame:
    """One row: surface_union (distinct entrypoints that reach a changed node), surface_sum, unreachable_touched.

    A removed node is looked up in the base, any other in the head. No pair of entrypoint and node is formed: sums come from
    the blast radius, the union from one walk up from all changed nodes of a side.
    """
    removed = F.col("classification") == "REMOVED"
    counts, eps = None, None
    for side, rows in ((base, delta.where(removed)), (head, delta.where(~removed))):
        met = rows.join(side.blast, "symbol", "left").select(F.coalesce("blast", F.lit(0)).alias("n"))
        up = callers(side.pairs, rows.select("symbol").distinct(), side.hull)
        found = vertices(side.nodes).where("entrypoint").join(up, "symbol", "left_semi").select("symbol")
        counts = met if counts is None else counts.unionByName(met)
        eps = found if eps is None else eps.unionByName(found)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("surface_sum"), F.count_if(F.col("n") == 0).alias("unreachable_touched"))
    return eps.agg(F.countDistinct("symbol").alias("surface_union")).crossJoin(sums)  # one row each


def moves(delta: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """symbol, from_file, to_file: removed and new nodes of one symbol with equal branches; the first pair by files. An annotation only."""
    gone = delta.where("classification = 'REMOVED'").select("file", "symbol").join(base.select("file", "symbol", "branches"), ["file", "symbol"])
    come = delta.where("classification = 'NEW'").select("file", "symbol").join(head.select("file", "symbol", "branches"), ["file", "symbol"])
    pairs = gone.withColumnRenamed("file", "from_file").join(come.select("symbol", F.col("file").alias("to_file"), F.col("branches").alias("now")), "symbol")
    first = F.min(F.struct("from_file", "to_file")).alias("p")
    return pairs.where(F.col("branches").eqNullSafe(F.col("now"))).groupBy("symbol").agg(first).select("symbol", "p.from_file", "p.to_file")


def ep_entries(rows: DataFrame) -> DataFrame:
    """Only new, removed and moved entrypoints."""
    return rows.where("status <> 'same'")


def coupling_flips(base: DataFrame, head: DataFrame, base_edges: DataFrame, head_edges: DataFrame, delta: DataFrame) -> DataFrame:
    """file, symbol of nodes on both sides that are otherwise unchanged but call differently. Edges meet pair by pair, not as lists."""
    x, y = (adjacency(e) for e in (base_edges, head_edges))
    differs = x.withColumnRenamed("calls", "was").join(y, ["a", "b"], "full").where(changed(F.col("was"), F.col("calls"))).select(F.col("a").alias("symbol")).distinct()
    both = base.select("file", "symbol").join(head.select("file", "symbol"), ["file", "symbol"]).join(differs, "symbol", "left_semi")
    return both.join(delta, ["file", "symbol"], "left_anti").select("file", "symbol")


def contributors(delta: DataFrame, comps: DataFrame, reached: Packed, top: int = 5) -> DataFrame:
    """ep, nth, node, delta_log2, omitted: the changed nodes of each cone by size of the change, file and symbol, and how many more there are.

    Changed nodes get a place in the order of all; each component brings its ``top`` places and its number of changed nodes.
    """
    order = [F.desc(F.abs(F.coalesce("delta_log2", F.lit(0.0)))), F.asc("file"), F.asc("symbol")]
    rows = placed(delta.select("file", "symbol", "delta_log2"), order).join(comps, "symbol")
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("comp").orderBy("place"))).where(F.col("k") <= top)
    number = rows.groupBy("comp").agg(F.count("*").alias("n"))
    sums = Packed.apart(reached.held.join(number, "comp"), ["n"]).groupBy("id").agg(F.sum("n").alias("n"))
    cones = Packed.apart(reached.held.join(best.select("comp", "place"), "comp"), ["place"])
    kept = cones.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where(F.col("nth") <= top)
    named = kept.join(rows.select("place", F.col("symbol").alias("node"), "delta_log2"), "place").join(sums, "id").join(reached.eps.select("ep", "id"), "id")
    return named.select("ep", F.col("nth").cast("long").alias("nth"), "node", "delta_log2", F.greatest(F.col("n") - top, F.lit(0)).cast("long").alias("omitted"))


def escapes_by_entrypoint(events: DataFrame, comps: DataFrame, reached: Packed, top: int = 5) -> DataFrame:
    """ep, events, first: how many of ``events(file, symbol)`` each cone holds, and the first of them by file and symbol."""
    rows = placed(events.select("file", "symbol"), [F.asc("file"), F.asc("symbol")]).join(comps, "symbol")
    number = rows.groupBy("comp").agg(F.count("*").alias("n"))
    sums = Packed.apart(reached.held.join(number, "comp"), ["n"]).groupBy("id").agg(F.sum("n").alias("events"))
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("comp").orderBy("place"))).where(F.col("k") <= top)
    cones = Packed.apart(reached.held.join(best.select("comp", "place"), "comp"), ["place"])
    kept = cones.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where(F.col("nth") <= top)
    names = kept.join(rows.select("place", "symbol"), "place").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "symbol"))).alias("t"))  # at most ``top``
    return sums.join(names, "id").join(reached.eps.select("ep", "id"), "id").select("ep", F.col("events").cast("long").alias("events"), F.array_join("t.symbol", ",").alias("first"))


def unreached_files(base: DataFrame, head: DataFrame, base_seen: DataFrame, head_seen: DataFrame) -> DataFrame:
    """Files that no entrypoint reaches a node of, on either side."""
    met = None
    for nodes, seen in ((base, base_seen), (head, head_seen)):
        rows = nodes.select("file", "symbol").join(seen.select("symbol").distinct().withColumn("seen", F.lit(True)), "symbol", "left")
        rows = rows.select("file", F.coalesce("seen", F.lit(False)).alias("seen"))
        met = rows if met is None else met.unionByName(rows)
    return met.groupBy("file").agg(F.bool_or("seen").alias("seen")).where("not seen").select("file")


def unmoved_with_changes(rows: DataFrame, head_pairs: DataFrame, delta: DataFrame, head_hull: DataFrame | None = None) -> DataFrame:
    """Entrypoints on both sides with equal metrics whose cone in the head holds a changed node."""
    up = callers(head_pairs, delta.where("classification <> 'REMOVED'").select("symbol").distinct(), head_hull)
    return rows.where("status = 'same'").select("ep").join(up.withColumnRenamed("symbol", "ep"), "ep", "left_semi")


def score_deltas(base: DataFrame, head: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """key, base, head, change in thousandths (of the rounded values); the lowest head first, a missing one last."""
    both = base.select(key, milli(F.col("score")).alias("base")).join(head.select(key, milli(F.col("score")).alias("head")), key, "full")
    rows = both.withColumn("change", F.col("head") - F.col("base"))
    return rows if top is None else rows.orderBy(F.asc_nulls_last("head"), key).limit(top)


def escape_events(base: DataFrame, head: DataFrame, head_blast: DataFrame) -> DataFrame:
    """file, symbol, hosts, orphan: nodes that escape since the base (born so, or false before; unknown before is none), and the entrypoints they reach."""
    was = base.select("file", "symbol", F.col("escapes").alias("was"), F.lit(True).alias("there"))
    rows = head.where("escapes").join(was, ["file", "symbol"], "left").where("there is null or was = false")
    hosts = F.coalesce("blast", F.lit(0)).cast("long")
    return rows.join(head_blast, "symbol", "left").select("file", "symbol", hosts.alias("hosts"), (hosts == 0).alias("orphan"))


def drift(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """file, status: same, changed, missing (right only) or extra (left only), by an order-free hash of each file's rows."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        row = F.xxhash64(*columns)
        return df.groupBy("file").agg(F.struct(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.bit_xor(F.xxhash64(row)).alias("y")).alias(name))

    status = F.when(F.col("l").isNull(), "missing").when(F.col("r").isNull(), "extra").when(F.col("l") == F.col("r"), "same").otherwise("changed")
    return hashed(left, "l").join(hashed(right, "r"), "file", "full").select("file", status.alias("status"))
