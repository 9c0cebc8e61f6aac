"""Queries over the graph of mixed components: levels, cones, differences and rules whose results are neither empty nor constant."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delta, details, document, graph, replay, report, resolve, rules
from ..sources.views import ctes, view
from ..storage import cut
from . import catalogue
from .catalogue import _log
from .registry import query

# ---------------------------------------------------------------- oracle fragments: p is the prefix of a side's tables


def _graph(p: str, n: str, e: str) -> str:
    return (
        f'{p}hull(a, b) AS (SELECT DISTINCT "from", "to" FROM {e} WHERE "from" <> "to" UNION SELECT h.a, e."to" FROM {p}hull h JOIN {e} e ON h.b = e."from"), '
        f'{p}every AS (SELECT symbol FROM {n} UNION SELECT "from" FROM {e} UNION SELECT "to" FROM {e}), '
        f"{p}comps AS (SELECT v.symbol, least(v.symbol, coalesce(min(x.b), v.symbol)) AS comp FROM {p}every v LEFT JOIN (SELECT h.a, h.b FROM {p}hull h JOIN {p}hull q ON h.a = q.b AND h.b = q.a) x ON x.a = v.symbol GROUP BY v.symbol), "
        f'{p}cond AS (SELECT DISTINCT x.comp AS a, y.comp AS b FROM {e} e JOIN {p}comps x ON x.symbol = e."from" JOIN {p}comps y ON y.symbol = e."to" WHERE x.comp <> y.comp), '
        f"{p}reach(ep, v) AS (SELECT symbol, symbol FROM {n} WHERE entrypoint UNION SELECT n.symbol, h.b FROM {n} n JOIN {p}hull h ON h.a = n.symbol WHERE n.entrypoint), "
        f"{p}hops(comp, k) AS (SELECT DISTINCT comp, 0 FROM {p}comps UNION SELECT c.a, h.k + 1 FROM {p}hops h JOIN {p}cond c ON c.b = h.comp), "
        f"{p}depth AS (SELECT symbol, CAST(greatest(max(k), 1) AS BIGINT) AS depth FROM {p}comps JOIN {p}hops USING (comp) GROUP BY symbol), "
        f"{p}terms AS (SELECT comp, sum(CASE WHEN branches >= 1 THEN ln(branches) ELSE 0 END) AS b, sum(coalesce(ln(outcome_arity), 0)) AS a, bool_or(n.symbol IS NOT NULL AND outcome_arity IS NULL) AS fallback, "
        f"bool_or(coalesce(escapes, false) OR (n.symbol IS NOT NULL AND outcome_arity IS NULL)) AS open FROM {p}comps c LEFT JOIN {n} n ON n.symbol = c.symbol GROUP BY comp), "
        f"{p}ways(root, cur) AS (SELECT comp, comp FROM {p}terms UNION ALL SELECT w.root, c.b FROM {p}ways w JOIN {p}cond c ON c.a = w.cur JOIN {p}terms t ON t.comp = c.b AND t.open), "
        f"{p}arms AS (SELECT c.a AS comp, sum(t.a) AS arms FROM {p}cond c JOIN {p}terms t ON t.comp = c.b WHERE NOT t.open GROUP BY c.a), "
        f"{p}folds AS (SELECT w.root AS comp, sum(t.b + coalesce(m.arms, 0)) AS vty, sum(CASE WHEN t.open THEN t.b ELSE least(t.b, t.a) END + coalesce(m.arms, 0)) AS floor, bool_or(t.fallback) AS taint "
        f"FROM {p}ways w JOIN {p}terms t ON t.comp = w.cur LEFT JOIN {p}arms m ON m.comp = w.cur GROUP BY w.root), "
        f'{p}outs AS (SELECT "from" AS v, sum(calls) AS calls FROM {e} GROUP BY 1), '
        f"{p}cone AS (SELECT r.ep, n.symbol, n.file, n.branches, n.escapes, coalesce(log2(branches) - CASE WHEN outcome_arity IS NULL THEN 0 ELSE log2(least(branches, outcome_arity)) END, 0) AS gap FROM {p}reach r JOIN {n} n ON n.symbol = r.v), "
        f"{p}mass AS (SELECT r.ep, sum(o.calls) AS mass FROM {p}reach r JOIN {p}outs o ON o.v = r.v GROUP BY r.ep), "
        f"{p}rows AS (SELECT c.ep, max(CASE WHEN c.symbol = c.ep THEN c.file END) AS file, round(sum({_log('c.branches')}), 6) AS branching_log2, CAST(coalesce(max(m.mass), 0) AS BIGINT) AS mass, count(*) AS reach, count(DISTINCT c.file) AS files, "
        "max(CASE WHEN c.symbol = c.ep THEN c.branches END) AS own_branches, coalesce(first(c.symbol ORDER BY c.branches DESC, c.file, c.symbol) FILTER (c.branches >= 1), c.ep) AS max_cone_node, "
        f"round(max({_log('c.branches')}), 6) AS max_cone_node_log2, count(*) FILTER (c.escapes) AS escapes_in_cone, "
        "array_to_string(list(c.symbol ORDER BY c.branches DESC, c.file, c.symbol)[1:5], ',') AS top_nodes, array_to_string(list(c.symbol ORDER BY round(c.gap, 9) DESC, c.file, c.symbol)[1:5], ',') AS top_dividend_nodes "
        f"FROM {p}cone c LEFT JOIN {p}mass m ON m.ep = c.ep GROUP BY c.ep), "
        f"{p}whole AS (SELECT r.*, n.entrypoint_kind AS kind, d.depth, round(least(exp(least(f.vty, 50.0)), 1000000.0), 6) AS variety, round(least(exp(least(f.vty - f.floor, 50.0)), 1000000.0), 6) AS dividend, "
        f"round((f.vty - f.floor) / ln(2.0), 6) AS dividend_log2, f.taint AS fallback FROM {p}rows r JOIN {n} n ON n.symbol = r.ep JOIN {p}depth d ON d.symbol = r.ep JOIN {p}comps c ON c.symbol = r.ep JOIN {p}folds f ON f.comp = c.comp)"
    )


_MX = f"WITH RECURSIVE {ctes('mx_nodes', 'mx_edges')}, {_graph('', 'mx_nodes', 'mx_edges')} "
_DELTA = (
    "both_sides AS (SELECT coalesce(b.file, h.file) AS file, coalesce(b.symbol, h.symbol) AS symbol, b.branches AS base_branches, h.branches AS head_branches, "
    "CASE WHEN b.symbol IS NULL THEN 'NEW' WHEN h.symbol IS NULL THEN 'REMOVED' WHEN b.branches < h.branches THEN 'GROWN' WHEN b.branches > h.branches THEN 'SHRUNK' "
    "WHEN b.escapes <> h.escapes OR b.toll_booth <> h.toll_booth OR b.outcome_arity <> h.outcome_arity THEN 'CHANGED_ATTRS' END AS classification "
    "FROM mxb_nodes b FULL JOIN mxh_nodes h ON b.file = h.file AND b.symbol = h.symbol), "
    "delta AS (SELECT file, symbol, classification, base_branches, head_branches, round(CASE WHEN classification = 'CHANGED_ATTRS' THEN 0.0 ELSE "
    f"coalesce({_log('head_branches')}, 0) - coalesce({_log('base_branches')}, 0) END, 6) AS delta_log2 FROM both_sides WHERE classification IS NOT NULL)"
)
_METRICS = ("branching_log2", "mass", "reach", "files", "depth", "dividend_log2")
_MOVES = (
    "moves AS (SELECT coalesce(b.ep, h.ep) AS ep, CASE WHEN b.ep IS NULL THEN 'new' WHEN h.ep IS NULL THEN 'removed' WHEN " + " OR ".join(f"b.{m} IS DISTINCT FROM h.{m}" for m in _METRICS) + " THEN 'moved' ELSE 'same' END AS status, "
    + ", ".join(f"round(CAST(h.{m} - b.{m} AS DOUBLE), 6) AS delta_{m}" for m in _METRICS)
    + ", round(coalesce(h.branching_log2, 0.0) - coalesce(b.branching_log2, 0.0), 6) AS delta_all FROM b_whole b FULL JOIN h_whole h ON b.ep = h.ep)"
)
_HITS = (
    "hits AS (SELECT d.file, d.symbol, r.ep FROM delta d JOIN b_reach r ON r.v = d.symbol WHERE classification = 'REMOVED' "
    "UNION ALL SELECT d.file, d.symbol, r.ep FROM delta d JOIN h_reach r ON r.v = d.symbol WHERE classification <> 'REMOVED')"
)
_TWO = f"WITH RECURSIVE {ctes('mxb_nodes', 'mxh_nodes', 'mxb_edges', 'mx_edges')}, {_graph('b_', 'mxb_nodes', 'mxb_edges')}, {_graph('h_', 'mxh_nodes', 'mx_edges')}, {_DELTA}, {_MOVES}, {_HITS} "
_ROW = ("ep", "file", "kind", "branching_log2", "mass", "reach", "files", "depth", "own_branches", "max_cone_node", "max_cone_node_log2", "escapes_in_cone", "variety", "dividend", "dividend_log2", "fallback", "top_nodes", "top_dividend_nodes")


def _mx(spark, sf_dir) -> catalogue.Graph:
    return catalogue.Graph(spark, sf_dir, "mx_nodes", "mx_edges", near=True)


def _two(spark, sf_dir) -> tuple[catalogue.Graph, catalogue.Graph]:
    return tuple(catalogue.Graph(spark, sf_dir, nodes, edges, near=True) for nodes, edges in (("mxb_nodes", "mxb_edges"), ("mxh_nodes", "mx_edges")))


def _delta(base: catalogue.Graph, head: catalogue.Graph):
    return cut(delta.node_delta(base.nodes, head.nodes))


# ---------------------------------------------------------------- one graph


@query(_MX + "SELECT symbol, comp FROM comps")
def gra_03_mixed_components(spark, sf_dir):
    return _mx(spark, sf_dir).comps


@query(_MX + "SELECT n AS members, count(*) AS components FROM (SELECT comp, count(*) AS n FROM comps GROUP BY comp) GROUP BY n")
def gra_03_component_sizes(spark, sf_dir):
    return _mx(spark, sf_dir).comps.groupBy("comp").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("components"))


@query(_MX + "SELECT a, b FROM cond")
def gra_04_mixed_condensation(spark, sf_dir):
    return _mx(spark, sf_dir).condensed


@query(_MX + "SELECT symbol, depth FROM depth")
def gra_06_mixed_depth(spark, sf_dir):
    g = _mx(spark, sf_dir)
    return graph.depth(g.comps, g.condensed)


@query(_MX + "SELECT ep, v FROM reach")
def gra_07_mixed_reach(spark, sf_dir):
    g = _mx(spark, sf_dir)
    return graph.reach(g.pairs, g.nodes.where("entrypoint"))


@query(_MX + "SELECT n.symbol, count(r.ep) AS blast FROM mx_nodes n LEFT JOIN reach r ON r.v = n.symbol GROUP BY n.symbol")
def gra_10_mixed_blast(spark, sf_dir):
    return _mx(spark, sf_dir).blast()


@query(_MX + f"SELECT {', '.join(_ROW)} FROM whole")
def gra_11_ep_rows(spark, sf_dir):
    rows = _mx(spark, sf_dir).rows()
    return rows.withColumns({c: F.array_join(c, ",") for c in ("top_nodes", "top_dividend_nodes")}).select(*_ROW)


@query(_MX + "SELECT n.file, n.symbol FROM reach r JOIN mx_nodes n ON n.symbol = r.v WHERE r.ep = (SELECT max(symbol) FROM mx_nodes WHERE entrypoint)")
def gra_12_cone_nodes(spark, sf_dir):
    g = _mx(spark, sf_dir)
    return graph.cone_nodes(g.nodes, g.pairs, g.nodes.where("entrypoint").agg(F.max("symbol")).first()[0])


@query(_MX + "SELECT symbol, round(vty, 6) AS vty, round(floor, 6) AS floor, taint FROM comps JOIN folds USING (comp)")
def gra_14_mixed_variety(spark, sf_dir):
    g = _mx(spark, sf_dir)
    return g.comps.join(g.folds, "comp").select("symbol", F.round("vty", 6).alias("vty"), F.round("floor", 6).alias("floor"), "taint")


@query(_MX + ", lost AS (SELECT symbol, file, symbol NOT IN (SELECT v FROM reach) AS lost FROM mx_nodes) SELECT count(*) FILTER (lost) AS nodes, round(count(*) FILTER (lost) / count(*), 6) AS share, "
       "(SELECT count(*) FROM (SELECT file FROM lost GROUP BY file HAVING bool_and(lost))) AS files FROM lost")
def gra_21_mixed_unreachable(spark, sf_dir):
    g = _mx(spark, sf_dir)
    return graph.unreachable(g.nodes, graph.spread(g.pairs, g.nodes.where("entrypoint")))


@query(_MX + "SELECT symbol FROM mx_nodes WHERE entrypoint AND symbol NOT IN (SELECT \"to\" FROM mx_edges WHERE \"from\" <> \"to\")")
def gra_28_mixed_zero_predecessors(spark, sf_dir):
    g = _mx(spark, sf_dir)
    return graph.zero_predecessors(g.nodes, g.pairs)


@query(_MX + ", f AS (SELECT ep, concat_ws(',', " + ", ".join(f"CASE WHEN {m} > {t} THEN '{m}' END" for m, t in (("branching_log2", 30), ("mass", 300), ("reach", 9), ("files", 1), ("depth", 6), ("max_cone_node_log2", 5.5))) + ") AS breached FROM whole) SELECT ep, breached FROM f WHERE breached <> ''")
def rul_03_six_metrics(spark, sf_dir):
    return rules.use_case_complexity(_mx(spark, sf_dir).rows(), {"branching_log2": 30, "mass": 300, "reach": 9, "files": 1, "depth": 6, "max_cone_node_log2": 5.5})


@query(_MX + "SELECT ep, max_cone_node_log2 AS value FROM whole WHERE max_cone_node_log2 > 5.0")
def rul_03_default(spark, sf_dir):
    rows = _mx(spark, sf_dir).metrics()
    return rules.use_case_complexity(rows, {"max_cone_node_log2": 5.0}).join(rows, "ep").select("ep", F.col("max_cone_node_log2").alias("value"))


@query(_MX + "SELECT ep, dividend FROM whole WHERE dividend >= 32")
def rul_04_mixed_dividend(spark, sf_dir):
    return rules.use_case_dividend(_mx(spark, sf_dir).dividends())


@query(_MX + "SELECT row_number() OVER (ORDER BY branching_log2 DESC, ep) AS nth, ep, file, kind, branching_log2, mass, reach, files, depth, own_branches, max_cone_node_log2, dividend, escapes_in_cone FROM whole QUALIFY nth <= 20")
def ord_02_full_leaderboard(spark, sf_dir):
    columns = ("ep", "file", "kind", "branching_log2", "mass", "reach", "files", "depth", "own_branches", "max_cone_node_log2", "dividend", "escapes_in_cone")
    return report.numbered(_mx(spark, sf_dir).rows().select(*columns), [F.desc("branching_log2"), F.asc("ep")], 20)


# ---------------------------------------------------------------- two snapshots


@query(_TWO + "SELECT * FROM delta")
def dif_02_changed_attributes(spark, sf_dir):
    return delta.node_delta(*(g.nodes for g in _two(spark, sf_dir)))


@query(_TWO + "SELECT ep, status, delta_all AS delta_branching_log2 FROM moves")
def dif_05_all_entrypoints(spark, sf_dir):
    base, head = (g.rows() for g in _two(spark, sf_dir))
    return delta.ep_delta(base, head, list(_METRICS)).select("ep", "status", "delta_branching_log2")


@query(_TWO + f"SELECT ep, status, {', '.join(f'delta_{m}' for m in _METRICS)} FROM moves WHERE status <> 'same'")
def dif_06_six_metrics(spark, sf_dir):
    base, head = (g.rows() for g in _two(spark, sf_dir))
    return delta.ep_moves(base, head, list(_METRICS))


@query(_TWO + "SELECT count(DISTINCT ep) AS surface_union, count(*) AS surface_sum, (SELECT count(*) FROM delta WHERE (file, symbol) NOT IN (SELECT (file, symbol) FROM hits)) AS unreachable_touched FROM hits")
def dif_08_mixed_surface(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    return delta.review_surface(_delta(base, head), *(delta.Side(g.nodes, g.pairs, cut(g.blast()), g.hull) for g in (base, head)))


@query(_TWO + ", met AS (SELECT file, symbol IN (SELECT v FROM b_reach) AS seen FROM mxb_nodes UNION ALL SELECT file, symbol IN (SELECT v FROM h_reach) FROM mxh_nodes) SELECT file FROM met GROUP BY file HAVING NOT bool_or(seen)")
def dif_09_mixed_unreached_files(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    return delta.unreached_files(base.nodes, head.nodes, *(graph.spread(g.pairs, g.nodes.where("entrypoint")) for g in (base, head)))


@query(_TWO + "SELECT ep FROM moves WHERE status = 'same' AND ep IN (SELECT r.ep FROM h_reach r JOIN delta d ON d.symbol = r.v WHERE classification <> 'REMOVED')")
def dif_10_mixed_unmoved(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    rows = delta.ep_delta(base.rows(), head.rows(), list(_METRICS))
    return delta.unmoved_with_changes(rows, head.pairs, _delta(base, head), head.hull)


@query(_TWO + ", c AS (SELECT r.ep, d.symbol AS node, d.delta_log2, row_number() OVER (PARTITION BY r.ep ORDER BY abs(d.delta_log2) DESC, d.file, d.symbol) AS nth, greatest(count(*) OVER (PARTITION BY r.ep) - 2, 0) AS omitted "
       "FROM h_reach r JOIN delta d ON d.symbol = r.v AND d.classification <> 'REMOVED') SELECT ep, nth, node, delta_log2, CAST(omitted AS BIGINT) AS omitted FROM c WHERE nth <= 2")
def ord_05_mixed_contributors(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    return delta.contributors(_delta(base, head).where("classification <> 'REMOVED'"), head.comps, head.packed, top=2)


_EVENTS = "ev AS (SELECT h.file, h.symbol FROM mxh_nodes h LEFT JOIN mxb_nodes b ON b.file = h.file AND b.symbol = h.symbol WHERE h.escapes AND (b.symbol IS NULL OR b.escapes = false))"


@query(_TWO + f", {_EVENTS} SELECT ev.file, ev.symbol, count(r.ep) AS hosts, count(r.ep) = 0 AS orphan FROM ev LEFT JOIN h_reach r ON r.v = ev.symbol GROUP BY ev.file, ev.symbol")
def join_15_mixed_escape_events(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    return delta.escape_events(base.nodes, head.nodes, head.blast())


@query(_TWO + f", {_EVENTS}, e AS (SELECT r.ep, ev.file, ev.symbol FROM ev JOIN h_reach r ON r.v = ev.symbol) SELECT ep, count(*) AS events, array_to_string(list(symbol ORDER BY file, symbol)[1:5], ',') AS first FROM e GROUP BY ep")
def rul_05_escape_events(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    events = delta.escape_events(base.nodes, head.nodes, head.blast()).where("not orphan")
    return delta.escapes_by_entrypoint(events, head.comps, head.packed)


@query(_TWO + ", budgets(pattern, budget) AS (VALUES ('P1*', 0.5::DOUBLE), ('P3?', -0.25::DOUBLE), ('none', -1.0::DOUBLE), ('nor this', 1.0::DOUBLE)), h AS (SELECT m.ep, b.pattern, b.budget, round(m.delta_all, 3) AS net FROM budgets b JOIN moves m ON m.ep GLOB b.pattern) "
       "SELECT ep AS scope, budget, CASE WHEN net > budget THEN 'breach' ELSE 'pass' END AS verdict, net AS observed FROM h UNION ALL "
       "SELECT pattern, budget, CASE WHEN budget < 0 THEN 'breach' ELSE 'no_match' END, CASE WHEN budget < 0 THEN 0.0::DOUBLE END FROM budgets WHERE pattern NOT IN (SELECT pattern FROM h)")
def rul_07_entrypoint_budgets(spark, sf_dir):
    base, head = (g.metrics() for g in _two(spark, sf_dir))
    return rules.entrypoint_ratchet(delta.ep_delta(base, head, ["branching_log2"]), {"P1*": 0.5, "P3?": -0.25, "none": -1.0, "nor this": 1.0})


@query(_TWO + ", worst AS (SELECT ep, max_cone_node_log2 AS w FROM h_rows) SELECT count(*) AS n FROM (SELECT DISTINCT h.ep FROM hits h JOIN worst w ON w.ep = h.ep WHERE w.w > 5.0)")
def rul_33_mixed_touched_above_limit(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    d = _delta(base, head)
    gone, up = F.col("classification") == "REMOVED", None
    for g, rows in ((base, d.where(gone)), (head, d.where(~gone))):
        found = g.callers_of(rows.select("symbol").distinct())
        up = found if up is None else up.union(found)
    return head.metrics().where("max_cone_node_log2 > 5.0").join(up.withColumnRenamed("symbol", "ep"), "ep", "left_semi").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- joins and rules on input where every case occurs

_MXN = ctes("mx_nodes", "mxb_nodes", "mxh_nodes")
_K = "CAST(substr(symbol, 2) AS BIGINT)"


@query(f"WITH {_MXN} SELECT h.symbol, CASE WHEN b.symbol IS NULL OR {_K.replace('symbol', 'h.symbol')} % 4 > 1 THEN h.branches WHEN {_K.replace('symbol', 'h.symbol')} % 4 = 1 THEN b.branches + 100 END AS branches FROM mxh_nodes h LEFT JOIN mxb_nodes b ON b.symbol = h.symbol")
def join_08_carried_between_snapshots(spark, sf_dir):
    """Symbols that are new have nothing to carry; a carried null wins; a key that the earlier row did not have leaves the value."""
    base, head = (view(spark, sf_dir, n).withColumn("k", F.expr(_K)) for n in ("mxb_nodes", "mxh_nodes"))
    keys = F.when(F.col("k") % 4 <= 1, F.array(F.lit("branches"))).otherwise(F.array().cast("array<string>"))
    before = base.select("symbol", F.when(F.col("k") % 4 == 1, F.col("branches") + 100).alias("branches"), keys.alias("keys_present"))
    return details.carried(head.select("symbol", "branches"), before, "symbol", ["branches"])


@query(f"WITH {_MXN}, ids AS (SELECT file, symbol, 'n_' || symbol || file AS id FROM mxb_nodes UNION ALL SELECT 'copy', symbol, 'n_copy' || symbol FROM mxb_nodes WHERE {_K} % 3 = 0), "
       f"wanted AS (SELECT CASE WHEN {_K} % 2 = 0 THEN 'elsewhere' ELSE file END AS file, symbol FROM mxh_nodes) "
       "SELECT w.file, w.symbol, coalesce(x.id, CASE WHEN n.n = 1 THEN n.id END) AS id, x.id IS NULL AND coalesce(n.n, 0) > 1 AS ambiguous FROM wanted w LEFT JOIN ids x ON x.file = w.file AND x.symbol = w.symbol LEFT JOIN (SELECT symbol, count(*) AS n, min(id) AS id FROM ids GROUP BY symbol) n ON n.symbol = w.symbol")
def join_09_ambiguous_symbols(spark, sf_dir):
    base, head = (view(spark, sf_dir, n).withColumn("k", F.expr(_K)) for n in ("mxb_nodes", "mxh_nodes"))
    ids = base.select("file", "symbol", F.concat(F.lit("n_"), "symbol", "file").alias("id")).unionByName(base.where("k % 3 = 0").select(F.lit("copy").alias("file"), "symbol", F.concat(F.lit("n_copy"), "symbol").alias("id")))
    wanted = head.select(F.when(F.col("k") % 2 == 0, "elsewhere").otherwise(F.col("file")).alias("file"), "symbol")
    return resolve.symbol_ids(wanted, ids).select("file", "symbol", "id", "ambiguous")


@query(f"WITH {_MXN}, h AS (SELECT 'b' AS side, file, sha256(string_agg(symbol || ':' || branches, ',' ORDER BY symbol)) AS hash FROM mxb_nodes GROUP BY file UNION ALL SELECT 'h', file, sha256(string_agg(symbol || ':' || branches, ',' ORDER BY symbol)) FROM mxh_nodes GROUP BY file), "
       "t(name, l, r) AS (VALUES ('same', 'b', 'b'), ('changed', 'b', 'h')) SELECT name, (SELECT coalesce(bool_and(coalesce(x.hash = y.hash, false)), true) FROM (SELECT * FROM h WHERE side = t.l) x FULL JOIN (SELECT * FROM h WHERE side = t.r) y ON x.file = y.file) AS fresh FROM t")
def inc_03_freshness_of_snapshots(spark, sf_dir):
    def hashes(name):
        rows = view(spark, sf_dir, name).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("symbol", "branches"))).alias("s"))  # the nodes of one file
        text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x.symbol, x.branches.cast("string"))), ",")
        return cut(rows.select("file", F.sha2(text, 256).alias("hash")))

    base, head = hashes("mxb_nodes"), hashes("mxh_nodes")
    named = lambda df, name: df.select(F.lit(name).alias("name"), "fresh")
    return named(details.is_fresh(base, base), "same").unionByName(named(details.is_fresh(base, head), "changed"))


@query(f"WITH {_MXN}, have AS (SELECT bool_or(outcome_arity IS NOT NULL) AS arity, bool_or(escapes IS NOT NULL) AS escapes, bool_or(CASE WHEN branches < 0 THEN branches END IS NOT NULL) AS score FROM mx_nodes) "
       "SELECT 'UseCaseDividend' AS rule, 'no arity' AS reason FROM have WHERE NOT arity UNION ALL SELECT 'FirewallBreaches', 'no escapes' FROM have WHERE NOT escapes UNION ALL SELECT 'ReusabilityScore', 'no score' FROM have WHERE NOT coalesce(score, false)")
def rul_23_not_evaluable_columns(spark, sf_dir):
    """A column that is there but has no value counts as missing."""
    n = view(spark, sf_dir, "mx_nodes").withColumn("score", F.when(F.col("branches") < 0, F.col("branches")))
    return rules.not_evaluable(n, {"UseCaseDividend": ("outcome_arity", "no arity"), "FirewallBreaches": ("escapes", "no escapes"), "ReusabilityScore": ("score", "no score")})


@query(_MX + ", x AS (SELECT n.symbol, n.branches, n.outcome_arity, n.escapes, n.toll_booth, count(r.ep) AS blast, CASE WHEN n.toll_booth THEN coalesce(max(o.calls), 0) ELSE 0 END AS savings FROM mx_nodes n LEFT JOIN reach r ON r.v = n.symbol LEFT JOIN outs o ON o.v = n.symbol GROUP BY n.symbol, n.branches, n.outcome_arity, n.escapes, n.toll_booth), "
       "g AS (SELECT *, greatest(0.0, greatest(0.0, log2(branches / greatest(coalesce(outcome_arity, 1), 1))) - 1.0) AS own FROM x), "
       "m AS (SELECT *, CASE WHEN escapes THEN greatest(own, 1.0) ELSE own END * (1 + log2(1.0 + blast) / 4.0) AS neg, CASE WHEN toll_booth THEN log2(1.0 + savings) ELSE 0.0 END AS pos FROM g) "
       "SELECT symbol, blast, round(CASE WHEN neg > 0 THEN -5 * (1 - exp(-neg / 8.0)) WHEN pos > 0 THEN 5 * (1 - exp(-pos / 3.0)) ELSE 0.0 END, 6) AS score FROM m")
def gra_25_reusability_of_the_graph(spark, sf_dir):
    """The score from the blast radius that the graph has; what a toll booth saves is taken to be its calls."""
    g = _mx(spark, sf_dir)
    calls = g.pairs.groupBy(F.col("a").alias("symbol")).agg(F.sum("calls").alias("calls"))
    rows = g.nodes.join(g.blast(), "symbol").join(calls, "symbol", "left").withColumn("mass_savings", F.coalesce("calls", F.lit(0)))
    return details.reusability(rows).select("symbol", "blast", F.round("score", 6).alias("score"))


@query(f"WITH {ctes('mxb_nodes', 'mxh_nodes', 'sw_parts')}, f AS (SELECT pair AS change, 'M' || CAST(CAST(floor((p - 1) / 8) AS BIGINT) AS VARCHAR) AS file FROM sw_parts WHERE n <= 2), "
       f"a AS (SELECT change, round(max({_log('b.branches')}), 6) AS l FROM f LEFT JOIN mxb_nodes b ON b.file = f.file GROUP BY change), z AS (SELECT change, round(max({_log('b.branches')}), 6) AS l FROM f LEFT JOIN mxh_nodes b ON b.file = f.file GROUP BY change) "
       "SELECT a.change, a.l AS found, z.l AS stored, (a.l IS NULL AND z.l IS NULL) OR coalesce(abs(a.l - z.l) <= 0.005, false) AS agrees FROM a JOIN z ON z.change = a.change".replace("max(CASE WHEN b.branches >= 1 THEN log2(CAST(b.branches AS DOUBLE)) ELSE 0.0 END)", "max(CASE WHEN b.branches >= 1 THEN log2(CAST(b.branches AS DOUBLE)) WHEN b.symbol IS NOT NULL THEN 0.0 END)"))
def bt_0_values_of_two_snapshots(spark, sf_dir):
    """What is worked out from one snapshot against what another one has: agreements and disagreements."""
    files = view(spark, sf_dir, "sw_parts").where("n <= 2").select(F.col("pair").alias("change"), F.expr("'M' || CAST(CAST(floor((p - 1) / 8) AS BIGINT) AS STRING)").alias("file"))
    return replay.agrees(*(replay.largest_touched(files, view(spark, sf_dir, n)) for n in ("mxb_nodes", "mxh_nodes")))


# ---------------------------------------------------------------- documents


_DOCUMENT = (
    _TWO + f", found AS (SELECT n.file, n.symbol, round({_log('n.branches')}, 6) AS value FROM mxh_nodes n JOIN delta d ON d.file = n.file AND d.symbol = n.symbol WHERE d.classification IN ('NEW', 'GROWN') AND round({_log('n.branches')}, 6) > 5.0), "
    "changes AS (SELECT file, symbol, classification, delta_log2 FROM delta), "
    "top_found AS (SELECT list(struct_pack(file := file, symbol := symbol, value := value) ORDER BY value DESC, file, symbol) AS l FROM found), "
    "top_changes AS (SELECT list(struct_pack(file := file, symbol := symbol, classification := classification, delta_log2 := delta_log2) ORDER BY abs(delta_log2) DESC, file, symbol) AS l FROM changes) "
)


def _review(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    d = _delta(base, head)
    found = rules.exponential_node(head.nodes).join(d.where("classification IN ('NEW', 'GROWN')").select("file", "symbol"), ["file", "symbol"], "left_semi")
    counts = d.agg(F.count("*").alias("changes"), F.count_if(F.col("classification") == "NEW").alias("new"), F.count_if(F.col("classification") == "REMOVED").alias("removed"))
    surface = delta.review_surface(d, *(delta.Side(g.nodes, g.pairs, cut(g.blast()), g.hull) for g in (base, head)))
    return {
        "summary": document.block(counts),
        "findings": document.listed(found, [F.desc("value"), F.asc("file"), F.asc("symbol")], ["file", "symbol", "value"], 10),
        "delta_top": document.listed(d, [F.desc(F.abs("delta_log2")), F.asc("file"), F.asc("symbol")], ["file", "symbol", "classification", "delta_log2"], 20),
        "review_surface": document.block(surface),
        "ratchet": None,  # no budget was set: the document has no such block
    }


@query(_DOCUMENT + "SELECT to_json(struct_pack(\"schema\" := 'review/1', delta_top := struct_pack(items := (SELECT l[1:20] FROM top_changes), more := greatest((SELECT count(*) FROM changes) - 20, 0)), "
       "findings := struct_pack(items := (SELECT l[1:10] FROM top_found), more := greatest((SELECT count(*) FROM found) - 10, 0)), "
       "review_surface := struct_pack(surface_union := (SELECT count(DISTINCT ep) FROM hits), surface_sum := (SELECT count(*) FROM hits), unreachable_touched := (SELECT count(*) FROM delta WHERE (file, symbol) NOT IN (SELECT (file, symbol) FROM hits))), "
       "summary := (SELECT struct_pack(changes := count(*), \"new\" := count(*) FILTER (classification = 'NEW'), removed := count(*) FILTER (classification = 'REMOVED')) FROM delta)))::VARCHAR AS document")
def snk_08_review_document(spark, sf_dir):
    return document.assembled("review/1", _review(spark, sf_dir))


@query(_DOCUMENT + "SELECT (SELECT array_to_string(list_transform(l[1:20], lambda x: '- ' || x.symbol || ' (' || x.file || '): ' || x.classification), chr(10)) FROM top_changes) || CASE WHEN (SELECT count(*) FROM changes) > 20 THEN chr(10) || '- +' || ((SELECT count(*) FROM changes) - 20) || ' more' ELSE '' END AS markdown")
def snk_08_review_markdown(spark, sf_dir):
    base, head = _two(spark, sf_dir)
    top = document.listed(_delta(base, head), [F.desc(F.abs("delta_log2")), F.asc("file"), F.asc("symbol")], ["file", "symbol", "classification"], 20)
    line = lambda x: F.concat(F.lit("- "), x.symbol, F.lit(" ("), x.file, F.lit("): "), x.classification)
    return top.select(document.markdown(F.col("block.items"), line, F.col("block.more")).alias("markdown"))


@query(f"WITH {ctes('mx_nodes', 'mx_edges')} SELECT '  \"' || coalesce(a.file || '/' || a.symbol, '<unresolved:' || e.\"from\" || '>') || '\" -> \"' || coalesce(b.file || '/' || b.symbol, '<unresolved:' || e.\"to\" || '>') || '\" [label=\"' || calls || '\"];' AS line "
       "FROM mx_edges e LEFT JOIN mx_nodes a ON a.symbol = e.\"from\" LEFT JOIN mx_nodes b ON b.symbol = e.\"to\"")
def snk_07_dot_lines(spark, sf_dir):
    names = view(spark, sf_dir, "mx_nodes").select(F.col("symbol").alias("id"), F.concat_ws("/", "file", "symbol").alias("name"))
    return document.dot(report.labelled_edges(view(spark, sf_dir, "mx_edges"), names))
