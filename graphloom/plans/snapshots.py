"""Queries over universes, settings and the differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import milli, round6
from ..operators import delta, graph, report, rules, universe
from ..sources.views import ctes, view
from ..storage import cut
from .catalogue import _CG, _DELTA, _PC, _SIDES, _cg_metrics, _graphs, _log, _side_metrics, _sides
from .registry import query

_REC = f"WITH RECURSIVE {_SIDES}"
_TOUCHED = (
    "hits AS (SELECT d.file, d.symbol, r.ep FROM delta d JOIN base_reach r ON r.v = d.symbol WHERE classification = 'REMOVED' "
    "UNION ALL SELECT d.file, d.symbol, r.ep FROM delta d JOIN head_reach r ON r.v = d.symbol WHERE classification <> 'REMOVED')"
)

# ---------------------------------------------------------------- universes and settings


@query(f"WITH {_PC} SELECT DISTINCT file FROM pc_nodes WHERE (file GLOB 'Brand#1?' OR file GLOB 'Brand#2*') AND file <> 'Brand#25'")
def fil_01_universe(spark, sf_dir):
    kept = universe.in_universe(F.col("file"), ["Brand#1?", "Brand#2*"], ["Brand#25"])
    return view(spark, sf_dir, "pc_nodes").where(kept).select("file").distinct()


_LAYERS = [(None, {"enabled": True, "threshold": 5.0}), (["Brand#3*"], {"enabled": False}), (["Brand#33", "Brand#5?"], {"enabled": True, "threshold": 4.0})]


@query(f"WITH {_PC} SELECT DISTINCT file, CASE WHEN file = 'Brand#33' OR file GLOB 'Brand#5?' THEN true WHEN file GLOB 'Brand#3*' THEN false ELSE true END AS enabled, "
       "CASE WHEN file = 'Brand#33' OR file GLOB 'Brand#5?' THEN 4.0::DOUBLE ELSE 5.0::DOUBLE END AS threshold FROM pc_nodes")
def rul_20_settings(spark, sf_dir):
    return universe.settings(view(spark, sf_dir, "pc_nodes"), _LAYERS)


@query(f"WITH {_PC} SELECT file, symbol FROM pc_nodes WHERE file <> 'Brand#11' AND file <> 'Brand#55' AND NOT (file GLOB 'Brand#3*' AND file <> 'Brand#33')")
def fil_02_rule_universe(spark, sf_dir):
    nodes = view(spark, sf_dir, "pc_nodes")
    return universe.rule_nodes(nodes, universe.settings(nodes, _LAYERS), exclude=["Brand#11"], rule_exclude=["Brand#55"]).select("file", "symbol")


@query(_CG + "SELECT ep, branching_log2 FROM metrics WHERE NOT ep GLOB 'C1*' AND ep <> 'C2'")
def fil_03_emitted_entrypoints(spark, sf_dir):
    return universe.emitted(_cg_metrics(spark, sf_dir), ["C1*", "C2"]).select("ep", "branching_log2")


@query(f"WITH {_DELTA} SELECT h.file, h.symbol, h.branches FROM head_nodes h JOIN delta d ON d.file = h.file AND d.symbol = h.symbol WHERE classification IN ('NEW', 'GROWN')")
def fil_04_diff_universe(spark, sf_dir):
    base, head = _sides(spark, sf_dir)
    return universe.diff_universe(delta.node_delta(base, head), head).select("file", "symbol", "branches")


@query(f"WITH {_PC} SELECT e.* FROM pc_edges e JOIN pc_nodes n ON n.symbol = e.\"from\" WHERE n.file GLOB 'Brand#1*'")
def fil_05_touched_edges(spark, sf_dir):
    nodes = view(spark, sf_dir, "pc_nodes")
    files = nodes.where(universe.in_universe(F.col("file"), ["Brand#1*"]))
    return universe.touched(nodes, view(spark, sf_dir, "pc_edges"), files)[1]


@query(f"WITH {ctes('fx_files')}, p AS (SELECT change, unnest([path, previous_path]) AS path FROM fx_files WHERE scorable) SELECT DISTINCT change, regexp_replace(path, '^svc/', '') AS path FROM p WHERE path IS NOT NULL")
def fil_06_touched_paths(spark, sf_dir):
    return universe.changed_paths(view(spark, sf_dir, "fx_files"), "svc/")


@query(f"WITH {ctes('fx_files')} SELECT change, path, CASE WHEN status IN ('added', 'copied') THEN NULL WHEN status = 'renamed' THEN previous_path ELSE path END AS base_path FROM fx_files WHERE scorable")
def fil_07_base_paths(spark, sf_dir):
    return universe.base_paths(view(spark, sf_dir, "fx_files"))


@query(f"WITH {ctes('pc_nodes', 'pc_edges', 'pc_ext_edges')}, big AS (SELECT symbol FROM pc_nodes WHERE branches >= 25) SELECT e.* FROM pc_ext_edges e JOIN big x ON x.symbol = e.\"from\" JOIN big y ON y.symbol = e.\"to\"")
def fil_09_induced_edges(spark, sf_dir):
    return universe.induced(view(spark, sf_dir, "pc_nodes").where("branches >= 25"), view(spark, sf_dir, "pc_ext_edges")).select("from", "to", "calls")


@query(f"WITH {ctes('pc_nodes', 'pc_edges', 'pc_ext_edges')}, ends AS (SELECT \"from\" AS s FROM pc_ext_edges UNION SELECT \"to\" FROM pc_ext_edges) SELECT s AS symbol FROM ends WHERE NOT s LIKE '<external:%'")
def fil_08_graphable(spark, sf_dir):
    e = view(spark, sf_dir, "pc_ext_edges")
    ends = e.select(F.col("from").alias("symbol")).union(e.select("to")).distinct()
    return ends.where(~F.startswith("symbol", F.lit("<external:")))


@query(f"WITH {_PC}, {ctes('fx_scores')}, callers AS (SELECT e.\"to\" AS symbol, sum(n.branches) AS total FROM (SELECT DISTINCT \"from\", \"to\" FROM pc_edges WHERE \"from\" <> \"to\") e JOIN pc_nodes n ON n.symbol = e.\"from\" GROUP BY 1), "
       "a AS (SELECT n.file, n.symbol, round(log2(CAST(c.total AS DOUBLE)) - log2(CAST(n.branches AS DOUBLE)), 6) AS absorb, s.score FROM pc_nodes n JOIN callers c USING (symbol) JOIN fx_scores s ON s.symbol = n.symbol WHERE n.branches >= 1) "
       "SELECT file, symbol, absorb, score FROM a WHERE absorb >= 2 AND score >= 0 ORDER BY absorb DESC, file, symbol LIMIT 5")
def fil_10_absorb_candidates(spark, sf_dir):
    from .catalogue import gra_26_absorb

    names = view(spark, sf_dir, "pc_nodes").select("file", "symbol")
    rows = gra_26_absorb(spark, sf_dir).join(names, "symbol").join(view(spark, sf_dir, "fx_scores").select("symbol", "score"), "symbol")
    return universe.absorb_candidates(rows, 2.0).select("file", "symbol", "absorb", "score")


@query(f"WITH {_PC} SELECT count(*) FILTER (entrypoint) AS eps, count(DISTINCT file) AS files, count(DISTINCT (file, symbol)) AS identities, bool_or(escapes IS NOT NULL) AS analyzed, (SELECT count(*) FROM pc_edges) AS edges FROM pc_nodes")
def fil_13_vintage(spark, sf_dir):
    n = view(spark, sf_dir, "pc_nodes")
    row = n.agg(F.count_if("entrypoint").alias("eps"), F.countDistinct("file").alias("files"), F.countDistinct("file", "symbol").alias("identities"), F.bool_or(F.col("escapes").isNotNull()).alias("analyzed"))
    return row.crossJoin(view(spark, sf_dir, "pc_edges").agg(F.count("*").alias("edges")))  # one row each


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?:^|\\s)(@[A-Za-z0-9_-]+)', 1)) AS handles, len(regexp_extract_all(coalesce(text, ''), '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+)', 1)) AS emails FROM documents")
def fil_15_identifiers(spark, sf_dir):
    return universe.identifiers(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text").select("doc_id", "handles", "emails")


# ---------------------------------------------------------------- sets


@query(f"WITH {_DELTA} SELECT file, symbol FROM base_nodes WHERE file <> 'Brand#12' UNION SELECT file, symbol FROM head_nodes WHERE file <> 'Brand#12'")
def set_01_identities(spark, sf_dir):
    base, head = _sides(spark, sf_dir)
    return base.select("file", "symbol").union(head.select("file", "symbol")).where("file <> 'Brand#12'").distinct()


@query(f"WITH {ctes('head_nodes', 'moved_nodes')} SELECT file FROM head_nodes INTERSECT SELECT file FROM moved_nodes")
def set_02_candidate_files(spark, sf_dir):
    return view(spark, sf_dir, "head_nodes").select("file").intersect(view(spark, sf_dir, "moved_nodes").select("file"))


@query(f"WITH {_DELTA} SELECT file, symbol FROM head_nodes WHERE entrypoint EXCEPT SELECT file, symbol FROM base_nodes WHERE entrypoint")
def set_03_new_entrypoints(spark, sf_dir):
    base, head = (n.where("entrypoint").select("file", "symbol") for n in _sides(spark, sf_dir))
    return head.distinct().join(base, ["file", "symbol"], "left_anti")


@query(f"WITH {ctes('base_nodes', 'head_nodes', 'moved_nodes')} SELECT file, symbol FROM base_nodes INTERSECT SELECT file, symbol FROM head_nodes INTERSECT SELECT file, symbol FROM moved_nodes")
def set_04_common_keys(spark, sf_dir):
    a, b, c = (view(spark, sf_dir, n).select("file", "symbol") for n in ("base_nodes", "head_nodes", "moved_nodes"))
    return a.intersect(b).intersect(c)


# ---------------------------------------------------------------- differences

_MOVED = ctes("base_nodes", "head_nodes", "moved_nodes")


@query(f"WITH {_MOVED} SELECT b.symbol, b.file AS from_file, m.file AS to_file FROM base_nodes b JOIN moved_nodes m ON b.symbol = m.symbol AND b.file <> m.file AND b.branches IS NOT DISTINCT FROM m.branches")
def dif_03_moves(spark, sf_dir):
    base, head = view(spark, sf_dir, "base_nodes"), view(spark, sf_dir, "moved_nodes")
    return delta.moves(delta.node_delta(base, head), base, head)


_EPS = (
    f"{_side_metrics('base', 'base_nodes', 'base_edges')}, {_side_metrics('head', 'head_nodes', 'pc_edges')}, "
    "eps AS (SELECT coalesce(b.ep, h.ep) AS ep, CASE WHEN b.ep IS NULL THEN 'new' WHEN h.ep IS NULL THEN 'removed' WHEN b.branching_log2 <> h.branching_log2 OR b.reach <> h.reach OR b.files <> h.files THEN 'moved' ELSE 'same' END AS status, "
    "round(coalesce(h.branching_log2, 0) - coalesce(b.branching_log2, 0), 6) AS delta_branching_log2 FROM base_m b FULL JOIN head_m h ON b.ep = h.ep)"
)


def _eps(spark, sf_dir, graphs):
    base, head = (g.metrics() for g in graphs)
    return delta.ep_delta(base, head, ["branching_log2", "reach", "files"])


@query(f"{_REC}, {_EPS} SELECT ep, status, delta_branching_log2 FROM eps WHERE status <> 'same'")
def dif_06_ep_entries(spark, sf_dir):
    return delta.ep_entries(_eps(spark, sf_dir, _graphs(spark, sf_dir))).select("ep", "status", "delta_branching_log2")


@query(f"{_REC}, {_EPS} SELECT ep, status, delta_branching_log2, row_number() OVER (ORDER BY CASE WHEN status IN ('new', 'removed') THEN 0 ELSE abs(delta_branching_log2) END DESC, status, ep) AS nth FROM eps WHERE status <> 'same' QUALIFY nth <= 20")
def ord_04_ep_entries(spark, sf_dir):
    rows = dif_06_ep_entries(spark, sf_dir)
    size = F.when(F.col("status").isin("new", "removed"), F.lit(0.0)).otherwise(F.abs("delta_branching_log2"))
    return report.numbered(rows.withColumn("size", size), [F.desc("size"), F.asc("status"), F.asc("ep")], 20).drop("size")


@query(f"WITH {_DELTA}, {ctes('base_edges', 'pc_edges')}, e AS (SELECT DISTINCT coalesce(x.\"from\", y.\"from\") AS symbol FROM base_edges x FULL JOIN pc_edges y ON x.\"from\" = y.\"from\" AND x.\"to\" = y.\"to\" WHERE x.calls IS DISTINCT FROM y.calls) "
       "SELECT b.file, b.symbol FROM base_nodes b JOIN head_nodes h ON b.file = h.file AND b.symbol = h.symbol JOIN e ON e.symbol = b.symbol WHERE (b.file, b.symbol) NOT IN (SELECT (file, symbol) FROM delta)")
def dif_07_coupling_flips(spark, sf_dir):
    base, head = _sides(spark, sf_dir)
    return delta.coupling_flips(base, head, view(spark, sf_dir, "base_edges"), view(spark, sf_dir, "pc_edges"), delta.node_delta(base, head))


@query(f"{_REC}, c AS (SELECT r.ep, d.symbol AS node, d.delta_log2, row_number() OVER (PARTITION BY r.ep ORDER BY abs(d.delta_log2) DESC, d.file, d.symbol) AS nth, greatest(count(*) OVER (PARTITION BY r.ep) - 5, 0) AS omitted "
       "FROM head_reach r JOIN delta d ON d.symbol = r.v AND d.classification <> 'REMOVED') SELECT ep, nth, node, delta_log2, CAST(omitted AS BIGINT) AS omitted FROM c WHERE nth <= 5")
def ord_05_contributors(spark, sf_dir):
    base, head = _graphs(spark, sf_dir)
    rows = delta.node_delta(base.nodes, head.nodes).where("classification <> 'REMOVED'")
    return delta.contributors(cut(rows), head.comps, head.packed)


@query(f"{_REC}, met AS (SELECT n.file, n.symbol IN (SELECT v FROM base_reach) AS seen FROM base_nodes n UNION ALL SELECT n.file, n.symbol IN (SELECT v FROM head_reach) FROM head_nodes n) SELECT file FROM met GROUP BY file HAVING NOT bool_or(seen)")
def dif_09_unreached_files(spark, sf_dir):
    base, head = _graphs(spark, sf_dir)
    return delta.unreached_files(base.nodes, head.nodes, *(graph.spread(g.pairs, g.nodes.where("entrypoint")) for g in (base, head)))


@query(f"{_REC}, {_EPS} SELECT ep FROM eps WHERE status = 'same' AND ep IN (SELECT r.ep FROM head_reach r JOIN delta d ON d.symbol = r.v WHERE classification <> 'REMOVED')")
def dif_10_unmoved_with_changes(spark, sf_dir):
    base, head = _graphs(spark, sf_dir)
    return delta.unmoved_with_changes(_eps(spark, sf_dir, (base, head)), head.pairs, delta.node_delta(base.nodes, head.nodes))


_SC = ctes("fx_scores") + ", now AS (SELECT symbol, score + ((p_partkey % 3) - 1) * 0.2504 AS score FROM fx_scores WHERE p_partkey % 31 <> 0), " \
    "sd AS (SELECT coalesce(b.symbol, h.symbol) AS symbol, CAST(round(b.score * 1000) AS BIGINT) AS base, CAST(round(h.score * 1000) AS BIGINT) AS head FROM fx_scores b FULL JOIN now h ON b.symbol = h.symbol)"


def _score_sides(spark, sf_dir):
    base = view(spark, sf_dir, "fx_scores")
    return base, base.where("p_partkey % 31 <> 0").withColumn("score", F.col("score") + ((F.col("p_partkey") % 3) - 1) * F.lit(0.2504))


@query(f"WITH {_SC} SELECT symbol, base, head, head - base AS change FROM sd")
def dif_11_score_deltas(spark, sf_dir):
    return delta.score_deltas(*_score_sides(spark, sf_dir), "symbol")


@query(f"WITH {_SC} SELECT symbol, base, head, head - base AS change FROM sd ORDER BY head ASC NULLS LAST, symbol LIMIT 20")
def ord_06_lowest_scores(spark, sf_dir):
    return delta.score_deltas(*_score_sides(spark, sf_dir), "symbol", 20)


@query(f"WITH {_MOVED}, l AS (SELECT file, count(*) AS n, bit_xor(hash(symbol, branches, escapes)) AS x FROM head_nodes GROUP BY file), r AS (SELECT file, count(*) AS n, bit_xor(hash(symbol, branches, escapes)) AS x FROM moved_nodes GROUP BY file) "
       "SELECT coalesce(l.file, r.file) AS file, CASE WHEN l.file IS NULL THEN 'missing' WHEN r.file IS NULL THEN 'extra' WHEN l.n = r.n AND l.x = r.x THEN 'same' ELSE 'changed' END AS status FROM l FULL JOIN r ON l.file = r.file")
def dif_12_drift(spark, sf_dir):
    return delta.drift(view(spark, sf_dir, "head_nodes"), view(spark, sf_dir, "moved_nodes"), ["symbol", "branches", "escapes"])


@query(f"WITH {_DELTA} SELECT file, symbol, delta_log2, row_number() OVER (ORDER BY abs(delta_log2) DESC, file, symbol) AS nth FROM delta QUALIFY nth <= 20")
def ord_03_largest_changes(spark, sf_dir):
    rows = delta.node_delta(*_sides(spark, sf_dir)).select("file", "symbol", "delta_log2")
    return report.numbered(rows, [F.desc(F.abs("delta_log2")), F.asc("file"), F.asc("symbol")], 20)


@query(f"{_REC}, {_TOUCHED} SELECT d.file, d.symbol, count(h.ep) AS n_eps FROM delta d LEFT JOIN hits h ON h.file = d.file AND h.symbol = d.symbol GROUP BY d.file, d.symbol")
def join_14_changed_nodes_in_cones(spark, sf_dir):
    base, head = _graphs(spark, sf_dir)
    d = cut(delta.node_delta(base.nodes, head.nodes))
    gone = F.col("classification") == "REMOVED"
    rows = d.where(gone).join(base.blast(), "symbol", "left").unionByName(d.where(~gone).join(head.blast(), "symbol", "left"))
    return rows.select("file", "symbol", F.coalesce("blast", F.lit(0)).cast("long").alias("n_eps"))


@query(f"{_REC}, ev AS (SELECT h.file, h.symbol FROM head_nodes h LEFT JOIN base_nodes b ON b.file = h.file AND b.symbol = h.symbol WHERE h.escapes AND (b.symbol IS NULL OR b.escapes = false)) "
       "SELECT ev.file, ev.symbol, count(r.ep) AS hosts, count(r.ep) = 0 AS orphan FROM ev LEFT JOIN head_reach r ON r.v = ev.symbol GROUP BY ev.file, ev.symbol")
def join_15_escape_events(spark, sf_dir):
    base, head = _graphs(spark, sf_dir)
    return delta.escape_events(base.nodes, head.nodes, head.blast())


@query(f"WITH {_DELTA} SELECT h.file, h.symbol, round({_log('h.branches')}, 6) AS value, d.base_branches, d.head_branches FROM head_nodes h LEFT JOIN delta d ON d.file = h.file AND d.symbol = h.symbol WHERE round({_log('h.branches')}, 6) > 5.0")
def join_20_findings_with_delta(spark, sf_dir):
    base, head = _sides(spark, sf_dir)
    d = delta.node_delta(base, head).select("file", "symbol", "base_branches", "head_branches")
    return rules.exponential_node(head).join(d, ["file", "symbol"], "left")


# ---------------------------------------------------------------- rules over a difference


@query(f"{_REC}, {_TOUCHED} SELECT count(DISTINCT ep) AS surface, 100 AS most, count(DISTINCT ep) > 100 AS breached FROM hits")
def rul_08_review_surface(spark, sf_dir):
    base, head = _graphs(spark, sf_dir)
    sides = (delta.Side(g.nodes, g.pairs, cut(g.blast())) for g in (base, head))
    return rules.review_surface_limit(delta.review_surface(cut(delta.node_delta(base.nodes, head.nodes)), *sides), 100)


@query(f"WITH {_DELTA}, scopes(scope) AS (VALUES ('Brand#1*'), ('Brand#2?'), ('none')) SELECT scope, round(coalesce(sum({_log('branches')}), 0.0), 3) AS total FROM scopes LEFT JOIN head_nodes ON file GLOB scope GROUP BY scope")
def rul_31_ratchet_context(spark, sf_dir):
    return rules.ratchet_context(_sides(spark, sf_dir)[1], ["Brand#1*", "Brand#2?", "none"])


@query(f"WITH {_DELTA}, scopes(scope) AS (VALUES ('Brand#1*'), ('Brand#2?')) SELECT scope, symbol, delta_log2, row_number() OVER (PARTITION BY scope ORDER BY abs(delta_log2) DESC, file, symbol) AS nth FROM scopes JOIN delta ON file GLOB scope WHERE classification <> 'CHANGED_ATTRS' QUALIFY nth <= 5")
def rul_32_ratchet_contributors(spark, sf_dir):
    return rules.ratchet_contributors(delta.node_delta(*_sides(spark, sf_dir)), ["Brand#1*", "Brand#2?"])


@query(f"{_REC}, {_TOUCHED}, worst AS (SELECT ep, max({_log('branches')}) AS w FROM head_cone GROUP BY ep), head_cone2 AS (SELECT 1) SELECT count(*) AS n FROM (SELECT DISTINCT h.ep FROM hits h JOIN worst w ON w.ep = h.ep JOIN head_nodes n ON n.symbol = h.ep WHERE w.w > 5.0)".replace(", worst AS", ", head_cone AS (SELECT r.ep, n.branches FROM head_reach r JOIN head_nodes n ON n.symbol = r.v), worst AS").replace(", head_cone2 AS (SELECT 1)", ""))
def rul_33_touched_above_limit(spark, sf_dir):
    base, head = _graphs(spark, sf_dir)
    d = cut(delta.node_delta(base.nodes, head.nodes))
    gone = F.col("classification") == "REMOVED"
    up = None
    for g, rows in ((base, d.where(gone)), (head, d.where(~gone))):
        found = graph.spread(g.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), rows.select("symbol").distinct())
        up = found if up is None else up.union(found)
    worst = head.metrics().where("max_cone_node_log2 > 5.0")
    return worst.join(up.withColumnRenamed("symbol", "ep"), "ep", "left_semi").agg(F.count("*").alias("n"))


@query(f"WITH {_PC}, f AS (SELECT file, symbol, 'ExponentialNode' AS rule, 3 AS rank FROM pc_nodes WHERE round({_log('branches')}, 6) > 5.0 UNION ALL SELECT file, symbol, 'Escapes', 1 FROM pc_nodes WHERE escapes) "
       "SELECT rule, file, symbol, row_number() OVER (ORDER BY rank DESC, file, symbol, rule) AS nth FROM f QUALIFY nth <= 50")
def ord_08_findings(spark, sf_dir):
    return report.numbered(_findings(spark, sf_dir).withColumn("rank", rules.severity_rank(F.col("severity"))), [F.desc("rank"), F.asc("file"), F.asc("symbol"), F.asc("rule")], 50).drop("rank", "severity")


def _findings(spark, sf_dir):
    n = view(spark, sf_dir, "pc_nodes")
    a = rules.exponential_node(n).select(F.lit("ExponentialNode").alias("rule"), "file", "symbol", F.lit("error").alias("severity"))
    return a.unionByName(n.where("escapes").select(F.lit("Escapes").alias("rule"), "file", "symbol", F.lit("info").alias("severity")))


@query(f"WITH {_PC}, f AS (SELECT file, symbol, 'ExponentialNode' AS rule, 'error' AS severity FROM pc_nodes WHERE round({_log('branches')}, 6) > 5.0 UNION ALL SELECT file, symbol, 'Escapes', 'info' FROM pc_nodes WHERE escapes) "
       "SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(DISTINCT (file, symbol)) AS nodes, count(DISTINCT rule) AS rules, "
       "CASE WHEN bool_or(severity = 'error') THEN 1 ELSE 0 END AS exit_code FROM f")
def agg_13_severity_counts(spark, sf_dir):
    return rules.summary(_findings(spark, sf_dir), "error")


@query(f"WITH {_PC} SELECT file, symbol, CAST(round(round({_log('branches')}, 6) * 1000) AS BIGINT) AS value FROM pc_nodes WHERE round({_log('branches')}, 6) > 5.0")
def rul_30_baseline(spark, sf_dir):
    found = rules.exponential_node(view(spark, sf_dir, "pc_nodes"))
    return found.select("file", "symbol", milli(F.col("value")).alias("value"))


@query(_CG + ", b AS (SELECT ep, 'mass' AS metric, CAST(mass AS BIGINT) * 1000 AS now, CASE WHEN CAST(substr(ep, 2) AS BIGINT) % 2 = 0 THEN 90000 END AS entry FROM metrics WHERE mass > 60 UNION ALL SELECT ep, 'reach', reach * 1000, CASE WHEN CAST(substr(ep, 2) AS BIGINT) % 3 = 0 THEN 70000 END FROM metrics WHERE reach > 60) "
       "SELECT ep, string_agg(metric, ',' ORDER BY metric) FILTER (entry IS NULL OR now > entry) AS fired, string_agg(metric, ',' ORDER BY metric) FILTER (now <= entry) AS skipped FROM b GROUP BY ep".replace("WITH RECURSIVE", "WITH RECURSIVE"))
def rul_22_ep_todo(spark, sf_dir):
    m = _cg_metrics(spark, sf_dir)
    k = F.substring("ep", 2, 20).cast("long")
    todo = m.where(k % 2 == 0).select("ep", F.lit("mass").alias("metric"), F.lit(90000).cast("long").alias("value")).unionByName(
        m.where(k % 3 == 0).select("ep", F.lit("reach").alias("metric"), F.lit(70000).cast("long").alias("value"))
    )
    return rules.ep_todo(m, {"mass": 60, "reach": 60}, todo).where("fired is not null or skipped is not null").select("ep", "fired", "skipped")


@query(f"WITH {ctes('fx_scores')} SELECT symbol, score FROM fx_scores WHERE score <= -4 AND p_partkey % 7 <> 0")
def rul_02_reusability_score(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_scores").withColumns({"outcome_arity": F.lit(2), "collapse": F.when(F.col("p_partkey") % 7 == 0, F.lit(-1.0)).otherwise(F.round(F.col("branches") / 2.0, 2))})
    return rules.reusability_score(rows).select("symbol", "score")


@query(f"WITH {_PC} SELECT 'ReusabilityScore' AS rule, 'no score' AS reason UNION ALL SELECT 'UseCaseDividend', 'no arity'")
def rul_23_not_evaluable(spark, sf_dir):
    n = view(spark, sf_dir, "pc_nodes")
    return rules.not_evaluable(n, {"ReusabilityScore": ("score", "no score"), "UseCaseDividend": ("dividend_arity", "no arity"), "FirewallBreaches": ("escapes", "no escapes")})
