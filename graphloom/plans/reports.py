"""Queries over resolution, reports and replays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import band, round6
from ..operators import graph, replay, report, resolve
from ..sources.views import ctes, view
from .catalogue import _DIV, _LAYERS, _LOG, _PL, _TERMS, _pc, _pl, _reach
from .registry import query

# ---------------------------------------------------------------- resolution

_ID = "substr(sha256(symbol), 1, 16)"


@query("SELECT l_partkey AS symbol, first(l_orderkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS l_orderkey FROM lineitem GROUP BY l_partkey")
def cap_01_first_definition(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("symbol"), "l_orderkey", "l_linenumber", "l_suppkey")
    return resolve.first_definition(rows, ["symbol"], ["l_orderkey", "l_linenumber", "l_suppkey"]).select("symbol", "l_orderkey")


_CALLS = ctes("fx_calls", "pc_nodes")


@query(f"WITH {_CALLS}, m AS (SELECT c.site_id, 0 AS rank, n.symbol AS target, 'self' AS provenance FROM fx_calls c JOIN pc_nodes n ON n.file = c.owner AND n.symbol = c.name UNION ALL "
       "SELECT c.site_id, 1, n.symbol, 'constant' FROM fx_calls c JOIN pc_nodes n ON n.symbol = c.constant UNION ALL SELECT c.site_id, 2, '<external:' || c.verb || '>', 'external' FROM fx_calls c WHERE c.verb IS NOT NULL) "
       "SELECT c.site_id, x.target, x.provenance FROM fx_calls c LEFT JOIN (SELECT site_id, target, provenance FROM m QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY rank, target) = 1) x USING (site_id)")
def cap_07_call_tiers(spark, sf_dir):
    calls, n = view(spark, sf_dir, "fx_calls"), view(spark, sf_dir, "pc_nodes").select("file", "symbol")
    own = calls.join(n, (n.file == calls.owner) & (n.symbol == calls.name)).select("site_id", F.col("symbol").alias("target"))
    const = calls.join(n, n.symbol == calls.constant).select("site_id", F.col("symbol").alias("target"))
    out = calls.where("verb is not null").select("site_id", F.concat(F.lit("<external:"), "verb", F.lit(">")).alias("target"))
    return resolve.first_tier(calls, [("self", own), ("constant", const), ("external", out)])


@query(f"WITH {_CALLS}, r AS (SELECT CASE WHEN n.symbol IS NOT NULL THEN 'self' WHEN k.symbol IS NOT NULL THEN 'constant' WHEN c.verb IS NOT NULL THEN 'external' END AS provenance FROM fx_calls c LEFT JOIN pc_nodes n ON n.file = c.owner AND n.symbol = c.name LEFT JOIN pc_nodes k ON k.symbol = c.constant), "
       "w(provenance) AS (VALUES ('self'), ('constant'), ('probe'), ('external'), ('unknown')) SELECT w.provenance, count(r.provenance) FILTER (w.provenance <> 'unknown') + CASE WHEN w.provenance = 'unknown' THEN (SELECT count(*) FROM r WHERE provenance IS NULL) ELSE 0 END AS n FROM w LEFT JOIN r USING (provenance) GROUP BY w.provenance")
def cap_12_provenance_counts(spark, sf_dir):
    return resolve.closed_tally(cap_07_call_tiers(spark, sf_dir), "provenance", ["self", "constant", "probe", "external"], "unknown")


@query(f"WITH {ctes('pc_nodes', 'pc_edges', 'pc_ext_edges')}, c AS (SELECT \"from\", \"to\" FROM pc_ext_edges) SELECT c.\"from\", c.\"to\", count(*) AS calls FROM c WHERE \"from\" IN (SELECT symbol FROM pc_nodes) AND \"to\" IN (SELECT symbol FROM pc_nodes) GROUP BY 1, 2")
def cap_14_edges_of_calls(spark, sf_dir):
    return resolve.edges_of_calls(view(spark, sf_dir, "pc_ext_edges").select("from", "to"), view(spark, sf_dir, "pc_nodes"))


@query(f"WITH {ctes('fx_calls')} SELECT DISTINCT verb AS category, constant AS target FROM fx_calls WHERE verb IS NOT NULL AND constant IS NOT NULL UNION ALL SELECT 'generic', NULL")
def cap_15_external_sinks(spark, sf_dir):
    sinks = view(spark, sf_dir, "fx_calls").where("verb is not null and constant is not null").select(F.col("verb").alias("category"), F.col("constant").alias("target")).distinct()
    return sinks.unionByName(spark.createDataFrame([("generic", None)], "category string, target string"))


@query(f"WITH {_PL} SELECT symbol, CASE WHEN entrypoint AND entrypoint_kind = 'routed' THEN 'routed' WHEN entrypoint THEN 'seeded' WHEN escapes THEN 'top_level' WHEN regexp_matches(symbol, '^P1.*#2$') THEN 'pattern' END AS category FROM pl_nodes")
def cap_18_category(spark, sf_dir):
    c = resolve.category(
        (F.col("entrypoint") & (F.col("entrypoint_kind") == "routed"), "routed"), (F.col("entrypoint"), "seeded"), (F.col("escapes"), "top_level"), (F.col("symbol").rlike("^P1.*#2$"), "pattern")
    )
    return view(spark, sf_dir, "pl_nodes").select("symbol", c.alias("category"))


@query(f"WITH {_PL} SELECT k AS entrypoint_kind, (SELECT count(*) FROM pl_nodes WHERE entrypoint AND entrypoint_kind = k) AS n FROM (VALUES ('routed'), ('jobs'), ('rake'), ('cron')) w(k)")
def cap_23_entrypoint_counters(spark, sf_dir):
    return resolve.closed_tally(view(spark, sf_dir, "pl_nodes").where("entrypoint"), "entrypoint_kind", ["routed", "jobs", "rake", "cron"])


@query(f"WITH {ctes('fx_calls')} SELECT count(*) AS sites, count(*) FILTER (verb = 'queue') AS dynamic, round(1 - count(*) FILTER (verb = 'queue') / count(*), 4) AS coverage FROM fx_calls")
def cap_24_dispatch_coverage(spark, sf_dir):
    dyn = F.count_if(F.col("verb") == "queue")
    return view(spark, sf_dir, "fx_calls").agg(F.count("*").alias("sites"), dyn.alias("dynamic"), F.round(1 - F.try_divide(dyn, F.count("*")), 4).alias("coverage"))


@query(f"WITH {ctes('head_nodes', 'moved_nodes')}, ids AS (SELECT file, symbol, 'n_' || symbol AS id FROM head_nodes), r AS (SELECT m.file, m.symbol, x.id AS exact, (SELECT max(id) FROM ids a WHERE a.symbol = m.symbol) AS alone FROM moved_nodes m LEFT JOIN ids x ON x.file = m.file AND x.symbol = m.symbol) "
       "SELECT file, symbol, coalesce(exact, alone) AS id, false AS ambiguous FROM r")
def join_09_symbol_ids(spark, sf_dir):
    ids = view(spark, sf_dir, "head_nodes").select("file", "symbol", F.concat(F.lit("n_"), "symbol").alias("id"))
    return resolve.symbol_ids(view(spark, sf_dir, "moved_nodes").select("file", "symbol"), ids).select("file", "symbol", "id", "ambiguous")


@query(f"WITH {ctes('pc_nodes', 'pc_edges')}, names AS (SELECT symbol AS id, file || '/' || symbol AS name FROM pc_nodes WHERE CAST(substr(symbol, 2) AS BIGINT) % 23 <> 0) "
       "SELECT coalesce(a.name, '<unresolved:' || e.\"from\" || '>') AS from_label, coalesce(b.name, '<unresolved:' || e.\"to\" || '>') AS to_label, calls FROM pc_edges e LEFT JOIN names a ON a.id = e.\"from\" LEFT JOIN names b ON b.id = e.\"to\"")
def join_02_labelled_edges(spark, sf_dir):
    return report.labelled_edges(view(spark, sf_dir, "pc_edges"), _names(spark, sf_dir))


def _names(spark, sf_dir):
    n = view(spark, sf_dir, "pc_nodes").where("CAST(substr(symbol, 2) AS BIGINT) % 23 <> 0")
    return n.select(F.col("symbol").alias("id"), F.concat_ws("/", "file", "symbol").alias("name"))


@query(f"WITH {ctes('pc_nodes', 'pc_edges')}, names AS (SELECT symbol AS id, file || '/' || symbol AS name FROM pc_nodes WHERE CAST(substr(symbol, 2) AS BIGINT) % 23 <> 0) "
       "SELECT l_orderkey AS path_id, string_agg(coalesce(name, '<unresolved:P' || l_partkey || '>'), ' > ' ORDER BY l_linenumber, l_partkey) AS chain FROM lineitem LEFT JOIN names ON id = 'P' || l_partkey GROUP BY l_orderkey")
def join_04_resolved_paths(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("path_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    return report.resolved_paths(rows.select("path_id", F.transform("s.l_partkey", lambda p: F.concat(F.lit("P"), p.cast("string"))).alias("ids")), _names(spark, sf_dir))


# ---------------------------------------------------------------- graph reports


@query(f"WITH RECURSIVE {_PL}, {_reach('pl_nodes', 'pl_edges')} SELECT count(DISTINCT v) AS union_reach FROM reached JOIN pl_nodes ON symbol = v")
def gra_09_union_reach(spark, sf_dir):
    g = _pl(spark, sf_dir)
    seen = graph.spread(g.pairs, g.nodes.where("entrypoint"))
    return g.nodes.join(seen, "symbol", "left_semi").agg(F.countDistinct("symbol").alias("union_reach"))


@query(f"WITH RECURSIVE {_PL}, {_reach('pl_nodes', 'pl_edges')} SELECT ep, nth, symbol, round({_LOG.format(c='branches')}, 6) AS log2 FROM (SELECT r.ep, n.symbol, n.branches, row_number() OVER (PARTITION BY r.ep ORDER BY n.branches DESC, n.file, n.symbol) AS nth FROM reached r JOIN pl_nodes n ON n.symbol = r.v WHERE n.branches >= 1) WHERE nth <= 5")
def gra_11_top_nodes(spark, sf_dir):
    g = _pl(spark, sf_dir)
    return graph.top_nodes(g.nodes, g.comps, g.packed)


@query(f"WITH RECURSIVE {_PL}, {_reach('pl_nodes', 'pl_edges')} SELECT ep FROM reached WHERE v = (SELECT max(symbol) FROM pl_nodes)")
def gra_22_eps_reaching(spark, sf_dir):
    g = _pl(spark, sf_dir)
    last = g.nodes.agg(F.max("symbol").alias("symbol"))
    up = graph.spread(g.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), last)
    return g.nodes.where("entrypoint").join(up, "symbol", "left_semi").select(F.col("symbol").alias("ep"))


@query(f"WITH RECURSIVE {_PL}, {_reach('pl_nodes', 'pl_edges')}, b AS (SELECT v, count(*) AS blast FROM reached JOIN pl_nodes ON symbol = v GROUP BY v) SELECT CAST(max(blast) AS BIGINT) AS most, CAST(quantile_disc(blast, 0.9) AS DOUBLE) AS p90, CAST(median(blast) AS DOUBLE) AS med, round(avg(blast), 6) AS mean FROM b")
def gra_23_blast_block(spark, sf_dir):
    return report.distribution(_pl(spark, sf_dir).blast().where("blast > 0"), "blast")


@query(f"WITH RECURSIVE {_PL}, {_reach('pl_nodes', 'pl_edges')} SELECT (SELECT count(DISTINCT v) FROM reached JOIN pl_nodes ON symbol = v) AS forward, (SELECT count(*) FROM pl_nodes) AS total, (SELECT count(*) FROM pl_nodes WHERE NOT escapes) AS scored")
def gra_29_connectivity(spark, sf_dir):
    n = view(spark, sf_dir, "pl_nodes").agg(F.count("*").alias("total"), F.count_if(~F.col("escapes")).alias("scored"))
    return gra_09_union_reach(spark, sf_dir).withColumnRenamed("union_reach", "forward").crossJoin(n)  # one row each


@query(f"WITH {_PL} SELECT symbol, round(log2(branches) - log2(least(branches, coalesce(outcome_arity, 1))), 6) AS gap, row_number() OVER (ORDER BY log2(branches) - log2(least(branches, coalesce(outcome_arity, 1))) DESC, file, symbol) AS nth FROM pl_nodes WHERE branches >= 1 QUALIFY nth <= 5")
def gra_20_extraction_gap(spark, sf_dir):
    gap = F.log2("branches") - F.log2(F.least("branches", F.coalesce("outcome_arity", F.lit(1)).cast("long")))
    rows = view(spark, sf_dir, "pl_nodes").where("branches >= 1").select("file", "symbol", gap.alias("g"))
    return report.numbered(rows, [F.desc("g"), F.asc("file"), F.asc("symbol")], 5).select("symbol", round6(F.col("g")).alias("gap"), "nth")


@query(f"WITH RECURSIVE {_PL}, {_LAYERS}, {_TERMS}, d AS ({_DIV}) SELECT ep, variety, variety >= 1000000.0 AS capped FROM d")
def gra_19_variety_capped(spark, sf_dir):
    return _pl(spark, sf_dir).dividends().select("ep", "variety", (F.col("variety") >= graph.CAP).alias("capped"))


# ---------------------------------------------------------------- aggregates and orders

_SCORES = ctes("fx_scores")


@query(f"WITH {_SCORES}, b AS (SELECT CAST(greatest(-5, least(5, sign(score) * floor(abs(score) + 0.5))) AS INT) AS band FROM fx_scores WHERE score IS NOT NULL) SELECT CAST(k AS VARCHAR) AS band, (SELECT count(*) FROM b WHERE band = k) AS n FROM (SELECT unnest(range(-5, 6)) AS k)")
def agg_03_closed_bands(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_scores").where("score is not null").select(band(F.col("score")).cast("string").alias("band"))
    return resolve.closed_tally(rows, "band", [str(k) for k in range(-5, 6)])


@query(f"WITH {_SCORES} SELECT class_id, first(symbol ORDER BY score DESC, symbol) AS symbol, max(score) AS score FROM fx_scores WHERE score IS NOT NULL GROUP BY class_id")
def agg_12_argmax(spark, sf_dir):
    return report.worst_members(view(spark, sf_dir, "fx_scores"), "class_id", "score", "symbol")


@query(f"WITH {_SCORES} SELECT class_id, bool_or(score < 0) AS some, bool_and(score IS NOT NULL) AS every, NOT bool_or(coalesce(score > 4, false)) AS none FROM fx_scores GROUP BY class_id")
def agg_14_predicates(spark, sf_dir):
    s = F.col("score")
    return view(spark, sf_dir, "fx_scores").groupBy("class_id").agg(F.bool_or(s < 0).alias("some"), F.bool_and(s.isNotNull()).alias("every"), (~F.bool_or(F.coalesce(s > 4, F.lit(False)))).alias("none"))


@query(f"WITH {_SCORES} SELECT symbol, score, row_number() OVER (ORDER BY score DESC NULLS LAST, symbol) AS nth FROM fx_scores QUALIFY nth <= 25")
def ord_01_ranked(spark, sf_dir):
    return report.numbered(view(spark, sf_dir, "fx_scores").select("symbol", "score"), [F.desc_nulls_last("score"), F.asc("symbol")], 25)


@query(f"WITH {_SCORES} SELECT class_id, symbol, CAST(rank() OVER (PARTITION BY class_id ORDER BY score) AS BIGINT) AS place, count(*) OVER (PARTITION BY class_id, score) AS ties FROM fx_scores WHERE score IS NOT NULL")
def ord_13_competition_rank(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("class_id")
    return view(spark, sf_dir, "fx_scores").where("score is not null").select("class_id", "symbol", F.rank().over(w.orderBy("score")).cast("long").alias("place"), F.count("*").over(Window.partitionBy("class_id", "score")).alias("ties"))


@query(f"WITH {_SCORES} SELECT symbol, score FROM fx_scores WHERE score >= (SELECT min(score) FROM (SELECT score FROM fx_scores WHERE score IS NOT NULL ORDER BY score DESC LIMIT 20))")
def ord_14_cohort(spark, sf_dir):
    return report.cohort(view(spark, sf_dir, "fx_scores").select("symbol", "score"), "score", 20)


@query(f"WITH {_SCORES} SELECT CASE WHEN score < 0 THEN CASE WHEN quadrant = 'hot' THEN 'load_bearing' ELSE 'underused' END WHEN score > 0 THEN 'bypass_candidate' ELSE quadrant END AS quadrant, count(*) AS n FROM fx_scores GROUP BY 1")
def rep_09_quadrants(spark, sf_dir):
    q = report.quadrant_by_sign(F.col("quadrant"), F.col("score"))
    return view(spark, sf_dir, "fx_scores").groupBy(q.alias("quadrant")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- replay

_PRS = ctes("fx_prs")
_BASE = ctes("base_nodes", "fx_files")


@query(f"WITH {_BASE}, t AS (SELECT file, max({_LOG.format(c='branches')}) AS l FROM base_nodes GROUP BY file), f AS (SELECT change, CASE WHEN status IN ('added', 'copied') THEN NULL WHEN status = 'renamed' THEN previous_path ELSE path END AS p FROM fx_files WHERE scorable) "
       "SELECT change, round(max(l), 6) AS max_log2 FROM f LEFT JOIN t ON t.file = split_part(p, '/', 2) GROUP BY change")
def agg_10_largest_touched(spark, sf_dir):
    from ..operators.universe import base_paths

    files = base_paths(view(spark, sf_dir, "fx_files")).select("change", F.split_part("base_path", F.lit("/"), F.lit(2)).alias("file"))
    return replay.largest_touched(files, view(spark, sf_dir, "base_nodes"))


@query(f"WITH {_PRS} SELECT pr AS change, max_log2 AS found, CASE WHEN pr % 7 = 0 THEN max_log2 + 0.01 ELSE max_log2 END AS stored, pr % 7 <> 0 AS agrees FROM fx_prs")
def bt_0_stored_values(spark, sf_dir):
    prs = view(spark, sf_dir, "fx_prs").select(F.col("pr").alias("change"), "max_log2")
    stored = prs.withColumn("max_log2", F.when(F.col("change") % 7 == 0, F.col("max_log2") + 0.01).otherwise(F.col("max_log2")))
    return replay.agrees(prs, stored)


@query(f"WITH {_PRS}, r(rule) AS (VALUES ('large'), ('urgent'), ('never')), x AS (SELECT rule, latency, CASE rule WHEN 'large' THEN max_log2 > 5 WHEN 'urgent' THEN arm LIKE '1%' ELSE false END AS fired FROM fx_prs CROSS JOIN r) SELECT rule, fired, count(*) AS n, round(median(latency), 6) AS med FROM x GROUP BY rule, fired")
def bt_2_association(spark, sf_dir):
    prs = view(spark, sf_dir, "fx_prs").withColumnRenamed("pr", "change")
    fired = prs.where("max_log2 > 5").select("change", F.lit("large").alias("rule")).unionByName(prs.where(F.startswith("arm", F.lit("1"))).select("change", F.lit("urgent").alias("rule")))
    return replay.association(prs, fired, ["large", "urgent", "never"])


@query("WITH c AS (SELECT o_custkey % 50 AS repo, o_orderdate AS moment, o_orderkey AS change, CAST((o_orderkey % 7) - 3 AS DOUBLE) AS delta FROM orders), n AS (SELECT repo, round(sum(delta) OVER (PARTITION BY repo ORDER BY moment, change ROWS UNBOUNDED PRECEDING), 3) AS net FROM c), "
       "b(budget) AS (VALUES (0.0::DOUBLE), (5.0::DOUBLE)) SELECT repo, budget, count(*) FILTER (net > budget) AS n_breached, count(*) AS n FROM n CROSS JOIN b GROUP BY repo, budget")
def bt_3_ratchet_replay(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select((F.col("o_custkey") % 50).alias("repo"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("change"), ((F.col("o_orderkey") % 7) - 3).cast("double").alias("delta"))
    return replay.ratchet_replay(rows, [0.0, 5.0])


@query(f"WITH {_SCORES} SELECT 'poles' AS gate, bool_and(abs(score) <= 5) AS passed FROM fx_scores UNION ALL SELECT 'zero share', count(*) FILTER (score = 0) / count(score) > 0.5 FROM fx_scores")
def bt_4_gates(spark, sf_dir):
    s = view(spark, sf_dir, "fx_scores")
    return replay.gates([("poles", s.agg(F.bool_and(F.abs("score") <= 5).alias("passed"))), ("zero share", s.agg((F.try_divide(F.count_if(F.col("score") == 0), F.count("score")) > 0.5).alias("passed")))])
