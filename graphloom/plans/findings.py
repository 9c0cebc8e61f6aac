"""Queries over findings, hotspots, routes, classes and cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round6
from ..operators import findings, report, universe
from ..sources.views import ctes, view
from .details import _hashes
from .registry import query

_N = ctes("pc_nodes")
_KEY = "CAST(substr(symbol, 2) AS BIGINT)"


def _pc(spark, sf_dir):
    return view(spark, sf_dir, "pc_nodes").withColumn("k", F.substring("symbol", 2, 20).cast("long"))


_DIMENSION = "CASE WHEN l_orderkey % 2 = 0 THEN 'reverse_traceability' ELSE 'forward_discoverability' END"


@query(f"WITH {ctes('pc_edges')}, i AS (SELECT \"to\" AS id, count(*) AS fan_in FROM pc_edges GROUP BY 1), o AS (SELECT \"from\" AS id, count(*) AS fan_out FROM pc_edges GROUP BY 1), "
       f"l AS (SELECT l_orderkey AS list, {_DIMENSION} AS dimension, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, 'P' || l_partkey AS id FROM lineitem) "
       "SELECT list, dimension, pos, l.id, CASE WHEN dimension LIKE 'rev%' THEN fan_in END AS fan_in, CASE WHEN dimension LIKE 'for%' THEN fan_out END AS fan_out FROM l LEFT JOIN i ON i.id = l.id LEFT JOIN o ON o.id = l.id")
def join_05_hotspot_metrics(spark, sf_dir):
    e = view(spark, sf_dir, "pc_edges")
    fan_in, fan_out = (e.groupBy(F.col(c).alias("id")).agg(F.count("*").alias(n)) for c, n in (("to", "fan_in"), ("from", "fan_out")))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("s"))
    ids = F.transform("s.l_partkey", lambda p: F.concat(F.lit("P"), p.cast("string")))
    return findings.hotspots(lines.select(F.col("l_orderkey").alias("list"), F.expr(_DIMENSION).alias("dimension"), ids.alias("ids")), fan_in.join(fan_out, "id", "full"))


@query(f"WITH {ctes('pc_nodes', 'pc_edges', 'pc_ext_edges')}, ids AS (SELECT sha256(symbol) AS id, file || '/' || symbol AS name FROM pc_nodes WHERE {_KEY} % 19 <> 0), e AS (SELECT sha256(\"from\") AS a, sha256(\"to\") AS b, calls FROM pc_ext_edges) "
       "SELECT coalesce(x.name, '<unresolved:' || a || '>') AS from_label, coalesce(y.name, '<unresolved:' || b || '>') AS to_label, calls FROM e LEFT JOIN ids x ON x.id = a LEFT JOIN ids y ON y.id = b")
def join_07_named_edges(spark, sf_dir):
    ids = _pc(spark, sf_dir).where("k % 19 <> 0").select(F.sha2("symbol", 256).alias("id"), F.concat_ws("/", "file", "symbol").alias("name"))
    e = view(spark, sf_dir, "pc_ext_edges").select(F.sha2("from", 256).alias("from"), F.sha2("to", 256).alias("to"), "calls")
    return report.labelled_edges(e, ids)


@query(f"WITH {ctes('base_nodes', 'fx_files')}, t AS (SELECT file, count(*) AS n FROM base_nodes WHERE branches >= 1 GROUP BY file), "
       "f AS (SELECT DISTINCT change, split_part(CASE WHEN status IN ('added', 'copied') THEN NULL WHEN status = 'renamed' THEN previous_path ELSE path END, '/', 2) AS file FROM fx_files WHERE scorable) "
       "SELECT change, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_nodes FROM f JOIN t USING (file) GROUP BY change")
def join_18_touched_nodes(spark, sf_dir):
    files = universe.base_paths(view(spark, sf_dir, "fx_files")).select("change", F.split_part("base_path", F.lit("/"), F.lit(2)).alias("file"))
    return findings.touched_nodes(files, view(spark, sf_dir, "base_nodes"))


@query(f"WITH {ctes('fx_prs')}, k AS (SELECT *, pr % 4 + 1 AS quartile FROM fx_prs WHERE pr % 3 <> 0) SELECT count(*) AS n, count(*) FILTER (max_log2 > 5) AS n_flagged, "
       "round(median(latency) FILTER (max_log2 > 5), 6) AS flagged_median, round(median(latency) FILTER (quartile = 1), 6) AS q1_median FROM k")
def join_19_cohort_medians(spark, sf_dir):
    prs = view(spark, sf_dir, "fx_prs").withColumnRenamed("pr", "change")
    table = prs.select("change", (F.col("change") % 3 != 0).alias("kept"), (F.col("change") % 4 + 1).alias("quartile"))
    return findings.cohort_medians(prs, table, 5.0).withColumns({c: round6(F.col(c)) for c in ("flagged_median", "q1_median")})


_ACTION = "CASE {c} % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'show' ELSE 'edit' END"


@query(f"SELECT DISTINCT 'Shop::Item' || l_partkey % 700 || 'List' || 'Controller#' || {_ACTION.format(c='l_suppkey')} AS symbol FROM lineitem WHERE l_linenumber <> 7 "
       f"INTERSECT SELECT 'Shop::Item' || p_partkey % 700 || 'List' || 'Controller#' || {_ACTION.format(c='p_size')} FROM part")
def join_21_routed_actions(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    path = F.concat(F.lit("item"), F.lit("_"), (F.col("l_partkey") % 700).cast("string"), F.lit("_list"))
    to = F.when(F.col("l_linenumber") != 7, F.concat(path, F.lit("#"), F.expr(_ACTION.format(c="l_suppkey")))).otherwise(path)  # without an action
    routes = l.select(to.alias("to"), F.array(F.lit("shop")).alias("modules"))
    name = F.concat(F.lit("Shop::Item"), (F.col("p_partkey") % 700).cast("string"), F.lit("ListController#"), F.expr(_ACTION.format(c="p_size")))
    return findings.routed_actions(routes, spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("symbol")))


@query(f"WITH {ctes('fx_scores')} SELECT 'cls_' || substr(sha256(class_id || '|' || quadrant), 1, 16) AS class_id, class_id AS file, quadrant AS class_symbol, first(branches ORDER BY p_partkey) AS line, count(*) AS members FROM fx_scores GROUP BY class_id, quadrant")
def join_22_class_ids(spark, sf_dir):
    n = view(spark, sf_dir, "fx_scores").select(F.col("class_id").alias("file"), F.col("quadrant").alias("class_symbol"), F.col("branches").alias("line"), "p_partkey")
    return findings.class_ids(n, ["p_partkey"])


@query(f"WITH {ctes('fx_scores')}, x AS (SELECT symbol, CASE WHEN score IS NULL THEN NULL ELSE (p_partkey % 40) / 10.0::DOUBLE END AS v, branches / 2.0::DOUBLE AS m, (p_partkey % 3) * 0.04::DOUBLE AS off FROM fx_scores) "
       "SELECT symbol, CASE WHEN v IS NULL THEN '' WHEN abs(v + m + off - (v + m)) <= 0.05 THEN format(' = variety {:.1f} + mass {:.1f}', v, m) ELSE format(', variety {:.1f}, mass {:.1f}', v, m) END AS equation FROM x")
def rep_03_equation(spark, sf_dir):
    k, v, m = F.col("p_partkey"), F.col("v"), F.col("m")
    rows = view(spark, sf_dir, "fx_scores").select("symbol", "p_partkey", F.when(F.col("score").isNotNull(), (k % 40) / 10.0).alias("v"), (F.col("branches") / 2.0).alias("m"))
    return rows.select("symbol", findings.equation(v + m + (k % 3) * 0.04, v, m).alias("equation"))


@query(f"WITH {_N} SELECT symbol AS id, CASE WHEN {_KEY} % 23 = 0 THEN '<unresolved:' || symbol || '>' ELSE file || '/' || symbol END AS location, branches AS clutter_score FROM pc_nodes WHERE branches >= 30")
def rep_06_bottlenecks(spark, sf_dir):
    n = _pc(spark, sf_dir)
    names = n.where("k % 23 <> 0").select(F.col("symbol").alias("id"), F.concat_ws("/", "file", "symbol").alias("name"))
    return findings.bottlenecks(n.where("branches >= 30").select("symbol", F.col("branches").alias("added_coupling")), names)


_TYPES = (*findings.EXPLANATIONS, "odd")
_KIND = "CASE k % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"
_LINES = ", ".join("('" + "', '".join((k, *v)) + "')" for k, v in findings.EXPLANATIONS.items())


@query(f"WITH {_N}, t(type, title, axis, summary) AS (VALUES {_LINES}), f AS (SELECT symbol, {_KIND} AS type, k FROM (SELECT symbol, {_KEY} AS k FROM pc_nodes)) "
       "SELECT symbol, CASE WHEN title IS NULL THEN f.type || ': (no explanation registered)' ELSE title || ' — ' || summary || CASE WHEN k % 8 IN (5, 6) THEN ' (' || (k % 4 + 2) || '-node chain)' ELSE '' END || ' [' || axis || ']' END AS line FROM f LEFT JOIN t ON t.type = f.type")
def rep_07_explanations(spark, sf_dir):
    path = F.when((F.col("k") % 8).isin(5, 6), F.array_repeat("symbol", (F.col("k") % 4 + 2).cast("int")))
    return findings.explained(_pc(spark, sf_dir).select("symbol", F.expr(_KIND).alias("type"), path.alias("path"))).select("symbol", "line")


@query(f"WITH {_N}, f AS (SELECT *, {_KEY} AS k FROM pc_nodes) SELECT 'Rule' || k % 4 AS check_name, symbol || ' has ' || branches AS description, sha256(symbol) AS fingerprint, CASE k % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' ELSE 'info' END AS severity, "
       "CASE k % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level, CASE WHEN k % 7 = 0 THEN '.' ELSE file END AS path, CASE WHEN k % 5 = 0 THEN 1 ELSE branches END AS \"begin\" FROM f")
def rep_08_exchange(spark, sf_dir):
    k = F.col("k")
    found = _pc(spark, sf_dir).select(
        F.concat(F.lit("Rule"), (k % 4).cast("string")).alias("rule"), F.concat_ws(" has ", "symbol", F.col("branches").cast("string")).alias("message"), F.sha2("symbol", 256).alias("fingerprint"),
        F.expr("CASE k % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' ELSE 'info' END").alias("severity"), F.when(k % 7 != 0, F.col("file")).alias("file"), F.when(k % 5 != 0, F.col("branches")).alias("line"),
    )
    return findings.exchanged(found)


@query(f"WITH {ctes('base_nodes', 'head_nodes')} SELECT 'base' AS vintage, symbol, CAST(NULL AS BIGINT) AS outcome_arity FROM base_nodes WHERE branches >= 32 UNION ALL SELECT 'head', symbol, outcome_arity FROM head_nodes WHERE branches >= 32")
def rul_34_enriched(spark, sf_dir):
    base = view(spark, sf_dir, "base_nodes").withColumns({"vintage": F.lit("base"), "escapes": F.lit(None).cast("boolean")})
    nodes = base.unionByName(view(spark, sf_dir, "head_nodes").withColumn("vintage", F.lit("head")))
    nodes = nodes.withColumn("outcome_arity", F.col("outcome_arity").cast("long"))
    return findings.enriched(nodes.where("branches >= 32").select("vintage", "file", "symbol"), nodes, ["outcome_arity"]).drop("file")


@query(f"WITH {_N} SELECT symbol AS file, sha256('6:' || file || '/' || branches) AS hash FROM pc_nodes")
def snk_10_manifest(spark, sf_dir):
    return findings.manifest(_hashes(spark, sf_dir)[0], F.lit("6"))
