"""Vertex, edge and snapshot views over the driver's tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

_ARITY = "1 + p_partkey % 5"
_PART = "'P' || CAST(p_partkey AS STRING)"
_BLOCK = "CAST(floor(({} - 1) / 16) AS BIGINT)"
_MX_FILE = "'M' || CAST(CAST(floor((p_partkey - 1) / 8) AS BIGINT) AS STRING)"
_MX_EP = "p_partkey % 37 = 0 OR p_partkey % 48 = 1"
_MX_KIND = f"CASE WHEN {_MX_EP} THEN 'endpoint' ELSE 'function' END AS kind, CASE WHEN p_partkey % 37 = 0 THEN 'jobs' WHEN p_partkey % 48 = 1 THEN 'routed' END AS entrypoint_kind"
_MX_CALLS = f"""SELECT l_partkey AS a, l_shipdate AS d, l_suppkey % 7 AS k,
          l_partkey + CASE WHEN (l_orderkey * 7 + l_linenumber) % 499 = 0 THEN -1 - l_suppkey % 3 ELSE 1 + l_suppkey % 5 END AS b FROM {{lineitem}}"""
_MX_EDGES = f"""SELECT 'P' || CAST(a AS STRING) AS "from", CASE WHEN {_BLOCK.format('a')} = {_BLOCK.format('b')} THEN 'P' || CAST(b AS STRING) ELSE '<external:s' || CAST(k AS STRING) || '>' END AS "to", count(*) AS calls FROM ({_MX_CALLS}) x"""

VIEWS = {
    "cg_nodes": f"""
        SELECT 'C' || CAST(c_custkey AS STRING) AS symbol, c_mktsegment AS file, CAST(1 AS BIGINT) AS branches, true AS entrypoint, false AS escapes FROM {{customer}}
        UNION ALL SELECT 'O' || CAST(o_orderkey AS STRING), o_orderpriority, CAST(1 AS BIGINT), false, false FROM {{orders}}
        UNION ALL SELECT {_PART}, p_brand, CAST(p_size AS BIGINT), false, p_partkey % 17 = 0 FROM {{part}}""",
    "cg_edges": """
        SELECT 'C' || CAST(o_custkey AS STRING) AS "from", 'O' || CAST(o_orderkey AS STRING) AS "to", CAST(1 AS BIGINT) AS calls FROM {orders}
        UNION ALL SELECT 'O' || CAST(l_orderkey AS STRING), 'P' || CAST(l_partkey AS STRING), count(*) FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "pc_nodes": f"""
        SELECT {_PART} AS symbol, p_brand AS file, CAST(p_size AS BIGINT) AS branches,
          CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE {_ARITY} END AS outcome_arity, p_partkey % 17 = 0 AS escapes,
          p_partkey % 10 = 0 AS entrypoint, 'function' AS kind FROM {{part}}""",
    "pc_edges": """
        SELECT 'P' || CAST(a AS STRING) AS "from", 'P' || CAST(b AS STRING) AS "to", count(*) AS calls FROM (
          SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM {lineitem}
        ) x WHERE b IS NOT NULL GROUP BY a, b""",
    "pc_ext_edges": """
        SELECT "from", "to", calls FROM pc_edges
        UNION ALL SELECT 'P' || CAST(l_partkey AS STRING), '<external:s' || CAST(l_suppkey % 7 AS STRING) || '>', count(*) FROM {lineitem} GROUP BY l_partkey, l_suppkey % 7""",
    "pl_nodes": f"""
        SELECT 'P' || CAST(p_partkey AS STRING) || '#' || CAST(l_linenumber AS STRING) AS symbol, p_brand AS file, CAST(p_size AS BIGINT) AS branches,
          CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE {_ARITY} END AS outcome_arity, p_partkey % 17 = 0 AS escapes,
          p_partkey % 10 = 0 AND l_linenumber = 1 AS entrypoint, CASE WHEN p_partkey % 10 = 0 AND l_linenumber = 1 THEN 'endpoint' ELSE 'function' END AS kind,
          CASE WHEN p_partkey % 10 = 0 AND l_linenumber = 1 THEN CASE WHEN p_partkey % 20 = 0 THEN 'routed' ELSE 'jobs' END END AS entrypoint_kind
        FROM (SELECT DISTINCT l_partkey, l_linenumber FROM {{lineitem}}) l JOIN {{part}} ON p_partkey = l_partkey""",
    "pl_edges": """
        SELECT a AS "from", b AS "to", count(*) AS calls FROM (
          SELECT 'P' || CAST(l_partkey AS STRING) || '#' || CAST(l_linenumber AS STRING) AS a,
            lead('P' || CAST(l_partkey AS STRING) || '#' || CAST(l_linenumber AS STRING)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM {lineitem}
        ) x WHERE b IS NOT NULL GROUP BY a, b""",
    "base_nodes": f"""
        SELECT {_PART} AS symbol, p_brand AS file, CAST(p_size AS BIGINT) AS branches, {_ARITY} AS outcome_arity, p_partkey % 17 = 0 AS escapes,
          p_partkey % 10 = 0 AS entrypoint, 'function' AS kind FROM {{part}} WHERE p_partkey % 50 NOT IN (0, 7)""",
    "base_edges": """
        SELECT 'P' || CAST(a AS STRING) AS "from", 'P' || CAST(b AS STRING) AS "to", count(*) AS calls FROM (
          SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, l_shipdate AS d FROM {lineitem}
        ) x WHERE b IS NOT NULL AND d < TIMESTAMP '2000-01-01' GROUP BY a, b""",
    "head_nodes": f"""
        SELECT {_PART} AS symbol, p_brand AS file, CAST(CASE WHEN p_partkey % 11 = 0 THEN p_size * 2
            WHEN p_partkey % 19 = 0 THEN greatest(1, CAST(floor(p_size / 2) AS INT)) ELSE p_size END AS BIGINT) AS branches,
          {_ARITY} AS outcome_arity, p_partkey % 17 = 0 OR p_partkey % 23 = 0 AS escapes,
          p_partkey % 10 = 0 AS entrypoint, 'function' AS kind FROM {{part}} WHERE p_partkey % 70 NOT IN (0, 13)""",
    "moved_nodes": """
        SELECT symbol, CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 9 = 0 THEN 'Moved#1' ELSE file END AS file, branches, outcome_arity, escapes, entrypoint, kind FROM head_nodes""",
    # whole lineitem again, but parts call parts of their own block of 16: mostly forward, so that components of many sizes, levels, cones that end,
    # unreached files and entrypoints without a caller occur; calls out of a block go to externals
    "mx_nodes": f"""
        SELECT {_PART} AS symbol, {_MX_FILE} AS file, CAST(p_size AS BIGINT) AS branches, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE {_ARITY} END AS outcome_arity,
          p_partkey % 17 = 0 AS escapes, p_partkey % 29 = 0 AS toll_booth, {_MX_EP} AS entrypoint, {_MX_KIND} FROM {{part}}""",
    "mx_edges": f"""
        {_MX_EDGES} GROUP BY 1, 2""",
    "mxb_nodes": f"""
        SELECT {_PART} AS symbol, {_MX_FILE} AS file, CAST(p_size AS BIGINT) AS branches, {_ARITY} AS outcome_arity,
          p_partkey % 17 = 0 AS escapes, p_partkey % 29 = 0 AS toll_booth, {_MX_EP} AS entrypoint, {_MX_KIND} FROM {{part}} WHERE p_partkey % 50 NOT IN (0, 7)""",
    "mxb_edges": f"""
        {_MX_EDGES} WHERE NOT ({_BLOCK.format('a')} % 3 = 0 AND d >= TIMESTAMP '2000-01-01') GROUP BY 1, 2""",
    "mxh_nodes": f"""
        SELECT {_PART} AS symbol, {_MX_FILE} AS file, CAST(CASE WHEN {_BLOCK.format('p_partkey')} % 4 = 0 THEN p_size WHEN p_partkey % 11 = 0 THEN p_size * 2
            WHEN p_partkey % 19 = 0 THEN greatest(1, CAST(floor(p_size / 2) AS INT)) ELSE p_size END AS BIGINT) AS branches,
          {_ARITY} AS outcome_arity, p_partkey % 17 = 0 OR p_partkey % 23 = 0 AS escapes, p_partkey % 29 = 0 OR p_partkey % 41 = 0 AS toll_booth,
          {_MX_EP} AS entrypoint, {_MX_KIND} FROM {{part}} WHERE p_partkey % 70 NOT IN (0, 13) OR {_BLOCK.format('p_partkey')} % 4 = 0""",
    "cp_writes": """
        SELECT 'S' || CAST(k AS STRING) AS scope, 'v' || CAST(v AS STRING) AS name, CASE WHEN l_suppkey % 7 <> 0 THEN 'C' || CAST(l_partkey % 2 AS STRING) END AS fq,
          CAST(row_number() OVER (PARTITION BY k, v ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos
        FROM (SELECT *, CAST(floor(l_orderkey / 8) AS BIGINT) AS k, l_linenumber % 3 AS v FROM {lineitem}) x""",
    "cp_sites": """
        SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) AS site_id,
          CASE l_suppkey % 6 WHEN 0 THEN 'mount' WHEN 1 THEN 'perform_async' WHEN 2 THEN 'send' WHEN 3 THEN 'get' WHEN 4 THEN 'perform_later' ELSE 'run' END AS name,
          CASE WHEN l_partkey % 3 = 0 THEN 'Faraday' WHEN l_partkey % 3 = 1 THEN 'C' || CAST(l_partkey % 50 AS STRING) END AS constant,
          CASE WHEN l_linenumber % 2 = 0 THEN 'C' || CAST(l_partkey % 40 AS STRING) END AS typed, 'C' || CAST(l_orderkey % 60 AS STRING) AS enclosing,
          CASE WHEN l_linenumber <> 3 THEN 'm' || CAST(l_linenumber % 4 AS STRING) END AS literal, 'C' || CAST(l_partkey % 30 AS STRING) AS mounted
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}) l""",
    "cp_classes": """
        SELECT 'C' || CAST(p_partkey AS STRING) AS fq_name, CASE WHEN p_partkey % 10 = 0 THEN 'ApplicationJob' WHEN p_partkey % 3 = 1 THEN 'C' || CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) END AS superclass,
          p_partkey % 4 = 0 AS api, p_partkey FROM {part}""",
    "cp_methods": """
        SELECT 'C' || CAST(p_partkey AS STRING) || CASE p_partkey % 5 WHEN 0 THEN '#perform' WHEN 1 THEN '#GET[0]' WHEN 2 THEN '#POST[0]' WHEN 3 THEN '#m1' ELSE '.m2' END AS fq FROM {part}
        UNION ALL SELECT 'C' || CAST(p_partkey AS STRING) || '#perform' FROM {part} WHERE p_partkey % 2 = 0
        UNION ALL SELECT 'C' || CAST(p_partkey AS STRING) || '#call' FROM {part} WHERE p_partkey % 3 = 0
        UNION ALL SELECT 'C' || CAST(p_partkey AS STRING) || '#DELETE[0]' FROM {part} WHERE p_partkey % 7 = 0""",
    "cp_schedule": """
        SELECT CASE p_partkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'rake' ELSE 'runner' END AS kind,
          CASE p_partkey % 3 WHEN 0 THEN 'C' || CAST(p_partkey * 2 AS STRING) WHEN 1 THEN 'task' || CAST(p_partkey AS STRING) ELSE 'C' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 4 = 1 THEN '.other' ELSE '.perform_now' END END AS target
        FROM {part} WHERE p_partkey % 5 < 2""",
    "rt_statements": """
        SELECT CAST(l_orderkey AS STRING) AS file, CAST(n * 10 AS BIGINT) AS opened, kind, CAST(CASE WHEN kind = 'namespace' THEN CASE WHEN n = 1 THEN 990 WHEN p % 2 = 0 THEN 980 ELSE 45 END ELSE n * 10 + 3 END AS BIGINT) AS closed,
          CASE WHEN kind = 'namespace' THEN CASE WHEN s % 11 <> 0 THEN 'ns_' || CAST(p % 4 AS STRING) END WHEN kind <> 'to' THEN 'item_' || CAST(p % 5 AS STRING) END AS name,
          CASE WHEN kind = 'to' THEN CASE WHEN p % 13 = 0 THEN 'nothing' WHEN p % 13 = 1 THEN 'item_1#' WHEN p % 13 < 5 THEN 'admin/item_' || CAST(p % 5 AS STRING) || '#show' ELSE 'item_' || CAST(p % 5 AS STRING) || '#edit' END END AS target,
          CASE WHEN s % 5 = 0 THEN 'show,index,nothing' END AS only_list, CASE WHEN s % 5 < 2 THEN 'destroy,show' END AS except_list
        FROM (SELECT l_orderkey, n, p, s, CASE WHEN n = 1 AND s % 3 <> 0 OR n = 2 AND s % 2 = 0 THEN 'namespace' WHEN s % 4 = 0 THEN 'resources' WHEN s % 4 = 1 THEN 'resource' ELSE 'to' END AS kind
          FROM (SELECT l_orderkey, l_linenumber AS n, min(l_partkey) AS p, min(l_suppkey) AS s FROM {lineitem} GROUP BY l_orderkey, l_linenumber) y) x""",
    "rt_methods": """
        SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Ns' || CAST(p_partkey % 4 AS STRING) || '::' END || CASE WHEN p_partkey % 7 < 3 THEN 'Ns' || CAST(p_partkey % 11 % 4 AS STRING) || '::' ELSE '' END
          || CASE WHEN p_partkey % 13 = 0 THEN 'Admin::' ELSE '' END || 'Item' || CAST(p_partkey % 5 AS STRING) || 'Controller#'
          || CASE p_partkey % 9 WHEN 0 THEN 'index' WHEN 1 THEN 'show' WHEN 2 THEN 'new' WHEN 3 THEN 'create' WHEN 4 THEN 'edit' WHEN 5 THEN 'update' WHEN 6 THEN 'destroy' ELSE 'show' END AS fq FROM {part}""",
    # a small graph for each order before and after a change: its parts in the order of their lines, now and then a way back
    "sw_parts": """
        SELECT l_orderkey AS pair, l_partkey AS p, min(l_linenumber) AS n FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "sw_base_nodes": f"""
        SELECT pair, p_brand AS file, {_PART} AS symbol, CAST(p_size AS BIGINT) AS branches, {_ARITY} AS outcome_arity, p_partkey % 17 = 0 AS escapes, n IN (1, 4) AS entrypoint, 'function' AS kind
        FROM sw_parts JOIN {{part}} ON p_partkey = p WHERE n <> 3""",
    "sw_head_nodes": f"""
        SELECT pair, p_brand AS file, {_PART} AS symbol, CAST(CASE WHEN (p_partkey + pair) % 11 = 0 THEN p_size * 4 ELSE p_size END AS BIGINT) AS branches, {_ARITY} AS outcome_arity, p_partkey % 17 = 0 AS escapes,
          n IN (1, 4) AS entrypoint, 'function' AS kind FROM sw_parts JOIN {{part}} ON p_partkey = p WHERE n <> 5""",
    "sw_head_edges": """
        SELECT pair, 'P' || CAST(p AS STRING) AS "from", 'P' || CAST(b AS STRING) AS "to", CAST(1 AS BIGINT) AS calls FROM (SELECT pair, p, n, lead(p) OVER (PARTITION BY pair ORDER BY n, p) AS b FROM sw_parts) x WHERE b IS NOT NULL
        UNION ALL SELECT pair, 'P' || CAST(max(p) AS STRING), 'P' || CAST(min(p) AS STRING), CAST(2 AS BIGINT) FROM sw_parts WHERE pair % 7 = 0 GROUP BY pair HAVING max(p) > min(p)""",
    "sw_base_edges": """
        SELECT pair, "from", "to", calls FROM sw_head_edges WHERE pair % 3 <> 0 OR calls > 1 OR CAST(substr("from", 2) AS BIGINT) % 2 = 0""",
    "fx_files": """
        SELECT l_orderkey AS change, 'svc/' || p_brand || '/' || CAST(p_partkey AS STRING) AS path,
          CASE WHEN l_linenumber = 3 THEN 'svc/' || p_brand || '/old' || CAST(p_partkey AS STRING) END AS previous_path,
          CASE l_linenumber WHEN 1 THEN 'added' WHEN 2 THEN 'copied' WHEN 3 THEN 'renamed' ELSE 'modified' END AS status, l_suppkey % 5 <> 0 AS scorable
        FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "fx_calls": """
        SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(l_partkey AS STRING) || ':' || CAST(l_suppkey AS STRING) AS site_id, p_brand AS owner,
          CASE WHEN l_suppkey % 3 = 0 THEN 'P' || CAST(l_partkey AS STRING) ELSE 'm' || CAST(l_partkey % 40 AS STRING) END AS name,
          CASE WHEN l_suppkey % 4 = 0 THEN 'P' || CAST(l_partkey + 1 AS STRING) END AS constant,
          CASE l_suppkey % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'queue' WHEN 2 THEN 'gem' END AS verb
        FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM {lineitem}) l JOIN {part} ON p_partkey = l_partkey""",
    "fx_scores": f"""
        SELECT {_PART} AS symbol, p_partkey, p_brand AS class_id, substr(p_type, 1, 40) AS quadrant, CAST(p_size AS BIGINT) AS branches,
          CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST((p_partkey % 21) - 10 AS DOUBLE) / 2.0 END AS score FROM {{part}}""",
    "fx_prs": """
        SELECT o_orderkey AS pr, o_orderpriority AS arm, o_totalprice / 1000 AS latency, max(log2(CAST(p_size AS DOUBLE))) AS max_log2
        FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} ON p_partkey = l_partkey GROUP BY o_orderkey, o_orderpriority, o_totalprice""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame; ``from`` and ``to`` are quoted for Spark."""
    text = VIEWS[name].replace('"from"', "`from`").replace('"to"', "`to`")
    frames: dict[str, DataFrame] = {}
    for t in re.findall(r"\{(\w+)\}", text):
        frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    for other in VIEWS:
        if other != name and re.search(rf"FROM {other}\b", text):
            text = re.sub(rf"FROM {other}\b", f"FROM {{{other}}}", text)
            frames[other] = view(spark, sf_dir, other)
    return spark.sql(text, **frames)


def ctes(*names: str) -> str:
    """The views as common table expressions for the oracle."""
    return ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in names)
