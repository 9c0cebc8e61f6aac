"""Queries over scores, attached findings, carried columns and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import band, round6
from ..operators import details, report, rules
from ..sources.views import ctes, view
from .registry import query

_N = ctes("pc_nodes")
_KEY = "CAST(substr(symbol, 2) AS BIGINT)"


def _pc(spark, sf_dir):
    return view(spark, sf_dir, "pc_nodes").withColumn("k", F.substring("symbol", 2, 20).cast("long"))


@query(f"WITH {_N}, i AS (SELECT *, {_KEY} % 16 AS blast, {_KEY} % 6 = 0 AND NOT escapes AS booth, {_KEY} % 130 AS ms, branches / greatest(coalesce(outcome_arity, 1), 1) AS col FROM pc_nodes), "
       "g AS (SELECT *, greatest(0.0, (CASE WHEN col > 0 THEN greatest(0.0, log2(col)) ELSE 0.0 END) - 1.0) AS own FROM i), "
       "n AS (SELECT *, (CASE WHEN escapes THEN greatest(own, 1.0) ELSE own END) * (1 + log2(1.0 + blast) / 4.0) AS n, CASE WHEN booth THEN log2(1.0 + ms) ELSE 0.0 END AS p FROM g), "
       "s AS (SELECT symbol, CASE WHEN n > 0 THEN -5 * (1 - exp(-n / 8.0)) WHEN p > 0 THEN 5 * (1 - exp(-p / 3.0)) ELSE 0.0 END AS score, CASE WHEN n > 0 THEN -n WHEN p > 0 THEN p ELSE 0.0 END AS raw FROM n) "
       "SELECT symbol, round(CAST(score AS DOUBLE), 6) AS score, CAST(greatest(-5, least(5, sign(score) * floor(abs(score) + 0.5))) AS INT) AS score_band, round(CAST(raw AS DOUBLE), 3) AS score_raw FROM s")
def gra_25_reusability(spark, sf_dir):
    rows = _pc(spark, sf_dir).withColumns({"blast": F.col("k") % 16, "toll_booth": (F.col("k") % 6 == 0) & ~F.col("escapes"), "mass_savings": F.col("k") % 130})
    return details.reusability(rows).select("symbol", round6(F.col("score")).alias("score"), "score_band", "score_raw")


def _found(spark, sf_dir):
    k = F.col("k")
    ids = F.array(*(F.concat(F.lit("P"), (k + j).cast("string")) for j in (1, 2)))
    return _pc(spark, sf_dir).where(k % 3 != 0).select(F.when(k % 3 == 1, F.col("symbol")).alias("node"), F.when(k % 3 == 2, ids).alias("path"))


@query(f"WITH {_N}, f AS (SELECT CASE WHEN {_KEY} % 3 = 1 THEN symbol ELSE 'P' || CAST({_KEY} + 1 AS VARCHAR) END AS id FROM pc_nodes WHERE {_KEY} % 3 <> 0) SELECT n.symbol AS id, count(f.id) AS findings FROM pc_nodes n LEFT JOIN f ON f.id = n.symbol GROUP BY n.symbol")
def join_03_attached_findings(spark, sf_dir):
    return details.attached(_found(spark, sf_dir), _pc(spark, sf_dir).select(F.col("symbol").alias("id")))


@query(f"WITH {_N} SELECT file, symbol, branches AS value FROM pc_nodes WHERE {_KEY} % 23 <> 0")
def join_06_named_rows(spark, sf_dir):
    n = _pc(spark, sf_dir).withColumn("id", F.sha2("symbol", 256))
    ids = n.select("id", F.when(F.col("k") % 23 != 0, F.col("file")).alias("file"), "symbol")
    return details.named_rows(n.select("id", F.col("branches").alias("value")), ids)


@query(f"WITH {_N} SELECT symbol, CASE WHEN {_KEY} % 4 = 0 THEN NULL WHEN {_KEY} % 4 = 1 THEN 7 ELSE branches END AS branches FROM pc_nodes")
def join_08_carried(spark, sf_dir):
    n = _pc(spark, sf_dir)
    value = F.when(F.col("k") % 4 == 1, F.lit(7).cast("long"))
    keys = F.when(F.col("k") % 4 <= 1, F.array(F.lit("branches"))).otherwise(F.array().cast("array<string>"))
    before = n.where(F.col("k") % 5 != 9).select("symbol", value.alias("branches"), keys.alias("keys_present"))
    return details.carried(n.select("symbol", "branches"), before, "symbol", ["branches"])


@query(f"WITH {ctes('pc_nodes', 'pc_edges', 'fx_scores')}, t AS (SELECT symbol FROM fx_scores ORDER BY score DESC NULLS LAST, symbol LIMIT 60) SELECT e.* FROM pc_edges e WHERE \"from\" IN (SELECT symbol FROM t) AND \"to\" IN (SELECT symbol FROM t)")
def ord_09_capped_graph(spark, sf_dir):
    return details.capped_graph(view(spark, sf_dir, "fx_scores").select("symbol", "score"), view(spark, sf_dir, "pc_edges"), 60).select("from", "to", "calls")


@query("SELECT o_custkey % 9 AS repo, o_orderkey AS number, row_number() OVER (ORDER BY o_custkey % 9, o_orderkey) AS nth FROM orders QUALIFY nth <= 40")
def ord_12_ordered_changes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 9).alias("repo"), F.col("o_orderkey").alias("number"))
    return details.ordered_changes(o, 40)


def _hashes(spark, sf_dir):
    n = _pc(spark, sf_dir)
    now = n.select(F.col("symbol").alias("file"), F.concat_ws("/", "file", F.col("branches").cast("string")).alias("content"), "k")
    old = now.where("k % 8 <> 0").withColumn("content", F.when(F.col("k") % 8 == 1, F.lit("old")).otherwise(F.col("content")))
    return now, old.select("file", F.sha2(F.concat_ws(":", F.lit("6"), "content"), 256).alias("hash"))


@query(f"WITH {_N} SELECT symbol AS file FROM pc_nodes WHERE {_KEY} % 8 <= 1")
def inc_01_stale_files(spark, sf_dir):
    now, old = _hashes(spark, sf_dir)
    return details.stale_files(now, old, F.lit("6"))


@query("SELECT false AS fresh")
def inc_03_freshness(spark, sf_dir):
    now, old = _hashes(spark, sf_dir)
    return details.is_fresh(now.select("file", F.sha2(F.concat_ws(":", F.lit("6"), "content"), 256).alias("hash")), old)


@query(f"WITH {_N} SELECT symbol, {_KEY} % 2 = 0 AS fresh FROM pc_nodes")
def rul_36_fresh_stamp(spark, sf_dir):
    n = _pc(spark, sf_dir)
    stamp = F.round(F.col("branches") / F.greatest(F.coalesce("outcome_arity", F.lit(1)), F.lit(1)), 2) + F.when(F.col("k") % 2 == 0, 0.0).otherwise(0.5)
    return n.select("symbol", rules.fresh(stamp, F.col("branches"), F.col("outcome_arity")).alias("fresh"))


@query(f"WITH {ctes('fx_scores')}, b AS (SELECT class_id, CAST(greatest(-5, least(5, sign(score) * floor(abs(score) + 0.5))) AS INT) AS band FROM fx_scores WHERE score IS NOT NULL) SELECT sum(CASE WHEN band <= -3 THEN 1 ELSE 0 END)::BIGINT AS low, sum(CASE WHEN band >= 3 THEN 1 ELSE 0 END)::BIGINT AS high, count(*) AS scored, "
       "(SELECT class_id FROM fx_scores GROUP BY class_id HAVING min(score) <= -1 ORDER BY min(score), class_id LIMIT 1) AS worst_class FROM b")
def rep_04_band_sums(spark, sf_dir):
    s = view(spark, sf_dir, "fx_scores")
    worst = s.groupBy("class_id").agg(F.min("score").alias("m")).where("m <= -1").agg(F.min(F.struct("m", "class_id")).alias("w"))
    sums = s.where("score is not null").withColumn("band", band(F.col("score"))).agg(F.count_if(F.col("band") <= -3).alias("low"), F.count_if(F.col("band") >= 3).alias("high"), F.count("*").alias("scored"))
    return sums.crossJoin(worst).select("low", "high", "scored", F.col("w.class_id").alias("worst_class"))  # one row each


@query(f"WITH {ctes('fx_scores')}, c AS (SELECT class_id, count(*) FILTER (score >= 4) / count(*) AS share, median(branches) FILTER (score >= 4) AS med FROM fx_scores GROUP BY class_id) SELECT class_id, round(share, 6) AS share, CASE WHEN share >= 0.1 THEN round(med, 6) END AS at_cap FROM c")
def rep_02_capped_share(spark, sf_dir):
    return report.capped_share(view(spark, sf_dir, "fx_scores"), "class_id", F.col("score") >= 4, "branches", 0.1)
