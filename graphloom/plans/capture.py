"""Queries over captured facts: type bindings, probes, routes, seeders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capture, resolve
from ..sources.views import ctes, view
from .registry import query

# ---------------------------------------------------------------- type bindings: the oracle folds write by write

_FOLD = (
    f"WITH RECURSIVE {ctes('cp_writes')}, st(scope, name, pos, fq) AS (SELECT scope, name, pos, fq FROM cp_writes WHERE pos = 1 UNION ALL "
    "SELECT w.scope, w.name, w.pos, CASE WHEN w.fq IS NULL THEN NULL WHEN st.fq IS NULL OR st.fq = w.fq THEN w.fq END FROM st JOIN cp_writes w ON w.scope = st.scope AND w.name = st.name AND w.pos = st.pos + 1) "
)


@query(_FOLD + "SELECT scope, name, pos, fq FROM st")
def cap_13_bindings(spark, sf_dir):
    return capture.bindings(view(spark, sf_dir, "cp_writes"))


@query(_FOLD + "SELECT w.scope || w.name || ':' || w.pos AS site_id, st.fq FROM cp_writes w LEFT JOIN st ON st.scope = w.scope AND st.name = w.name AND st.pos = w.pos - 1 WHERE w.pos % 3 <> 2")
def cap_13_types_at(spark, sf_dir):
    w = view(spark, sf_dir, "cp_writes")
    reads = w.where("pos % 3 <> 2").select(F.concat("scope", "name", F.lit(":"), F.col("pos").cast("string")).alias("site_id"), "scope", "name", "pos")
    return capture.types_at(reads, capture.bindings(w)).select("site_id", "fq")


@query(_FOLD + ", r AS (SELECT w.scope || ':' || w.pos AS site_id, w.name, st.fq FROM cp_writes w LEFT JOIN st ON st.scope = w.scope AND st.name = w.name AND st.pos = w.pos - 1 WHERE w.pos % 3 <> 2) "
       "SELECT site_id, first(fq ORDER BY name) AS fq FROM r WHERE fq IS NOT NULL GROUP BY site_id")
def cap_13_receivers(spark, sf_dir):
    """v0 stands for local variables, v1 for instance variables, v2 for accessors of one place."""
    w = view(spark, sf_dir, "cp_writes")
    reads = w.where("pos % 3 <> 2").select(F.concat_ws(":", "scope", F.col("pos").cast("string")).alias("site_id"), "scope", "name", "pos")
    known = capture.types_at(reads, capture.bindings(w))
    return capture.receivers(*(known.where(F.col("name") == n).select("site_id", "fq") for n in ("v0", "v1", "v2")))


# ---------------------------------------------------------------- probes

_FACTS = ctes("cp_sites", "cp_classes", "cp_methods")
_PROBES = (
    f"WITH {_FACTS}, verbs(rank, verb) AS (VALUES (0, 'GET'), (1, 'POST'), (2, 'PUT'), (3, 'PATCH'), (4, 'DELETE')), "
    "grape AS (SELECT s.site_id, min_by(m.fq, v.rank) AS target FROM cp_sites s JOIN cp_classes c ON c.fq_name = s.mounted AND c.api CROSS JOIN verbs v JOIN cp_methods m ON m.fq = s.mounted || '#' || v.verb || '[0]' WHERE s.name = 'mount' GROUP BY s.site_id), "
    "dispatch AS (SELECT DISTINCT s.site_id, m.fq AS target FROM cp_sites s JOIN cp_methods m ON m.fq = s.constant || '#perform' WHERE s.name IN ('perform_async', 'perform_later')), "
    "sent AS (SELECT s.site_id, min(m.fq) AS target FROM cp_sites s JOIN cp_methods m ON m.fq IN (coalesce(constant, typed, enclosing) || '#' || literal, coalesce(constant, typed, enclosing) || '.' || literal) WHERE s.name = 'send' GROUP BY s.site_id), "
    "out AS (SELECT site_id, CASE WHEN constant = 'Faraday' AND name = 'get' THEN 'http' WHEN name IN ('perform_async', 'perform_later') THEN 'queue' ELSE 'gem' END AS category, constant AS target FROM cp_sites WHERE constant NOT IN (SELECT fq_name FROM cp_classes)), "
    "answers AS (SELECT s.site_id, coalesce(g.target, d.target, t.target, '<external:' || o.category || ':' || o.target || '>') AS target, "
    "CASE WHEN g.target IS NOT NULL THEN 'grape' WHEN d.target IS NOT NULL THEN 'sidekiq_dispatch' WHEN t.target IS NOT NULL THEN 'meta_send' WHEN o.target IS NOT NULL THEN 'egress' END AS provenance "
    "FROM cp_sites s LEFT JOIN grape g USING (site_id) LEFT JOIN dispatch d USING (site_id) LEFT JOIN sent t USING (site_id) LEFT JOIN out o USING (site_id)) "
)


def _facts(spark, sf_dir) -> capture.Facts:
    return capture.Facts(*(view(spark, sf_dir, v) for v in ("cp_sites", "cp_classes", "cp_methods")))


@query(_PROBES + "SELECT site_id, target FROM grape")
def cap_08_mounted_api(spark, sf_dir):
    return capture.mounted_api(_facts(spark, sf_dir))


@query(_PROBES + "SELECT site_id, target FROM dispatch")
def cap_09_dispatched_job(spark, sf_dir):
    return capture.dispatched_job(_facts(spark, sf_dir))


@query(_PROBES + "SELECT site_id, target FROM sent")
def cap_10_literal_send(spark, sf_dir):
    return capture.literal_send(_facts(spark, sf_dir))


@query(_PROBES + "SELECT site_id, category, target FROM out")
def cap_11_egress(spark, sf_dir):
    return capture.egress(_facts(spark, sf_dir))


@query(_PROBES + "SELECT site_id, target, provenance FROM answers")
def cap_12_probes(spark, sf_dir):
    return capture.probe(_facts(spark, sf_dir))


@query(_PROBES + "SELECT provenance, count(*) AS n FROM answers GROUP BY provenance UNION ALL SELECT 'never', 0")
def cap_12_probe_counts(spark, sf_dir):
    found = capture.probe(_facts(spark, sf_dir))
    tally = resolve.closed_tally(found.where("provenance is not null"), "provenance", ["grape", "sidekiq_dispatch", "meta_send", "egress", "never"])
    return tally.unionByName(found.where("provenance is null").groupBy("provenance").agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- routes and roots

_CAMEL = "array_to_string(list_transform(string_split({c}, '_'), lambda x: upper(x[1]) || lower(x[2:])), '')"


@query(f"WITH {ctes('rt_statements', 'rt_methods')}, around AS (SELECT r.file, r.opened, count(*) FILTER (n.opened IS NOT NULL AND n.name IS NULL) AS lost, coalesce(string_agg({_CAMEL.format(c='n.name')} || '::', '' ORDER BY n.opened), '') AS path "
       "FROM rt_statements r LEFT JOIN rt_statements n ON n.file = r.file AND n.kind = 'namespace' AND n.opened < r.opened AND n.closed > r.opened WHERE r.kind <> 'namespace' GROUP BY r.file, r.opened), "
       "every(a) AS (VALUES ('index'), ('show'), ('new'), ('create'), ('edit'), ('update'), ('destroy')), "
       "seeds AS (SELECT file, opened, split_part(target, '#', 1) AS name, split_part(target, '#', 2) AS action FROM rt_statements WHERE kind = 'to' AND split_part(target, '#', 2) <> '' UNION ALL "
       "SELECT file, opened, name, a FROM rt_statements CROSS JOIN every WHERE kind IN ('resources', 'resource') AND NOT (kind = 'resource' AND a = 'index') "
       "AND CASE WHEN only_list IS NOT NULL THEN list_contains(string_split(only_list, ','), a) WHEN except_list IS NOT NULL THEN NOT list_contains(string_split(except_list, ','), a) ELSE true END), "
       f"c AS (SELECT path || array_to_string(list_transform(string_split(name, '/'), lambda y: {_CAMEL.format(c='y')}), '::') || 'Controller' AS controller, action FROM seeds JOIN around USING (file, opened) WHERE lost = 0) "
       "SELECT DISTINCT controller, action FROM c WHERE controller || '#' || action IN (SELECT fq FROM rt_methods)")
def cap_20_routes(spark, sf_dir):
    s = view(spark, sf_dir, "rt_statements")
    given = s.select("file", F.col("opened").alias("open"), F.col("closed").alias("close"), "kind", "name", F.col("target").alias("to"), F.split("only_list", ",").alias("only"), F.split("except_list", ",").alias("except"))
    return capture.routes(given, view(spark, sf_dir, "rt_methods"))


_ROOTS = (
    f"WITH RECURSIVE {ctes('cp_classes', 'cp_methods', 'cp_schedule')}, down(fq_name) AS (SELECT fq_name FROM cp_classes WHERE p_partkey % 17 = 0 OR superclass = 'ApplicationJob' UNION SELECT c.fq_name FROM cp_classes c JOIN down d ON c.superclass = d.fq_name), "
    "jobs AS (SELECT DISTINCT fq FROM cp_methods WHERE fq IN (SELECT fq_name || '#perform' FROM down)), "
    "wares AS (SELECT DISTINCT fq FROM cp_methods WHERE fq IN (SELECT fq_name || '#call' FROM cp_classes WHERE p_partkey % 2 = 0 AND p_partkey % 9 = 0 AND p_partkey % 5 < 3)), "
    "marked AS (SELECT fq, 'jobs' AS category FROM jobs UNION ALL SELECT fq, 'middleware' FROM wares WHERE fq NOT IN (SELECT fq FROM jobs)) "
)


def _evidence(spark, sf_dir) -> capture.Evidence:
    c = view(spark, sf_dir, "cp_classes")
    mixins = c.select("fq_name", F.when(F.col("p_partkey") % 17 == 0, "Sidekiq::Job").otherwise("Comparable").alias("module"))
    some = lambda condition: c.where(condition).select("fq_name")
    return capture.Evidence(
        c, mixins, view(spark, sf_dir, "cp_methods"), some("p_partkey % 2 = 0"), some("p_partkey % 9 = 0"), some("p_partkey % 5 < 3").withColumnRenamed("fq_name", "name"), view(spark, sf_dir, "cp_schedule")
    )


@query(_ROOTS + "SELECT fq FROM jobs")
def cap_19_job_roots(spark, sf_dir):
    return capture.job_roots(_evidence(spark, sf_dir))


@query(_ROOTS + "SELECT fq FROM wares")
def cap_19_middleware_roots(spark, sf_dir):
    return capture.middleware_roots(_evidence(spark, sf_dir))


@query(_ROOTS + "SELECT fq, category FROM marked")
def cap_17_seeded(spark, sf_dir):
    return capture.seeded(_evidence(spark, sf_dir))


@query(_ROOTS + ", tasks AS (SELECT 'rake:task' || p_partkey || '[' || k || ']' AS fq, p_partkey FROM cp_classes CROSS JOIN (VALUES (0), (1)) v(k) WHERE p_partkey % 2 = 0), "
       "keys AS (SELECT DISTINCT kind || ':' || target AS entry, CASE WHEN kind = 'class' THEN target || '#perform' WHEN kind = 'rake' THEN target WHEN target LIKE '%.perform_now' THEN split_part(target, '.', 1) || '#perform' END AS key FROM cp_schedule) "
       "SELECT k.entry, m.fq FROM keys k LEFT JOIN (SELECT fq, fq AS key FROM marked UNION ALL SELECT fq, 'task' || p_partkey FROM tasks) m ON m.key = k.key")
def cap_19_cron_links(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    task = e.classes.where("p_partkey % 2 = 0").select(F.explode(F.array(*(F.concat(F.lit("rake:task"), F.col("p_partkey").cast("string"), F.lit(f"[{k}]")) for k in (0, 1)))).alias("fq"))
    return capture.cron_links(e, capture.seeded(e).select("fq").unionByName(task))
