"""Threshold rules with pinned baselines; each rule is a filter over rounded values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import glob_match, log2_branches, milli, round6

RANK = {"info": 1, "warn": 2, "error": 3}


def exponential_node(nodes: DataFrame, threshold_log2: float = 5.0) -> DataFrame:
    value = round6(log2_branches(F.col("branches")))
    return nodes.select("file", "symbol", value.alias("value")).where(F.col("value") > threshold_log2)


def use_case_complexity(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """ep and the breached metrics in the order of ``thresholds``."""
    parts = [F.when(F.round(F.col(m).cast("double"), 6) > t, F.lit(m)) for m, t in thresholds.items()]
    return metrics.select("ep", F.concat_ws(",", *parts).alias("breached")).where("breached <> ''")


def use_case_dividend(dividends: DataFrame, least: float = 32.0) -> DataFrame:
    return dividends.where(round6(F.col("dividend")) >= least).select("ep", "dividend")


def firewall_breaches(metrics: DataFrame, most: int = 0) -> DataFrame:
    return metrics.where(F.col("escapes_in_cone") > most).select("ep", "escapes_in_cone")


def multiplicative_growth(delta: DataFrame, most: float = 2.0) -> DataFrame:
    return delta.where((F.col("classification") == "GROWN") & (F.col("delta_log2") >= most)).select("file", "symbol", "delta_log2")


def complexity_ratchet(delta: DataFrame, scopes: dict[str, float]) -> DataFrame:
    """scope, net, budget, breached: the signed sum over each scope, at 3 places, strictly above its budget; one scan for all scopes."""
    found = _scoped(delta.where("classification <> 'CHANGED_ATTRS'"), list(scopes)).groupBy("scope").agg(F.round(F.sum("delta_log2"), 3).alias("net"))
    every = delta.sparkSession.createDataFrame([(s, float(b)) for s, b in scopes.items()], "scope string, budget double")
    net = F.coalesce("net", F.lit(0.0))
    return every.join(found, "scope", "left").select("scope", net.alias("net"), "budget", (net > F.col("budget")).alias("breached"))


def entrypoint_ratchet(changes: DataFrame, budgets: dict[str, float]) -> DataFrame:
    """scope, budget, verdict, observed: each matched entrypoint's change of branching, at 3 places, against the budget of its pattern.

    ``changes`` has ep and delta_branching_log2. Strictly above is a breach, anything else a pass. A pattern that matches no entrypoint is one row:
    a breach at 0 if its budget is negative, else no_match. A name itself is tried before its globs.
    """
    hits = F.array_compact(F.array(*(F.when(glob_match(F.col("ep"), [p], path=False), F.struct(F.lit(p).alias("pattern"), F.lit(float(b)).alias("budget"))) for p, b in budgets.items())))
    net = F.round("delta_branching_log2", 3)
    found = changes.select("ep", net.alias("net"), F.explode(hits).alias("h")).select(F.col("ep").alias("scope"), "h.pattern", "h.budget", F.when(F.col("net") > F.col("h.budget"), "breach").otherwise("pass").alias("verdict"), F.col("net").alias("observed"))
    every = changes.sparkSession.createDataFrame([(p, float(b)) for p, b in budgets.items()], "pattern string, budget double")
    none = every.join(found.select("pattern").distinct(), "pattern", "left_anti")
    lost = F.col("budget") < 0
    empty = none.select(F.col("pattern").alias("scope"), "pattern", "budget", F.when(lost, "breach").otherwise("no_match").alias("verdict"), F.when(lost, F.lit(0.0)).alias("observed"))
    return found.unionByName(empty).drop("pattern")


def node_todo(nodes: DataFrame, todo: DataFrame, threshold_log2: float = 5.0) -> DataFrame:
    """file, symbol, outcome: finding, skipped, refired or healed, against recorded milli-log2 values."""
    value = milli(round6(log2_branches(F.col("branches"))))
    rows = nodes.select("file", "symbol", value.alias("now")).join(todo.select("file", "symbol", "value"), ["file", "symbol"], "full")
    breach = F.coalesce(F.col("now") > milli(F.lit(threshold_log2)), F.lit(False))
    outcome = (
        F.when(breach & F.col("value").isNull(), "finding").when(breach & (F.col("now") <= F.col("value")), "skipped")
        .when(breach, "refired").when(F.col("value").isNotNull(), "healed")
    )
    return rows.withColumn("outcome", outcome).where("outcome is not null").select("file", "symbol", "outcome")


def fingerprint(rule: Column, file: Column, symbol: Column) -> Column:
    blank = F.lit("")
    return F.sha2(F.concat_ws(" ", rule, F.coalesce(file, blank), F.coalesce(symbol, blank)), 256)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*(F.when(severity == s, F.lit(k)) for s, k in RANK.items()), F.lit(0))


def summary(findings: DataFrame, fail_level: str | None) -> DataFrame:
    """One row: findings by severity, distinct nodes and rules, and the exit code at ``fail_level`` (None: never fails)."""
    counts = [F.count_if(F.col("severity") == s).alias(k) for s, k in (("error", "errors"), ("warn", "warnings"), ("info", "infos"))]
    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    code = F.lit(0) if fail_level is None else F.when(worst >= RANK[fail_level], 1).otherwise(0)
    return findings.agg(*counts, F.countDistinct("file", "symbol").alias("nodes"), F.countDistinct("rule").alias("rules"), code.cast("int").alias("exit_code"))


def reusability_score(rows: DataFrame, min_score: float = -4.0) -> DataFrame:
    """Scores of at most ``min_score`` whose stamp is fresh: the carried collapse is that of branches and arity."""
    return rows.where(fresh(F.col("collapse"), F.col("branches"), F.col("outcome_arity")) & (round6(F.col("score")) <= min_score))


def fresh(collapse: Column, branches: Column, arity: Column) -> Column:
    """Whether a carried collapse still says branches / max(arity, 1) at two places; a missing one does not."""
    return F.coalesce(collapse == F.round(branches / F.greatest(F.coalesce(arity, F.lit(1)), F.lit(1)), 2), F.lit(False))


def review_surface_limit(surface: DataFrame, most: int | None) -> DataFrame:
    """surface, most, breached: strictly more entrypoints than ``most``; None only reports."""
    return surface.select(F.col("surface_union").alias("surface"), F.lit(most).cast("int").alias("most"), F.coalesce(F.col("surface_union") > F.lit(most), F.lit(False)).alias("breached"))


def _scoped(rows: DataFrame, scopes: list[str]) -> DataFrame:
    """Rows once for each scope whose glob matches their file: one scan, whatever the number of scopes."""
    hits = F.array_compact(F.array(*(F.when(glob_match(F.col("file"), [s]), F.lit(s)) for s in scopes)))
    return rows.withColumn("scope", F.explode(hits))


def ratchet_context(nodes: DataFrame, scopes: list[str]) -> DataFrame:
    """scope, total: the log2 branches each scope holds now, without a verdict."""
    found = _scoped(nodes, scopes).groupBy("scope").agg(F.round(F.sum(log2_branches(F.col("branches"))), 3).alias("total"))
    every = nodes.sparkSession.createDataFrame([(s,) for s in scopes], "scope string")
    return every.join(found, "scope", "left").select("scope", F.coalesce("total", F.lit(0.0)).alias("total"))


def ratchet_contributors(delta: DataFrame, scopes: list[str], top: int = 5) -> DataFrame:
    """scope, symbol, delta_log2, nth: the largest changes of each scope."""
    w = Window.partitionBy("scope").orderBy(F.desc(F.abs("delta_log2")), "file", "symbol")
    rows = _scoped(delta.where("classification <> 'CHANGED_ATTRS'"), scopes).withColumn("nth", F.row_number().over(w).cast("long"))
    return rows.where(F.col("nth") <= top).select("scope", "symbol", "delta_log2", "nth")


def ep_todo(metrics: DataFrame, thresholds: dict[str, float], todo: DataFrame) -> DataFrame:
    """ep, fired, skipped, healed: one row for each entrypoint, the metrics in order; values are compared in thousandths."""
    parts = F.array(*(F.struct(F.lit(m).alias("metric"), milli(round6(F.col(m))).alias("now"), F.lit(int(round(t * 1000))).cast("long").alias("limit")) for m, t in thresholds.items()))
    rows = metrics.select("ep", F.explode(parts).alias("c")).select("ep", "c.*").join(todo, ["ep", "metric"], "full")
    breach = F.coalesce(F.col("now") > F.col("limit"), F.lit(False))
    outcome = (
        F.when(breach & (F.col("value").isNull() | (F.col("now") > F.col("value"))), "fired").when(breach, "skipped").when(F.col("value").isNotNull(), "healed")
    )
    names = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.col("metric")))), ",").alias(o) for o in ("fired", "skipped", "healed")]
    rows = rows.withColumn("outcome", outcome).where("outcome is not null").groupBy("ep").agg(*names)  # as many entries as thresholds
    return rows.select("ep", *(F.when(F.col(o) != "", F.col(o)).alias(o) for o in ("fired", "skipped", "healed")))


def not_evaluable(nodes: DataFrame, needs: dict[str, tuple[str, str]]) -> DataFrame:
    """rule, reason: rules whose column no node has a value in, once each."""
    have = nodes.agg(*(F.bool_or(F.col(c).isNotNull() if c in nodes.columns else F.lit(False)).alias(r) for r, (c, _) in needs.items()))
    rows = F.array(*(F.when(~F.coalesce(F.col(r), F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(why).alias("reason"))) for r, (_, why) in needs.items()))
    return have.select(F.explode(F.array_compact(rows)).alias("x")).select("x.rule", "x.reason").distinct()
