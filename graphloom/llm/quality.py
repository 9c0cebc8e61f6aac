"""Document quality with hierarchical empirical Bayes.

A logistic classifier over surface statistics of a text gives each document its evidence. Labelled
rows are counted by host and by path within the host; each host's share of good documents is
shrunk toward the global share, and each path's toward its host's, with strengths fitted by
moments, so sparse sites stay near their prior. The posterior adds the path's prior odds to
the document's evidence. Counts are grouped aggregations over all labelled rows outside the
held-out fold; only the classifier is fitted on a bounded sample (``max_rows``).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 4000
THRESHOLD = 0.5
STRENGTH = (2.0, 1000.0)  # bounds of the fitted strengths
_MARK = re.compile(r"[^\w\s]{2,}")


def statistics(text: str) -> list[float]:
    """Surface statistics of a whole text; zeros for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 9
    chars = len(text)
    kinds = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    ends = sum(not w[-1].isalnum() for w in words)
    marks = len(_MARK.findall(text))
    bars = text.count("|")
    return [1.0, math.log1p(n), kinds / n, same / n, upper / n, marks / n, bars / n, ends / n, (chars - n) / n / 10]


def fit(rows: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights of the logistic classifier (Newton steps with a small ridge)."""
    w = np.zeros(rows.shape[1])
    if not len(good) or good.min() == good.max():
        return w
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        h = (rows * (p * (1 - p))[:, None]).T @ rows + 0.3 * np.eye(len(w))
        step = np.linalg.solve(h, rows.T @ (good - p) - 0.3 * w)
        w += np.clip(step, -3, 3)
    return w


def _evidence(docs: DataFrame, weights: np.ndarray, base: float) -> DataFrame:
    """doc_id, host, path, evidence: the classifier's log odds less the log odds of its sample."""
    def run(batches):
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(3).to_pylist()]).reshape(-1, len(weights))
            e = np.where(x[:, 0] > 0, np.clip(x @ weights, -30, 30) - base, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(e)], names=["doc_id", "host", "path", "evidence"])

    return docs.mapInArrow(run, "doc_id long, host string, path string, evidence double")


def _strength(rows: DataFrame, prior: str) -> float:
    """Pseudo-count of a beta prior around ``prior``, by moments over the groups (k of n are good)."""
    r = rows.where("n > 1").agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col(prior), 2)).alias("s"),
        F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("v"),
        F.sum(F.col("n") * (F.col("n") - 1) * F.col(prior) * (1 - F.col(prior))).alias("w"),
    ).first()
    if not r.w or r.s <= r.v:
        return STRENGTH[1]
    share = min(0.999, (r.s - r.v) / r.w)  # correlation inside a group
    return float(min(STRENGTH[1], max(STRENGTH[0], 1 / share - 1)))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, host, path, evidence, prior, score (0 to 1, higher: better) for every row of ``docs``.

    Labels with crc32(doc_id as text) mod 4 = 2 are held out. Null texts and empty texts carry no
    evidence and get their path's prior; null hosts and paths are sites of their own; a null
    or missing label is not used, of repeated labels the largest counts. Repeated rows give
    repeated results; other columns are ignored. Without labels every score is 0.5.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text",
    )
    known = (
        labels.where("quality is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("good"))
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = rows.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    sample.sort(key=lambda r: (r.doc_id, r.text or ""))
    good = np.array([r.good for r in sample], float)
    weights = fit(np.array([statistics(r.text or "") for r in sample]).reshape(len(sample), -1), good) if sample else np.zeros(9)
    base = math.log((good.sum() + 0.5) / (len(good) - good.sum() + 0.5)) if sample and weights.any() else 0.0

    sites = rows.select("doc_id", "host", "path").join(known, "doc_id").groupBy("host", "path").agg(F.sum("good").alias("k"), F.count("*").alias("n"))
    paths = sites.cache()
    total = paths.agg(F.sum("k"), F.sum("n")).first()
    overall = ((total[0] or 0) + 0.5) / ((total[1] or 0) + 1)
    hosts = paths.groupBy("host").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("m", F.lit(overall))
    a = _strength(hosts, "m")
    hosts = hosts.select("host", ((F.col("k") + a * overall) / (F.col("n") + a)).alias("host_share"))
    joined = paths.join(hosts, "host")
    b = _strength(joined, "host_share")
    priors = joined.select("host", "path", ((F.col("k") + b * F.col("host_share")) / (F.col("n") + b)).alias("path_share"))
    found = _evidence(rows, weights, base).join(hosts, "host", "left").join(priors, ["host", "path"], "left")
    prior = F.coalesce("path_share", "host_share", F.lit(overall))
    odds = F.col("evidence") + F.log(F.col("prior") / (1 - F.col("prior")))
    return found.withColumn("prior", prior).select("doc_id", "host", "path", "evidence", "prior", (1 / (1 + F.exp(-odds))).alias("score"))
