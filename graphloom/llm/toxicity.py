"""Toxic spans by a linear-chain conditional random field.

The chain has two states, clean and toxic, one step per white-space token. Token labels for
training come from the labelled documents: a word or a word beginning whose document frequency
is far higher among toxic documents than among clean ones (a log-likelihood ratio test) marks a
token of a toxic document as toxic. The field is trained on these token labels by gradient steps on
the conditional likelihood; forward-backward marginals then give each token of any document its
probability, and a logistic curve turns expected count and largest marginal into the score.
Only texts are inputs of a score. The fit uses a bounded sample of labelled rows (``max_rows``,
in the order of a hash of doc_id); everything else covers all rows.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix

MAX_ROWS = 4000
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7)
ASIDE = 0.4  # share of the sample that the curve is fitted on, by a chain that has not seen it
EVIDENCE = 30.0  # log-likelihood ratio from which a feature labels tokens
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_TOKEN = re.compile(r"\S+")
_CACHE = 400_000


def features(token: str) -> list[str]:
    word = _EDGE.sub("", token.lower())
    return [f"={word}", *(word[:k] for k in BEGINNINGS if len(word) > k)]


# ---------------------------------------------------------------- the chain


class Layout:
    """Tokens of many documents side by side: step t of all documents that are that long."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        n = lengths[self.order]
        steps = int(n[0]) if len(n) else 0
        self.active = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")
        self.offset = np.concatenate([[0], np.cumsum(self.active)])
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        step = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        self.place = self.offset[step] + np.repeat(rank, lengths) if steps else step

    def marginals(self, emission: np.ndarray, jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) by token, and the summed pair marginals (2 x 2) of neighbouring tokens.

        Works with odds: exp(emission) is the odds of toxic from the token alone, ``jump`` the
        potentials of neighbouring states.
        """
        own = np.empty(len(emission))
        own[self.place] = np.exp(np.clip(emission, -30, 30))
        fore, back = np.empty_like(own), np.ones_like(own)
        (a, b), (c, d) = np.exp(jump)
        cut, steps = self.offset, len(self.active)
        for t in range(steps):
            x = own[cut[t] : cut[t + 1]]
            if t:
                r = fore[cut[t - 1] : cut[t - 1] + len(x)]
                x = x * (b + d * r) / (a + c * r)
            fore[cut[t] : cut[t + 1]] = x
        for t in range(steps - 2, -1, -1):
            k = self.active[t + 1]
            nxt = own[cut[t + 1] : cut[t + 2]] * back[cut[t + 1] : cut[t + 2]]
            back[cut[t] : cut[t] + k] = (c + d * nxt) / (a + b * nxt)
        odds = fore * back
        pairs = np.zeros((2, 2))
        if steps > 1:
            to = np.arange(cut[1], cut[-1])
            t = np.repeat(np.arange(1, steps), self.active[1:])
            at = to - cut[t] + cut[t - 1]
            nxt, r = own[to] * back[to], fore[at]
            w = np.stack([np.full(len(to), a), b * nxt, c * r, d * r * nxt])
            pairs = (w / w.sum(0)).sum(1).reshape(2, 2)
        return (odds / (1 + odds))[self.place], pairs


# ---------------------------------------------------------------- fitting, on the bounded sample


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    jump: np.ndarray
    curve: np.ndarray  # intercept, expected count (log), largest marginal

    def emission(self, token: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(token))

    def score(self, count: np.ndarray, top: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * np.log1p(count) + self.curve[2] * top
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _evidence(t: int, c: int, nt: int, nc: int) -> float:
    """Log-likelihood ratio that a feature is more frequent in toxic documents; 0 if it isn't."""
    if t * nc <= 8 * c * nt:
        return 0.0
    p, x = (t + c) / (nt + nc), 0.0
    for k, n in ((t, nt), (c, nc)):
        for m, q in ((k, p), (n - k, 1 - p)):
            if m and q:
                x += m * math.log(m / n / q)
    return 2 * x


def _originals(tokens: list[np.ndarray], size: int = 16, common: int = 5) -> list[int]:
    """Places of the documents that aren't near copies of an earlier one, by their smallest 3-gram hashes."""
    seen: dict[int, list[int]] = {}
    out = []
    for i, x in enumerate(tokens):
        x = x.astype(np.uint64)
        grams = mix(x[:-2] * np.uint64(3) + x[1:-1] * np.uint64(1 << 21) + (x[2:] << np.uint64(42))) if len(x) > 2 else mix(x)
        low = np.unique(grams)[:size].tolist()
        met: dict[int, int] = {}
        for h in low:
            for k in seen.get(h, ()):
                met[k] = met.get(k, 0) + 1
        if low and max(met.values(), default=0) >= min(common, len(low)):
            continue
        out.append(i)
        for h in low:
            seen.setdefault(h, []).append(i)
    return out


def fit(texts: list[str], toxic: list[int]) -> Model:
    """The chain from all rows; its curve from the rows set aside, scored by a chain from the others."""
    y = np.array(toxic, np.int64)
    nt, nc = int(y.sum()), int(len(y) - y.sum())
    if not nt or not nc:  # nothing to tell apart: the share of toxic rows is the score
        share = (nt + 0.5) / (nt + nc + 1)
        return Model({}, -8.0, np.zeros((2, 2)), np.array([math.log(share / (1 - share)), 0.0, 0.0]))
    aside = np.zeros(len(y), bool)
    for k in (0, 1):  # rows come in no order of their own: the first of each class
        at = np.flatnonzero(y == k)
        aside[at[: int(ASIDE * len(at))]] = True
    parts = [np.flatnonzero(~aside), np.flatnonzero(aside)]
    if min(y[p].sum() for p in parts) < 10:  # too few toxic rows to set any aside
        parts = [np.arange(len(y))] * 2
    first = fit_chain([texts[i] for i in parts[0]], [toxic[i] for i in parts[0]])
    curve = fit_curve(first, [texts[i] for i in parts[1]], y[parts[1]])
    model = first if len(parts[0]) == len(y) else fit_chain(texts, toxic)
    model.curve = curve
    return model


def fit_curve(model: Model, texts: list[str], y: np.ndarray) -> np.ndarray:
    parts = [score_texts(model, texts[i : i + 200], {}) for i in range(0, len(texts), 200)]
    sums, tops = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    x = np.stack([np.ones(len(y)), np.log1p(sums), tops], 1)
    w = np.zeros(3)
    for _ in range(50):  # Newton steps, lightly held to zero
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        step = np.linalg.solve(h, x.T @ (y - q) - np.array([1e-3, 0.1, 0.1]) * w)
        w += np.clip(step, -2, 2)
    return w


def fit_chain(texts: list[str], toxic: list[int], rounds: int = 25, decay: float = 1e-4) -> Model:
    y = np.array(toxic, np.int64)
    # words and features by number, to hold little memory
    kinds: dict[str, int] = {}
    tokens = [np.fromiter((kinds.setdefault(w, len(kinds)) for w in x.split()), np.int32) for x in texts]
    own = _originals(tokens)  # copies of one document are no proof for its words
    tokens, y = [tokens[i] for i in own], y[own]
    texts, toxic = [texts[i] for i in own], y.tolist()
    nt, nc = int(y.sum()), int(len(y) - y.sum())
    ids: dict[str, int] = {}
    at, feature = [], []
    for w, k in kinds.items():
        for f in features(w):
            if len(f) > 1:
                at.append(k)
                feature.append(ids.setdefault(f, len(ids)))
    at, feature = np.array(at, np.int32), np.array(feature, np.int32)
    begin = np.searchsorted(at, np.arange(len(kinds) + 1))
    seen = np.zeros((2, len(ids)), np.int64)
    for x, k in zip(tokens, toxic):
        have = np.unique(np.concatenate([feature[begin[w] : begin[w + 1]] for w in np.unique(x)] or [feature[:0]]))
        seen[k, have] += 1
    proof = np.zeros(len(ids))
    for f in np.flatnonzero(seen[1] * nc > 8 * seen[0] * nt).tolist():
        proof[f] = _evidence(int(seen[1, f]), int(seen[0, f]), nt, nc)
    least = min(EVIDENCE, 0.6 * proof.max(initial=0.0))  # few toxic documents prove less
    marks = (proof >= least) & (proof > 0)
    hits = np.bincount(at, marks[feature], len(kinds)) > 0
    # the chain is trained on all toxic documents and as many clean ones
    if not nt or not nc:
        nt = nc = 1
    clean = np.flatnonzero(y == 0)
    use = np.sort(np.concatenate([np.flatnonzero(y == 1), clean[:: max(1, len(clean) // nt)][:nt]]))
    kind = np.concatenate([tokens[i] for i in use])
    gold = np.concatenate([hits[tokens[i]] & bool(toxic[i]) for i in use]).astype(np.float64)
    lengths = np.array([len(tokens[i]) for i in use], np.int64)
    del tokens
    used = np.zeros(len(kinds), bool)
    used[kind] = True
    count = np.bincount(feature[used[at]], minlength=len(ids))
    good = (count > 1) | marks  # a feature of one word only says nothing about others
    word = np.fromiter((f[0] == "=" for f in ids), bool, len(ids))
    good |= word & (seen.sum(0) > 1)
    keep = good[feature] & used[at]
    at, feature = at[keep], feature[keep]
    layout = Layout(lengths)
    first = np.zeros(len(gold), bool)
    first[np.concatenate([[0], np.cumsum(lengths)])[:-1][lengths > 0]] = True
    later = np.flatnonzero(~first)
    goal = np.array([[np.sum((gold[later - 1] == p) & (gold[later] == q)) for q in (0, 1)] for p in (0, 1)], float)
    theta = np.zeros(len(ids) + 5)
    theta[len(ids)] = -3.0
    m, v, kept = np.zeros_like(theta), np.zeros_like(theta), max(1.0, gold.sum())
    for r in range(1, rounds + 1):  # Adam on the conditional log-likelihood
        score = np.bincount(at, theta[feature], len(kinds)) + theta[len(ids)]  # by word
        p, pairs = layout.marginals(score[kind], theta[-4:].reshape(2, 2))
        by_kind = np.bincount(kind, gold - p, len(kinds))
        grad = np.concatenate([np.bincount(feature, by_kind[at], len(ids)), [by_kind.sum()], (goal - pairs).ravel()]) / kept
        grad -= decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.4 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-6)
    weights = {f: float(theta[k]) for f, k in ids.items() if abs(theta[k]) > 0.05}
    return Model(weights, float(theta[len(ids)]), theta[-4:].reshape(2, 2).copy(), np.zeros(3))


# ---------------------------------------------------------------- scoring


def score_texts(model: Model, texts: list[str], cache: dict[str, float], spans: bool = False):
    """Expected toxic tokens and largest marginal by text, and spans (start, end) at 0.5 or more."""
    rows, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        lengths[i] = len(words)
        found = list(map(cache.get, words))
        if None in found:
            if len(cache) > _CACHE:
                cache.clear()
            for k, x in enumerate(found):
                if x is None:
                    found[k] = cache[words[k]] = model.emission(words[k])
        rows.append(np.array(found, np.float64))
    p, _ = Layout(lengths).marginals(np.concatenate(rows or [np.zeros(0)]), model.jump)
    end = np.cumsum(lengths)
    sums, tops, marked = np.zeros(len(texts)), np.zeros(len(texts)), []
    full = np.flatnonzero(lengths)
    if len(full):
        begin = (end - lengths)[full]
        sums[full], tops[full] = np.add.reduceat(p, begin), np.maximum.reduceat(p, begin)
    for i, text in enumerate(texts) if spans else ():
        at = np.flatnonzero(p[end[i] - lengths[i] : end[i]] >= 0.5) if tops[i] >= 0.5 else ()
        where = [m.span() for m in _TOKEN.finditer(text)] if len(at) else []
        marked.append([{"start": where[k][0], "end": where[k][1], "p": float(p[end[i] - lengths[i] + k])} for k in at])
    return sums, tops, marked


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled rows with crc32(doc_id as text) mod 4 other than 2.

    Rows with a null doc_id, toxic or text are not used; of repeated labels the largest counts.
    """
    chosen = (
        labels.where("toxic is not null and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    rows = (
        docs.select("doc_id", "text").where("text is not null")
        .join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    )
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return fit([r.text for r in rows], [int(r.toxic > 0) for r in rows])


def _slices(sizes: list[int], rows: int, most: int = 8 << 20) -> list[tuple[int, int]]:
    """Rows of a batch in order: at most ``rows`` and, beyond the first, ``most`` bytes of text at a time."""
    out, a, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > a and (i - a == rows or total + n > most):
            out.append((a, i))
            a, total = i, 0
        total += n
    return [*out, (a, len(sizes))] if sizes else []


def score(docs: DataFrame, model: Model, slice_rows: int = 500) -> DataFrame:
    """The input's columns with ``tox_score`` double and ``tox_spans`` (start, end, p by token).

    Null and empty texts have no token and get the score of a text without evidence. An input
    column of either name is replaced.
    """
    docs = docs.drop("tox_score", "tox_spans")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # size bound by max_rows
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        model, cache = shared.value, {}
        for batch in batches:
            for a, b in _slices(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist(), slice_rows):
                part = batch.slice(a, b - a)
                texts = [x or "" for x in part.column(at).to_pylist()]
                sums, tops, spans = score_texts(model, texts, cache, spans=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(model.score(sums, tops)), pa.array(spans, kind)],
                    names=[*names, "tox_score", "tox_spans"],
                )

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
    added = T.StructType.fromDDL("tox_score double, tox_spans array<struct<start:int,end:int,p:double>>")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def tag(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on the labelled rows of ``docs`` and score all its rows; see ``train`` and ``score``."""
    return score(docs, train(docs, labels, max_rows))
