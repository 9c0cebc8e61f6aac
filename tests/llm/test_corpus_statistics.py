"""License notices, whitening and phrases against plain versions, with nulls, ties, repeats, long texts and extra columns."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import licenses, phrases, whitening

DOC = "doc_id long, text string, lang string, n long, key string, w string, notices string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, g, 1, "k", "w", "x") for i, t, g in rows], DOC)


# ---------------------------------------------------------------- licenses


def plain_notices(text):
    """label, base, first and last word and share covered of each notice, by comparing every place with every template."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    found = []
    for given, (k, slack, cover) in ((licenses.BASE, licenses.BASE_RULE), (licenses.NOTICES, licenses.NOTICE_RULE)):
        for label, notice in given:
            t = notice.split()
            met = sorted((p - a, a, p) for a in range(len(t) - k + 1) for p in range(len(w) - k + 1) if w[p : p + k] == t[a : a + k])
            groups = []
            for d, a, p in met:
                if groups and d - groups[-1][-1][0] <= slack:
                    groups[-1].append((d, a, p))
                else:
                    groups.append([(d, a, p)])
            for g in groups:
                seen = {a + j for _, a, _ in g for j in range(k)}
                first, last = min(p for *_, p in g), max(p for *_, p in g) + k - 1
                if len(seen) * 100 >= cover * len(t) and (last - first + 1) * 2 <= len(t) * 3:
                    found.append((first, last, label, given is licenses.BASE, round(len(seen) / len(t), 9)))
    return len(w), sorted(found)


def license_texts():
    rng = random.Random(2)
    filler = ["cc", "by", "all", "rights", "general", "public", "license", "x", "É", "reserved", "the"]
    rows = [(None, None, "en"), (1, "", "en"), (2, "   ", None), (3, "CC-BY cc by, CC BY", "en"), (5, "CC-BY cc by, CC BY", "en"), (3, "another text of the same id", "en"), (4, "All rights reserved.", "en"), (4, "All rights reserved.", "en")]
    for n, (_, notice) in enumerate(licenses.NOTICES):
        w = notice.split()
        rows.append((10 + n, "Éa " + notice.upper() + " end", "fr"))
        w[len(w) // 2 : len(w) // 2] = ["very"]
        rows.append((40 + n, " ".join(["b"] * n + w + ["; "] + w), "en"))
        rows.append((70 + n, " ".join(w[: len(w) // 2]), "en"))
    rows += [(100 + n, " ".join(rng.choice(filler) for _ in range(rng.randrange(60))), "en") for n in range(40)]
    rows.append((200, "filler text of many words " * 6_000 + "Released under the MIT License. " + "general public license " * 50, "en"))
    rows.append((None, "Released under the MIT License", None))
    return rows


def test_license_notices(spark):
    rows = license_texts()
    got = collections.Counter((r.doc_id, r.n_words, tuple(sorted((x.first_word, x.last_word, x.label, x.base, round(x.covered, 9)) for x in r.notices))) for r in licenses.scan(documents(spark, rows)).collect())
    want = collections.Counter((i, plain_notices(t)[0], tuple(plain_notices(t)[1])) for i, t, _ in rows)
    assert got == want
    digest = {r.doc_id: r for r in licenses.labels(licenses.scan(documents(spark, rows))).collect() if r.doc_id is not None}
    assert (digest[5].n_base, digest[5].labels, digest[5].last_word) == (3, "cc-by", 4) and (digest[4].base_labels, digest[4].score) == ("reserved", 1.0)
    assert (digest[200].n_base, digest[200].labels, digest[200].first_word) == (50, "gpl,mit", 30_005)
    assert (digest[1].n_base, digest[1].first_word, digest[1].base_labels, digest[1].score) == (0, None, "", 0.0)


def test_license_notices_of_own_templates_and_an_empty_table(spark):
    given = licenses.templates(spark, [("mine", "one two three four five"), ("short", "a b")], [])
    got = licenses.scan(documents(spark, [(1, "zero one two three four five six a b", "en")]), given).first()
    assert [(x.label, x.first_word, x.last_word) for x in got.notices] == [("mine", 1, 5)]
    empty = licenses.labels(licenses.scan(documents(spark, [])))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_license_templates_joined_by_a_shuffle(spark, monkeypatch):
    rows = license_texts()[:30]
    want = sorted(map(repr, licenses.labels(licenses.scan(documents(spark, rows))).collect()))
    monkeypatch.setattr(licenses, "BROADCAST", 0)
    assert sorted(map(repr, licenses.labels(licenses.scan(documents(spark, rows))).collect())) == want


# ---------------------------------------------------------------- whitening

VEC = "vec_id long, embedding array<float>, x string, n int"


def plain_whitening(rows, most=32):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    c = np.array([[(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(most, int((values > 1e-9 * values[0]).sum()))
    return kept, n, deviations, c @ vectors[:, :some] / np.sqrt(values[:some]), values[:some] / values.sum()


def test_whitening(spark):
    rng = np.random.default_rng(4)
    mixed = rng.standard_normal((300, 40)) @ rng.standard_normal((40, 40)) + rng.standard_normal(40) * 5
    rows = [(int(i), v.tolist()) for i, v in enumerate(mixed)]
    rows += [(None, mixed[0].tolist()), (7, mixed[7].tolist()), (400, None), (401, [None] * 40), (402, [float("nan")] * 40), (403, [float("inf")] + [0.0] * 39), (404, [0.0] * 40), (405, [1.0] * 3), (406, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VEC).repartition(5)
    got = whitening.whiten(df).collect()
    kept, n, deviations, white, explained = plain_whitening([(i, v) for i, v in rows if v is None or len(v) == 40])
    assert len(got) == len(kept) * 32 and {r.n for r in got} == {n}
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
    signs = np.array([np.sign(by[0, k + 1][0].whitened * white[0, k]) for k in range(32)])
    for row, (i, _) in enumerate(kept):
        for k in range(32):
            assert any(r.deviation == deviations[row] and math.isclose(r.whitened, white[row, k] * signs[k], rel_tol=1e-7, abs_tol=1e-7) for r in by[i, k + 1])
    assert np.allclose([by[0, k + 1][0].explained for k in range(32)], explained, rtol=1e-9) and got[0].identity_error < 1e-9


def test_whitening_of_few_flat_and_large_vectors(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VEC)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [float("nan")])])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance, no component
    line = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.deviation, round(abs(r.whitened), 9), r.explained) for r in line) == [(1, 1, 128**2, 1.0, 1.0), (2, 1, 128**2, 1.0, 1.0)]
    wide = whitening.whiten(frame([(1, [1e16, 0.0]), (2, [-1e16, 0.0]), (3, [3e38, 0.0])])).collect()  # the third is beyond a long
    assert [(r.n, r.deviation, round(abs(r.whitened), 6)) for r in wide] == [(2, None, 1.0)] * 2


# ---------------------------------------------------------------- phrases


def plain_collocations(rows, least, cover, top):
    counts, words = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {g: a for g, a in counts.items() if len(g[1]) > 1 and a >= least}
    hidden = set()
    for (lang, w), a in candidates.items():
        hidden |= {(lang, w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) and 100 * a >= cover * counts[lang, w[i:j]]}
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in hidden:
            score, _, left, right = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, words[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_texts():
    rng = random.Random(6)
    vocabulary = ["of", "The", "in", "a", "b", "É", "é", "new\x00", '"york"', "\x85x", "'t", "z\\", "km"]
    rows = [(None, None, "en"), (1, "", "en"), (2, " \t ,,;\n\r\x0b\x0c", "de"), (3, "alone", "tab\tand\nline")]
    for n in range(120):
        w = rng.choices(vocabulary, [9, 9, 7, 5, 5, 3, 3, 2, 2, 2, 1, 1, 1], k=rng.randrange(60))
        rows.append((n, rng.choice([" ", "  ", "\t"]).join(w) + rng.choice([". ", "\n", "!"]) + "in a new york minute, a b", rng.choice(["en", "en", "fr", None, "und", "tab\tand\nline"])))
    rows += [(n, "This line stands everywhere. Of the of the of the", "en") for n in range(200)]
    rows.append((999, "of the b in a " * 30_000, "fr"))  # one piece of 150,000 words
    return rows


@pytest.mark.parametrize("openings", [512, 8])
def test_collocations(spark, openings):
    rows = phrase_texts()
    df = documents(spark, rows).repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=5, top=40, openings=openings).collect())
    assert got == plain_collocations(rows, 5, 80, 40)


def test_collocations_of_small_chunks_and_bodies(spark, monkeypatch):
    """Pieces that are dealt out in many parts give the same counts. Openings of two and three words are spread over the buckets."""
    rows = phrase_texts()[:-1]
    found = phrases.pieces(documents(spark, rows)).collect()
    hot = {2: [("en", "of the"), ("fr", "in a")], 3: [("en", "of the of")]}
    monkeypatch.setattr(phrases, "CHUNK", 2000)
    monkeypatch.setattr(phrases, "BODY", 500)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in found])
    dealt = [r for b in phrases._deal(7, hot)([batch]) for r in b.to_pylist()]
    dealt.sort(key=lambda r: (r["bucket"], r["kind"], r["lang"]))
    counted = collections.Counter()
    for b in phrases._count(5, hot)([pa.RecordBatch.from_pylist(dealt)]):
        for r in b.to_pylist():
            counted[r["lang"], r["size"], r["phrase"]] += r["f"]
    got = {k: f for k, f in counted.items() if f >= 5 or k[1] == 0}
    plain = collections.Counter()
    for r in found:
        w = r.piece.split(" ")
        plain[r.lang, 0, ""] += len(w) * r.m
        for size in range(1, 5):
            for i in range(len(w) - size + 1):
                plain[r.lang, size, " ".join(w[i : i + size])] += r.m
    assert got == {k: f for k, f in plain.items() if f >= 5 or k[1] == 0}


def test_collocations_of_large_counts(spark):
    """Products beyond 64 bits: counts are given, not counted."""
    big = 4 * 10**18
    found = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big // 2), ("en", 2, "a b", big // 3), ("en", 1, "c", big), ("en", 2, "b c", big // 4), ("en", 3, "a b c", big // 4)], "lang string, size int, phrase string, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in phrases.cuts(found).collect()}
    assert got["a b"] == (big // 3, big, big // 2, 2_000_000 * (big // 3) // (big + big // 2))
    assert got["a b c"] == (big // 4, big // 3, big, 2_000_000 * (big // 4) // (big // 3 + big))  # the later cut scores lower
    assert {r.phrase for r in phrases.absorbed(found).collect()} == {"b c"}


def test_collocations_of_nothing(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(1, None, None)])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_tasks_of_phrases_are_handed_few_bytes_at_once(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    rows = spark.range(0, 64, 1, 1).selectExpr("repeat('x', 1048576) AS body")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with phrases.small_batches(spark):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert max(got) <= 2 * phrases.BATCH and sum(got) >= 64 << 20 and spark.conf.get(name) == before
