"""The queries of the training-data operators, on the driver's tables."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, debruijn_dedup, decontaminate, embed_dedup, html_text, licenses, packing, phrases, quality, simhash, suffix_dedup, toxicity, whitening
from .common import cut, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn_dedup.digests(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return toxicity.tag(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("tox_score").alias("score"),
        (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("tox_spans").alias("n_spans"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.conversations(cut(chat.threads(rows))))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "prior", "score", (F.col("score") >= quality.THRESHOLD).alias("keep"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(licenses.scan(table(spark, sf_dir, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_decontamination, op3_substring_dedup, op4_toxicity, op5_simhash, op6_suffix_dedup,
        op7_chat_formatting, op8_embedding_near_dedup, op9_quality, op10_best_fit_packing, op11_license_scan, op12_embedding_whitening,
        op13_phrase_collocations,
    )
}

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def _templates_sql() -> str:
    rows = [(label, text, "true", *licenses.BASE_RULE) for label, text in licenses.BASE]
    rows += [(label, text, "false", *licenses.NOTICE_RULE) for label, text in licenses.NOTICES]
    return ", ".join(f"({n}, '{label}', string_split('{text}', ' '), {base}, {k}, {slack}, {cover})" for n, (label, text, base, k, slack, cover) in enumerate(rows))


#: Notices by joining words themselves: a template's run meets every equal run of a text.
_LICENSES = f"""
WITH t(template, label, w, base, k, slack, cover) AS (VALUES {_templates_sql()}),
runs AS (SELECT template, label, base, k, slack, cover, len(w) AS size, w[i+1:i+k] AS run, i AS word FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS i FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM t)),
met AS (SELECT p.r, runs.*, p.p, p.p - runs.word AS diagonal FROM p JOIN runs ON runs.k = p.k AND p.w[p.p+1:p.p+p.k] = runs.run),
steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal, word) <= slack THEN 0 ELSE 1 END AS new FROM met),
merged AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal, word) AS m FROM steps),
spans AS (SELECT r, label, base, size, cover, min(p) AS first_word, max(p + k) - 1 AS last_word, len(list_distinct(flatten(list(range(word, word + k))))) AS seen FROM merged GROUP BY r, template, label, base, size, k, cover, m),
held AS (SELECT *, seen / size AS covered FROM spans WHERE seen * 100 >= cover * size AND (last_word - first_word + 1) * 2 <= size * 3)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base, CAST(min(first_word) FILTER (base) AS BIGINT) AS first_word, CAST(max(first_word) FILTER (base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(covered), 0.0) AS score
FROM d LEFT JOIN held USING (r) GROUP BY d.r, doc_id, w"""

#: Every phrase of every piece, counted one by one.
_PHRASES = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, s, array_to_string(w[i:i+s-1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(s)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE s > 1 AND f >= 30),
k AS (SELECT lang, s, phrase, w, a, unnest(range(1, s)) AS k FROM c),
cut AS (SELECT k.lang, k.s, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(k.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score FROM k
  JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k+1:k.s], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
hidden AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN (SELECT lang, s, a, array_to_string(w[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(i + 1, s + 1)) AS j FROM (SELECT *, unnest(range(1, s)) AS i FROM c))
  WHERE j - i + 1 < s) x ON x.lang = c.lang AND x.phrase = c.phrase WHERE 100 * CAST(x.a AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT))
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM best b JOIN n USING (lang) WHERE (b.lang, b.phrase) NOT IN (SELECT (lang, phrase) FROM hidden) QUALIFY rank <= 2000"""

#: The others can't be written in plain SQL. tests/llm holds op2 to op8, op10 and op12 against plain versions, counted chains or exact
#: round trips, op1 against pages with known texts, and op4 and op9 against held-out labels.
ORACLE_SQL: dict[str, str] = {"op11_license_scan": _LICENSES, "op13_phrase_collocations": _PHRASES}
