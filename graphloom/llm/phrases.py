"""Phrase collocations: which words of a language stand together more often than apart.

Texts are cut to pieces; identical pieces of a language become one row with a multiplicity. Each task takes its
pieces apart into windows of up to four words, adds equal ones up in DuckDB and deals them out by a hash of the language and
the first two words, so that one hash bucket holds all that begins alike: there DuckDB counts the phrases of two, three
and four words, out-of-core, and lets go what stays below the least count. Single words are dealt out and counted the same way.
What is left are counts of frequent phrases; the parts of a candidate are frequent too, so their counts are found by
requests that Spark shuffles to the counts.

Two words that open a large share of all windows would make a bucket of their own too large. Such openings, found on a
sample of the pieces, are dealt out by three words, and large openings of three words by the whole window. The
sample decides where a window is counted and nothing else: counts are exact with any choice.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions

LEAST, COVER, TOP = 30, 80, 2000
OPENINGS = 512  # an opening with a larger share of the sampled windows than one in so many is dealt out finer
CHUNK = 8 << 20  # bytes of pieces that DuckDB takes apart at once
BODY = 4 << 20  # bytes of a bucket's windows that go to DuckDB at once
BATCH = 4 << 20  # bytes that a task is handed at once
MEMORY = "192MB"  # of DuckDB in a task; beyond it DuckDB works on disk


def _by_bytes(batch: pa.RecordBatch, column: int, most: int):
    """The batch in slices with at most ``most`` bytes of a text column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first = total = 0
    for k, size in enumerate(sizes):
        if k > first and total + size > most:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def _pieces(batches):
    """Batches of lang, text to batches of lang, piece: words of a piece are joined by one space, empty pieces left out."""
    for batch in batches:
        for part in _by_bytes(batch, 1, CHUNK):
            lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column(1), "")), "[.,;:!?\\x0A-\\x0D]")
            piece = pc.ascii_trim(pc.list_flatten(lists), " \t")
            if pc.any(pc.match_substring_regex(piece, "\t|  ")).as_py():
                piece = pc.replace_substring_regex(piece, "[ \t]+", " ")
            lang = pc.take(part.column(0), pc.list_parent_indices(lists))
            some = pc.not_equal(piece, "")
            yield pa.RecordBatch.from_arrays([lang.filter(some), piece.filter(some)], names=["lang", "piece"])


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece, m: the distinct pieces of each language and how often they stand in the texts."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces, "lang string, piece string").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def frequent_openings(found: DataFrame, openings: int = OPENINGS, one_in: int = 32) -> dict[int, list[tuple[str, str]]]:
    """Openings of 2 and of 3 words with a share of at least 1 / ``openings`` of the windows of some pieces: ``openings`` of each at most."""
    w = F.col("w")
    opening = lambda k: F.transform(w, lambda x, i: F.when(i + k <= F.size(w), F.struct(F.lit(k).alias("k"), F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, k))).alias("opening"))))
    rows = found.where(F.pmod(F.xxhash64("lang", "piece"), F.lit(one_in)) == 0).select("lang", F.split("piece", " ").alias("w"))
    begun = rows.select("lang", F.explode(F.concat(opening(2), opening(3))).alias("o")).where("o is not null")
    counts = cut(begun.groupBy("lang", "o.k", "o.opening").agg(F.count("*").alias("n")))
    total = counts.groupBy("k").agg(F.sum("n").alias("total"))
    large = counts.join(total, "k").where(F.col("n") * openings >= F.col("total")).select("k", "lang", "opening").collect()
    return {k: [(r.lang, r.opening) for r in large if r.k == k] for k in (2, 3)}


class Counter:
    """DuckDB in one task: one thread, bounded memory, the rest on the disk where Spark itself spills; gone at the end."""

    def __init__(self, hot: dict[int, list[tuple[str, str]]]):
        import duckdb

        base = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.folder = tempfile.mkdtemp(prefix="phrases-", dir=base if base and os.path.isdir(base) else None)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder, "preserve_insertion_order": False})
        for k, rows in hot.items():
            self.con.execute(f"CREATE TABLE hot{k} (lang VARCHAR, opening VARCHAR)")
            if rows:
                self.con.executemany(f"INSERT INTO hot{k} VALUES (?, ?)", rows)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.con.close()
        shutil.rmtree(self.folder, ignore_errors=True)

    def table(self, sql: str) -> pa.Table:
        return self.con.sql(sql).to_arrow_table()

    def given(self, name: str, rows: pa.Table) -> None:
        self.con.register(name, rows)

    def taken(self, name: str) -> None:
        self.con.unregister(name)


def _taken_apart(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The words (lang, word, m) and windows (lang, opening, rest, m) that begin at each word of the pieces; openings have two words, rests up to two."""
    lists = pc.split_pattern(rows.column("piece").combine_chunks(), " ")
    word, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    lang, m = rows.column("lang").combine_chunks(), rows.column("m").combine_chunks()
    first = np.flatnonzero(row[1:] == row[:-1])

    def later(k):
        at = np.minimum(first + k, len(row) - 1)
        return word.take(pa.array(at, mask=(first + k >= len(row)) | (row[at] != row[first])))

    opening = pc.binary_join_element_wise(word.take(pa.array(first)), later(1), " ")
    rest = pc.ascii_rtrim(pc.binary_join_element_wise(pc.fill_null(later(2), ""), pc.fill_null(later(3), ""), " "), " ")
    own = pa.array(row[first])
    words = pa.table({"lang": lang.take(pa.array(row)), "word": word, "m": m.take(pa.array(row))})
    return words, pa.table({"lang": lang.take(own), "opening": opening, "rest": rest, "m": m.take(own)})


_WINDOWS = "CREATE OR REPLACE TABLE windows AS SELECT lang, opening, rest, CAST(sum(m) AS BIGINT) AS m FROM begun GROUP BY ALL"

_DEALT = """
SELECT CAST(bucket AS INT) AS bucket, 2 AS kind, lang, string_agg(CAST(m AS VARCHAR) || chr(9) || opening || chr(9) || rest, chr(10)) AS body FROM (
  SELECT x.lang, x.opening, x.rest, x.m, CASE WHEN h3.opening IS NOT NULL THEN hash(x.lang, x.opening, x.rest)
    WHEN h2.opening IS NOT NULL THEN hash(x.lang, x.opening, split_part(x.rest, ' ', 1)) ELSE hash(x.lang, x.opening) END % {buckets} AS bucket
  FROM windows x LEFT JOIN hot2 h2 ON h2.lang = x.lang AND h2.opening = x.opening
  LEFT JOIN hot3 h3 ON h2.opening IS NOT NULL AND x.rest <> '' AND h3.lang = x.lang AND h3.opening = x.opening || ' ' || split_part(x.rest, ' ', 1)
) GROUP BY ALL
UNION ALL
SELECT CAST(hash(lang, word) % {buckets} AS INT), 1, lang, string_agg(CAST(m AS VARCHAR) || chr(9) || word, chr(10)) FROM (
  SELECT lang, word, CAST(sum(m) AS BIGINT) AS m FROM single GROUP BY ALL
) GROUP BY ALL"""


def _deal(buckets: int, hot: dict[int, list[tuple[str, str]]]):
    """Batches of lang, piece, m to rows of bucket, kind (1: words, 2: windows), lang, body: lines of counts and words."""

    def run(batches):
        with Counter(hot) as db:

            def flush(held):
                single, begun = _taken_apart(pa.Table.from_batches(held))
                db.given("begun", begun)
                db.con.execute(_WINDOWS)
                db.taken("begun")
                db.given("single", single)
                out = db.table(_DEALT.format(buckets=buckets))
                db.taken("single")
                for k in range(out.num_rows):
                    yield from out.slice(k, 1).to_batches()

            held, size = [], 0
            for batch in batches:
                for part in _by_bytes(batch, 1, CHUNK):
                    held.append(part)
                    size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                    if size >= CHUNK:
                        yield from flush(held)
                        held, size = [], 0
            if held:
                yield from flush(held)

    return run


_COUNTS = """
WITH pairs AS (
  SELECT x.lang, x.opening, CAST(sum(x.m) AS BIGINT) AS f, bool_or(h.opening IS NOT NULL) AS hot
  FROM windows x LEFT JOIN hot2 h ON h.lang = x.lang AND h.opening = x.opening GROUP BY ALL HAVING f >= {least} OR hot
), kept AS (
  SELECT x.lang, x.opening, split_part(x.rest, ' ', 1) AS third, x.rest, x.m, p.hot FROM windows x JOIN pairs p ON p.lang = x.lang AND p.opening = x.opening WHERE x.rest <> ''
), triples AS (
  SELECT k.lang, k.opening || ' ' || k.third AS phrase, CAST(sum(k.m) AS BIGINT) AS f, bool_or(k.hot AND h.opening IS NOT NULL) AS hot
  FROM kept k LEFT JOIN hot3 h ON h.lang = k.lang AND h.opening = k.opening || ' ' || k.third GROUP BY ALL HAVING f >= {least} OR hot
), quads AS (
  SELECT lang, opening || ' ' || rest AS phrase, CAST(sum(m) AS BIGINT) AS f FROM kept WHERE rest <> third GROUP BY ALL HAVING f >= {least}
)
SELECT lang, 0 AS size, '' AS phrase, CAST(sum(m) AS BIGINT) AS f FROM words GROUP BY lang
UNION ALL SELECT lang, 1, word, CAST(sum(m) AS BIGINT) AS f FROM words GROUP BY ALL HAVING sum(m) >= {least}
UNION ALL SELECT lang, 2, opening, f FROM pairs UNION ALL SELECT lang, 3, phrase, f FROM triples UNION ALL SELECT lang, 4, phrase, f FROM quads"""

_LINES = {1: ("words", ["m", "word"]), 2: ("windows", ["m", "opening", "rest"])}


def _count(least: int, hot: dict[int, list[tuple[str, str]]]):
    """Rows of ``_deal``, those of a bucket one after the other, to lang, size (0: all words), phrase, f."""

    def run(batches):
        with Counter(hot) as db:

            def begin():
                db.con.execute("CREATE OR REPLACE TABLE words (lang VARCHAR, word VARCHAR, m BIGINT)")
                db.con.execute("CREATE OR REPLACE TABLE windows (lang VARCHAR, opening VARCHAR, rest VARCHAR, m BIGINT)")

            def add(kind, lang, bodies):
                name, columns = _LINES[kind]
                rows = pa.csv.read_csv(
                    pa.py_buffer("\n".join(bodies).encode()),
                    pa.csv.ReadOptions(use_threads=False, column_names=columns, block_size=2 * BODY),
                    pa.csv.ParseOptions(delimiter="\t", quote_char=False, escape_char=False),
                    pa.csv.ConvertOptions(column_types={c: pa.int64() if c == "m" else pa.string() for c in columns}, strings_can_be_null=False),
                )
                db.given("lines", rows)
                db.con.execute(f"INSERT INTO {name} SELECT ?, {', '.join(columns[1:])}, m FROM lines", [lang])
                db.taken("lines")

            begin()
            at, bodies, size = None, [], 0
            for batch in batches:
                for k in range(batch.num_rows):  # bodies are large: one at a time
                    row = tuple(batch.column(c)[k].as_py() for c in range(4))
                    if at is not None and (row[:3] != at or size >= BODY):
                        add(at[1], at[2], bodies)
                        bodies, size = [], 0
                        if row[0] != at[0]:
                            yield from db.table(_COUNTS.format(least=least)).to_batches()
                            begin()
                    at = row[:3]
                    bodies.append(row[3])
                    size += len(row[3])
            if at is not None:
                add(at[1], at[2], bodies)
                yield from db.table(_COUNTS.format(least=least)).to_batches()

    return run


def counts(docs: DataFrame, least: int = LEAST, openings: int = OPENINGS) -> DataFrame:
    """lang, size, phrase, f: phrases of 1 to 4 words met at least ``least`` times; size 0 has the number of all words."""
    found = cut(pieces(docs))
    n = partitions(docs.sparkSession)
    hot = frequent_openings(found, openings)
    dealt = found.mapInArrow(_deal(2 * n, hot), "bucket int, kind int, lang string, body string")
    parts = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "kind", "lang").mapInArrow(_count(least, hot), "lang string, size int, phrase string, f long")
    return parts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH):
    """Inside, Arrow batches end at ``most`` bytes. A row here can have many kilobytes, so that the usual number of rows would be a task's whole input."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cuts(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score: each candidate with the cut that scores lowest, the earliest of equals.

    Every part of every cut is a request; Spark shuffles the requests to the counts of the parts and the answers
    back to their candidates. Sums and products are decimals of 38 digits.
    """
    w = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice(w, first, n), " ")
    candidates = found.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    both = F.array(F.struct(F.lit(True).alias("left"), part(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))
    requests = candidates.select("lang", "phrase", "a", "k", F.explode(both).alias("q")).select("lang", "phrase", "a", "k", "q.left", "q.part")
    known = found.where("size > 0").select("lang", F.col("phrase").alias("part"), "f")
    answered = requests.join(known, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r")
    )
    score = F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")
    return answered.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def absorbed(found: DataFrame, cover: int = COVER) -> DataFrame:
    """lang, phrase: candidates inside a longer one that has at least ``cover`` hundredths of their count.

    A longer candidate hides the phrases one word shorter; what it hides of two words less is hidden by the phrase between, which is met as
    often at least.
    """
    w = F.split("phrase", " ")
    inner = F.array(*(F.array_join(F.slice(w, first, F.col("size") - 1), " ") for first in (1, 2)))
    longer = found.where("size > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    exact = "CAST(100 AS DECIMAL(3, 0)) * CAST(longer AS DECIMAL(19, 0)) >= CAST({} AS DECIMAL(3, 0)) * CAST(f AS DECIMAL(19, 0))"
    return found.where("size > 1").join(longer, ["lang", "phrase"]).where(exact.format(int(cover))).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int | None = TOP, openings: int = OPENINGS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language (None: all), best first.

    ``docs`` has lang and text; other columns are ignored. A null lang is ``und``, a null text empty; texts without
    words add nothing, and an empty table gives an empty one. Repeated rows count as often as they stand there.
    Equal scores are told apart by a, then by the bytes of the phrase.
    """
    with small_batches(docs.sparkSession):
        found = cut(counts(docs, least, openings))
    n = found.where("size = 0").select("lang", F.col("f").alias("n"))
    rows = cuts(found).join(absorbed(found, cover), ["lang", "phrase"], "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:  # the best of 64 shares of a language first: no task sorts a whole language
        share = F.pmod(F.xxhash64("phrase"), F.lit(64))
        rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("_nth") <= top).drop("_nth")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    else:
        rows = rows.withColumn("rank", F.lit(None).cast("long"))
    return rows.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
