"""License notices in texts by diagonal voting, in DataFrame functions alone.

Every run of k words of every text is hashed and joined with the runs of the templates. A hit at word p of a text and word t of a
template votes for the diagonal p - t: an unbroken copy of the template puts all its hits on one, a word put in or left out moves the rest
to a neighbour. Neighbouring diagonals are merged, and a merged one counts as a notice only if its hits, compared word by word,
cover enough of the template. Base phrases are templates too: they need every word, on one diagonal.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import row_key

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST = 100_000  # runs of the templates that go to every task; more are joined by a shuffle

#: Fixed phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Fixed public notices and their labels.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

#: For base phrases: words of a run, words a diagonal may be off its neighbour, hundredths of the template to be covered.
BASE_RULE = (2, 0, 100)
NOTICE_RULE = (3, 3, 75)


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case. Texts of ASCII alone take the shorter way to the same letters."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), BREAK), "")


def templates(spark: SparkSession, notices=NOTICES, base=BASE) -> DataFrame:
    """template, label, base, k, slack, cover, text: the notices and base phrases as a table."""
    rows = [(label, text, True, *BASE_RULE) for label, text in base] + [(label, text, False, *NOTICE_RULE) for label, text in notices]
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "template int, label string, text string, base boolean, k int, slack int, cover int")


def _code(k: int, names: list[str]) -> Column:
    return F.xxhash64(F.lit(k), *(F.col(c) for c in names[:k]))


def _runs(given: DataFrame, ks: list[int]) -> DataFrame:
    """template, label, base, t_k, slack, cover, size, at, t0, t1 ..., hash: every run of k words of every template."""
    t = given.withColumn("w", words(F.col("text"))).withColumn("size", F.size("w")).where("size >= k").withColumnRenamed("k", "t_k")
    names = [f"t{j}" for j in range(max(ks, default=0))]
    rows = t.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("t_k"))))
    rows = rows.withColumns({c: F.when(F.col("t_k") > j, F.get("w", F.col("at") + j)) for j, c in enumerate(names)})
    return rows.withColumn("hash", F.coalesce(*(F.when(F.col("t_k") == k, _code(k, names)) for k in ks), F.lit(None).cast("long"))).drop("w", "text")


def hits(docs: DataFrame, given: DataFrame) -> DataFrame:
    """key, doc_id, n, copies, and for each hit the template's columns, at (word of the template) and p (word of the text).

    A row without a template stands for the document itself; equal rows of ``docs`` are one with ``copies``. The words of
    a run are compared with the template's, so that no hash decides.
    """
    ks = sorted(r.k for r in given.select("k").distinct().collect())
    runs = _runs(given, ks)
    few = runs.count() <= BROADCAST
    most = max(ks, default=1)
    # row q > 0 holds word q - 1 and those that follow it; row 0 is the document
    later = {f"w{j}": F.slice("w", j, F.size("w")) if j > 1 else F.col("w") for j in range(1, most)}
    rows = docs.select(row_key().alias("key"), "doc_id", words(F.col("text")).alias("w"))
    rows = rows.select("key", "doc_id", F.size("w").alias("n"), F.concat(F.array(F.lit(None).cast("string")), "w").alias("w0"), *(c.alias(name) for name, c in later.items()))
    names = [f"w{j}" for j in range(most)]
    rows = rows.select("key", "doc_id", "n", F.posexplode(F.arrays_zip(*names)).alias("q", "x"))
    rows = rows.select("key", "doc_id", "n", "q", *(F.col(f"x.{c}").alias(c) for c in names))
    codes = F.array(*(F.when((F.col("q") > 0) & F.col(names[k - 1]).isNotNull(), _code(k, names)) for k in ks), F.lit(None).cast("long"))
    rows = rows.select("*", F.posexplode(codes).alias("turn", "code")).where("code IS NOT NULL OR q = 0 AND turn = 0")
    same = F.col("code") == F.col("hash")
    for j, c in enumerate(names):
        same = same & ((F.col("t_k") <= j) | (F.col(c) == F.col(f"t{j}")))
    met = rows.join(F.broadcast(runs) if few else runs, same, "left").where((F.col("q") == 0) | F.col("template").isNotNull())
    place = F.when(F.col("q") > 0, F.col("q") - 1).alias("p")
    return met.groupBy("key", "doc_id", "n", "template", "label", "base", "t_k", "slack", "cover", "size", "at", place).agg(F.count("*").alias("copies"))


def notices(met: DataFrame) -> DataFrame:
    """key, template, label, base, first_word, last_word, covered: the merged diagonals of ``hits`` that hold their template.

    ``covered`` is the share of the template's words in its runs. The diagonals of one text and template are ordered in one task; they are
    places of that one text.
    """
    one = Window.partitionBy("key", "template").orderBy("diagonal", "at")
    rows = met.where("template is not null").withColumn("diagonal", F.col("p") - F.col("at"))
    step = F.col("diagonal") - F.lag("diagonal").over(one)
    rows = rows.withColumn("new", F.when(step <= F.col("slack"), 0).otherwise(1)).withColumn("merged", F.sum("new").over(one))
    spans = rows.groupBy("key", "template", "label", "base", "size", "t_k", "cover", "merged").agg(
        F.collect_set("at").alias("ats"), F.min("p").alias("first_word"), (F.max(F.col("p") + F.col("t_k")) - 1).alias("last_word")
    )
    seen = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("t_k") - 1)))))
    held = (seen * 100 >= F.col("cover") * F.col("size")) & (F.col("last_word") - F.col("first_word") + 1 <= F.col("size") * 3 / 2)
    return spans.where(held).select("key", "template", "label", "base", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), (seen / F.col("size")).alias("covered"))


def scan(docs: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, notices: for each row of ``docs`` its notices, an array of label, base, first_word, last_word, covered.

    A null text has no words. Null and repeated doc_ids are kept apart by their texts; equal rows give equal rows. Columns besides doc_id and
    text are ignored, an empty table gives an empty one. A template shorter than its runs finds nothing.
    """
    given = templates(docs.sparkSession) if given is None else given
    met = hits(docs, given)
    found = notices(met).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first_word", "last_word", "label", "base", "covered"))).alias("notices"))
    each = met.where("template is null").select("key", "doc_id", "n", "copies")
    kind = found.schema["notices"].dataType
    rows = each.join(found, "key", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_words"), F.coalesce("notices", F.array().cast(kind)).alias("notices"))


def labels(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (of base phrases), base_labels, labels, score (the best covered, 0 without any)."""
    base = F.filter("notices", lambda x: x.base)
    joined = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x.label))), ",")
    starts = F.transform(base, lambda x: x.first_word)
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("notices")).alias("labels"), F.coalesce(F.array_max(F.transform("notices", lambda x: x.covered)), F.lit(0.0)).alias("score"),
    )
