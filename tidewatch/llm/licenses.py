"""License scans by diagonal voting.

Every run of ``GRAM`` words of a document is joined, by hash and then by its words, with the places of
the same words in the license templates. A match votes for a diagonal, the word at which the
template would begin. Neighbouring diagonals of one template are merged, so that a few words put in
or left out do not split a license. A span is verified if enough of the template's runs are
matched in it: all of a phrase, and ``covered`` of a longer text.

All of it is DataFrame operations. The texts are read and split once: a document that matches nothing
travels as one marker row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.tables import ascii_lower

GRAM = 3
COVERED = 0.7
NEIGHBOURS = 3  # diagonals this near are merged
PHRASE_WORDS = 8  # templates up to this length must match in full
SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Base phrases and their labels: fixed values.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Wordings of licenses, from their public texts: fixed values.
WORDINGS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "cc by nd"),
)


def words_of(text: Column) -> Column:
    """Words in lower case: runs of anything but ASCII signs and controls."""
    return F.filter(F.split(ascii_lower(text), SPLIT, -1), lambda w: w != "")


def _grams(words: str) -> Column:
    return F.expr(
        f"transform(if(size({words}) >= {GRAM}, sequence(0, size({words}) - {GRAM}), cast(array() as array<int>)),"
        f" i -> concat_ws(' ', {', '.join(f'{words}[i + {j}]' for j in range(GRAM))}))"
    )


def templates(spark: SparkSession) -> DataFrame:
    """``template, label, base, text`` of the built-in templates: a few dozen rows, whatever the corpus."""
    listed = [(label, True, text) for label, text in BASE] + [(label, False, text) for label, text in WORDINGS]
    rows = [F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(b).alias("base"), F.lit(t).alias("text"))
            for i, (a, b, t) in enumerate(listed)]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def template_grams(rows: DataFrame) -> DataFrame:
    """``template, label, base, hash, gram, place, grams`` of every run of words of the templates."""
    split = rows.withColumn("words", words_of(F.col("text")))
    listed = split.select("template", "label", "base", F.size("words").alias("size"), F.posexplode(_grams("words")).alias("place", "gram"))
    return listed.select(
        "template", "label", "base", F.xxhash64("gram").alias("hash"), "gram", "place",
        (F.col("size") - GRAM + 1).alias("grams"), (F.col("size") <= PHRASE_WORDS).alias("phrase"),
    )


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Hits per diagonal: ``_row, doc_id, n_words, template, ..., diagonal, places``; a document without
    a match has one row with null ``template``."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words_of(F.col("text")).alias("_words"))
    listed = rows.select("_row", "doc_id", F.size("_words").cast("long").alias("n_words"), F.posexplode_outer(_grams("_words")).alias("_at", "_gram"))
    hashed = listed.withColumn("_hash", F.xxhash64("_gram"))
    # The templates are a fixed list, so their size is known.
    side = F.broadcast(grams)
    met = hashed.join(side, (hashed["_hash"] == side["hash"]) & (hashed["_gram"] == side["gram"]), "left")
    met = met.where(F.col("template").isNotNull() | (F.coalesce("_at", F.lit(0)) == 0))
    by = ["_row", "doc_id", "n_words", "template", "label", "base", "grams", "phrase"]
    return met.groupBy(*by, (F.col("_at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (``doc_id, text``): ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``.

    ``n_base`` counts the places where a base phrase stands, ``first_word`` and ``last_word`` are the
    smallest and largest word it starts at (null without one). ``labels`` has the base labels and
    those of verified spans; ``score`` is the largest part of a template that is matched, 1 where a
    base phrase stands. Null text counts as empty: no words, no labels, score 0. Repeated rows
    each give their row; other columns are ignored.
    """
    found = votes(docs, template_grams(templates(docs.sparkSession)))
    full = F.size("places") == F.col("grams")
    along = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > NEIGHBOURS
    merged = found.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    merged = merged.withColumn("_span", F.sum("_new").over(along))
    by = ["_row", "doc_id", "n_words", "template", "label", "base", "grams", "phrase", "_span"]
    spans = merged.groupBy(*by).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"),
        F.sum(full.cast("long")).alias("places_full"),
        F.min(F.when(full, F.col("diagonal"))).alias("first"),
        F.max(F.when(full, F.col("diagonal"))).alias("last"),
    )
    part = F.least(F.col("matched") / F.col("grams"), F.lit(1.0))
    verified = F.when(F.col("phrase") | F.col("base"), F.col("places_full") > 0).otherwise(part >= COVERED)
    base = F.col("base") & (F.col("places_full") > 0)
    names = lambda labels: F.array_join(F.array_sort(labels), ",")
    return spans.groupBy("_row", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("places_full"))), F.lit(0)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        names(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        names(F.collect_set(F.when(verified, F.col("label")))).alias("labels"),
        F.round(F.coalesce(F.max(part), F.lit(0.0)), 6).alias("score"),
    ).drop("_row")
