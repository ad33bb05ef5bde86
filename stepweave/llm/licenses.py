"""Licence scans by diagonal voting, in DataFrame functions alone.

Each text becomes words, and each `k` consecutive words a rolling hash with a place. One broadcast join brings all these hashes to the
places of the same hash in the templates (a fixed table, written below), and each match is verified by the words themselves. A match votes
for the diagonal place - template place. The base phrases need all votes of a diagonal: their words then stand consecutively. The longer templates need
SEED votes on a diagonal; seeds not more than GAP diagonals apart (words put in or left out) are merged, and a span
is verified if it covers COVER of the template's places.

One scan and one shuffle, of matches alone: partial aggregation counts votes before it. A row for each text comes along
as the match of one mark that every text has.

Null texts count as empty: no words, no places, no labels, score 0. Repeated rows each give a row. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrase and label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Openings of public licences and of their usual notices, and the method's own labels.
TEMPLATES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Words of a hash: no more than the shortest base phrase has.
K = 2
SEED, GAP, COVER = 3, 4, 0.7
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The hash that each text has once, beside those of its words.
_MARK = 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters and digits, and of other than ASCII characters."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAKS), "")


def _grams(column: str, k: int) -> Column:
    """(hash, words) of each k consecutive words."""
    some = ["x", *[f"get({column}, i + {j})" for j in range(1, k)]]
    return F.expr(f"slice(transform({column}, (x, i) -> struct(xxhash64({', '.join(some)}) as hash, concat_ws(' ', {', '.join(some)}) as gram)), 1, greatest(size({column}) - {k - 1}, 0))")


def template_table(spark: SparkSession, k: int = K) -> DataFrame:
    """(hash, gram, template, at, size, base, label): a row for each place of each template, and the mark."""
    rows = [(i, phrase, label, True) for i, (phrase, label) in enumerate(BASE.items())]
    rows += [(len(rows) + i, text, label, False) for i, (label, text) in enumerate(TEMPLATES)]
    if k > min(len(phrase.split()) for _, phrase, _, _ in rows):
        raise ValueError(f"a phrase has fewer than {k} words")
    table = spark.createDataFrame(rows, "template int, phrase string, label string, base boolean").withColumn("w", words(F.col("phrase")))
    table = table.select("template", (F.size("w") - (k - 1)).alias("size"), "base", "label", F.posexplode(_grams("w", k)).alias("at", "g"))
    mark = spark.createDataFrame([(-1, 0, False, "", 0, _MARK, "")], "template int, size int, base boolean, label string, at int, hash long, gram string")
    return table.select("template", "size", "base", "label", "at", "g.hash", "g.gram").union(mark)


def license_scan(docs: DataFrame, seed: int = SEED, gap: int = GAP, cover: float = COVER, k: int = K) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    first_word and last_word: of the base places. score: 1 with a base place, else the largest covered share of a verified
    template, else 0. spans: (label, first word, last word, covered share) of the verified templates."""
    spark = docs.sparkSession
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    mark = F.struct(F.lit(_MARK).cast("long").alias("hash"), F.lit("").alias("gram"))
    grams = texts.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.array_append(_grams("w", k), mark)).alias("place", "g"))
    grams = grams.select("row", "doc_id", "n_words", "place", "g.hash", F.col("g.gram").alias("own_gram"))
    votes = grams.join(F.broadcast(template_table(spark, k)), "hash").where("own_gram = gram")
    votes = votes.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("place") - F.col("at")).otherwise(0))
    lines = votes.groupBy("row", "doc_id", "n_words", "template", "size", "base", "label", "diagonal").agg(F.collect_set("at").alias("ats"))
    votes_of = F.size("ats")
    lines = lines.where((F.col("template") < 0) | (F.col("base") & (votes_of == F.col("size"))) | (~F.col("base") & (votes_of >= seed)))

    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along)) > gap, F.lit(True)) | F.col("base")
    lines = lines.withColumn("span", F.sum(apart.cast("int")).over(along))
    spans = lines.groupBy("row", "doc_id", "n_words", "template", "size", "base", "label", "span").agg(
        F.min("diagonal").alias("start"),
        F.min(F.col("diagonal") + F.array_min("ats")).cast("long").alias("first"),
        F.max(F.col("diagonal") + F.array_max("ats") + k - 1).cast("long").alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("ats")))) / F.greatest("size", F.lit(1))).alias("covered"),
    )
    own, known = ~F.col("base") & (F.col("template") >= 0) & (F.col("covered") >= cover), F.col("base")
    found = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(known).alias("n_base"),
        F.min(F.when(known, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(known, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(known, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(known | own, F.col("label"))).alias("labels"),
        F.max(F.when(known, F.lit(1.0)).when(own, F.col("covered")).otherwise(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(own, F.struct("first", "last", "label", "covered")))).alias("spans"),
    )
    joined = [F.array_join(F.array_sort(c), ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", *joined, "score", "spans")
