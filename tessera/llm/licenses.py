"""License scans by diagonal voting, DataFrame functions only.

All rolling word k-grams of the documents are joined with the k-grams of
license templates. Each match votes for the diagonal (word position minus
template position) of its document and template. Phrases must stand whole: a
diagonal with a vote from each k-gram of a phrase is a place of it. For the
longer templates neighbouring diagonals (``NEIGHBOUR`` words apart at most,
so that a few inserted or lost words do no harm) are merged, and a merged span
is verified: its k-grams are read in the order of the words, and those that
follow one another in the template too must be ``COVERAGE`` of its k-grams,
with no more foreign words between the first and the last than may be missing.

The templates are a fixed list in this module, so their k-grams are
broadcast. A frequent license adds rows in proportion to its occurrences.
k-gram equality is checked on the words, not on hashes alone.

Defined results: a null or empty text has no words and no labels (empty
strings, score 0); each repeated row gives its row; null ids are kept; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_words, pick, row_key, table

GRAM = 3
NEIGHBOUR = 6
#: Least share of a template's k-grams in a verified span.
COVERAGE = 0.6
#: Templates of fewer k-grams must be held whole.
SHORT = 16
# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Well-known license notices and their labels.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-3": "licensed under the GNU General Public License, version 3",
    "gpl-2": "licensed under the GNU General Public License, version 2",
    "lgpl": "the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by": "licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "all rights reserved",
}


def _gram_columns(words: str, pos):
    return [F.get(words, pos + i).alias(f"g{i}") for i in range(GRAM)]


def template_grams(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str]) -> DataFrame:
    """hash, words, template number, label, phrase flag, position, number of k-grams."""
    rows = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in templates.items()]
    listed = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(t).alias("text"), F.lit(p).alias("phrase")) for i, (a, t, p) in enumerate(rows)])
    known = spark.range(1).select(F.inline(listed)).select("template", "label", "phrase", ascii_words(F.col("text")).alias("words"))
    known = known.select("*", (F.size("words") - GRAM + 1).alias("grams"), F.explode(F.sequence(F.lit(0), F.size("words") - GRAM)).alias("tpos"))
    known = known.select("template", "label", "phrase", "grams", "tpos", *_gram_columns("words", F.col("tpos")))
    return known.withColumn("hash", F.xxhash64(*[f"g{i}" for i in range(GRAM)]))


def votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Distinct matches of k-grams: document, template, positions and diagonal. docs: doc_id, key, words."""
    own = docs.select("doc_id", "key", "words", F.posexplode_outer("words").alias("pos", "word"))
    own = own.where(F.col("pos") + GRAM <= F.size("words"))
    own = own.select("doc_id", "key", "pos", *_gram_columns("words", F.col("pos")))
    own = own.withColumn("hash", F.xxhash64(*[f"g{i}" for i in range(GRAM)]))
    joined = own.join(F.broadcast(grams), ["hash", *[f"g{i}" for i in range(GRAM)]])
    diagonal = (F.col("pos") - F.col("tpos")).alias("diagonal")
    return joined.select("doc_id", "key", "template", "label", "phrase", "grams", "pos", "tpos", diagonal)


def scan(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    own = pick(docs, doc_id="doc_id", text="text").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("key"), ascii_words(F.col("text")).alias("words"))
    found = votes(own, template_grams(docs.sparkSession, phrases, templates))
    by = ["doc_id", "key", "template", "label", "phrase", "grams"]
    # a diagonal's votes; repeated rows of a document vote once
    lines = found.groupBy(*by, "diagonal").agg(F.collect_set("tpos").alias("held"))
    gap = F.col("diagonal") - F.lag("diagonal").over(Window.partitionBy(*by).orderBy("diagonal"))
    new = F.when(F.col("phrase") | gap.isNull() | (gap > NEIGHBOUR), 1).otherwise(0)
    cluster = F.sum(new).over(Window.partitionBy(*by).orderBy("diagonal").rowsBetween(Window.unboundedPreceding, 0))
    votes_ = F.flatten(F.collect_list(F.transform("held", lambda t: F.struct((t + F.col("diagonal")).alias("pos"), t.alias("tpos")))))
    spans = lines.withColumn("cluster", cluster).groupBy(*by, "cluster").agg(F.min("diagonal").alias("start"), F.array_sort(votes_).alias("votes"))
    # votes by word: those that go on in the template after the last one that did
    read = F.aggregate(
        "votes", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last")),
        lambda a, v: F.when(v["tpos"] > a["last"], F.struct((a["n"] + 1).alias("n"), v["tpos"].alias("last"))).otherwise(a), lambda a: a["n"],
    )
    wide = F.element_at("votes", -1)["pos"] - F.get("votes", F.lit(0))["pos"] + GRAM
    spans = spans.withColumns({"share": read / F.col("grams"), "whole": wide <= (2 - COVERAGE) * (F.col("grams") + GRAM - 1)})
    place = F.col("phrase") & (F.col("share") == 1)
    named = place | (~F.col("phrase") & F.col("whole") & (F.col("share") >= F.when(F.col("grams") < SHORT, 1.0).otherwise(COVERAGE)))
    per = spans.groupBy("doc_id", "key").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(named, F.col("label")))), ",").alias("labels"), F.max("share").alias("score"),
    )
    per = per.withColumnsRenamed({"doc_id": "hit_doc", "key": "hit_key"})
    counts = own.select("doc_id", "key", F.size("words").cast("long").alias("n_words"))
    joined = counts.join(per, counts.doc_id.eqNullSafe(per.hit_doc) & (counts.key == per.hit_key), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of all documents; nulls, repeats and empty tables as the module states."""
    return scan(table(spark, sf_dir, "documents"))
