"""License scan by diagonal voting.

All rolling word pairs of all texts are joined (in Spark, by 64-bit hash) with the positions of the same
pairs in the templates. A hit at word ``p`` of a text and ``q`` of a template votes for the diagonal p - q.
Votes are aggregated for each (text, template, diagonal). A phrase stands where its diagonal has the votes of
all its pairs. For notices, neighbouring diagonals are merged: words left out or put in move the rest to another one. All
diagonals that lie within SPREAD of each other stand together in one of two overlapping ranges. A place is verified by the
words of its span: the longest chain of hits whose words go on in both the text and the template, where each pair of the
template counts once, has to cover at least COVER of its pairs.

Templates are this module's fixed text, so the side that is broadcast has a fixed size. A hit needs a second, independent
64-bit hash of its pair. Hits of one place are at most 2 * SPREAD times the template's pairs, however often a text repeats them.

Words are maximal runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. Defined results: a null
or empty text has no words, empty labels and score 0; repeated rows and null ids are kept as they are;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .words import gram_hashes, hash_words

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Sentences of public license notices and their labels.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved. No part of this publication may be reproduced or transmitted in any form",
}
SPREAD, COVER, K = 8, 0.6, 2
#: Pairs in one row of the exploded side.
ROW = 1 << 15
_GRAMS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("at", pa.int64()), ("h", pa.list_(pa.int64())), ("g", pa.list_(pa.int64()))])
_SPAN = pa.schema([("uid", pa.int64()), ("label", pa.string()), ("phrase", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("cover", pa.float64())])


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """(h, g, template, label, phrase, size, q): the pairs of all templates (label, text, is a phrase)."""
    rows = []
    for t, (label, text, phrase) in enumerate(templates):
        (_, _, one, _), (_, _, two, _) = (next(iter(hash_words(pa.array([text]), seed))) for seed in (1, 7))
        h, g = (gram_hashes(x, K, seed).view(np.int64).tolist() for x, seed in ((one, 1), (two, 7)))
        rows += [(a, b, t, label, phrase, len(h), q) for q, (a, b) in enumerate(zip(h, g, strict=True))]
    return spark.createDataFrame(rows, "h long, tg long, template int, label string, phrase boolean, size int, q int")


def _grams(batches):
    for b in batches:
        uid, doc = b.column(0), b.column(1)
        for (i, k, one, before), (_, _, two, _) in zip(hash_words(b.column(2), 1), hash_words(b.column(2), 7), strict=True):
            h, g = gram_hashes(one, K, 1).view(np.int64), gram_hashes(two, K, 7).view(np.int64)
            n = np.diff(before)
            rows = [(r, a, min(a + ROW, int(before[r + 1]) - K + 1)) for r in range(k - i) for a in range(int(before[r]), max(int(before[r]) + 1, int(before[r + 1]) - K + 1), ROW)]
            row, first, last = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            size = np.maximum(last - first, 0)
            cuts = np.r_[0, np.cumsum(size)]
            where = np.repeat(first - cuts[:-1], size) + np.arange(cuts[-1])
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[where])) for x in (h, g)]
            take = pa.array(row + i)
            yield shared.batch(_GRAMS, uid.take(take), doc.take(take), n[row], first - before[row], *lists)


def longest_chain(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (p, q) pairs a longest run in which both grow."""
    tops: list[int] = []  # the smallest last q of a chain of each length
    ends: list[int] = []  # where it stands in ``order``
    order = sorted(set(hits), key=lambda h: (h[0], -h[1]))
    back = []
    for i, (_, q) in enumerate(order):
        at = bisect.bisect_left(tops, q)
        back.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [q], [i]
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append(order[i])
        i = back[i]
    return chain[::-1]


def _verified(batches):
    """Spans of the places whose chain covers enough of the template."""
    for b in batches:
        rows = []
        for uid, label, size, hits in zip(*(c.to_pylist() for c in b.columns), strict=True):
            chain = longest_chain([(h["p"], h["q"]) for h in hits])
            if len(chain) >= COVER * size - 1e-9:
                rows.append((uid, label, False, chain[0][0], chain[-1][0] + K - chain[0][0], len(chain) / size))
        if rows:
            yield shared.batch(_SPAN, *zip(*rows, strict=True))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts has (uid, doc_id, n_words); spans has (uid, label, phrase, first_word, n_words, cover) of each place found."""
    spark = docs.sparkSession
    shared.ship(spark)
    templates = [(label, text, True) for text, label in phrases.items()] + [(label, text, False) for label, text in notices.items()]
    grams = template_grams(spark, templates)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.mapInArrow(_grams, "uid long, doc_id long, n_words long, at long, h array<long>, g array<long>")
    pairs = rows.select("uid", "doc_id", "n_words", "at", "g", F.posexplode_outer("h").alias("i", "h"))
    hits = pairs.join(F.broadcast(grams.select("h", "tg", "template", "q")), "h", "left")
    sure = F.col("template").isNotNull() & (F.element_at("g", F.col("i") + 1) == F.col("tg"))
    one_each = (F.col("at") == 0) & (F.coalesce("i", F.lit(0)) == 0)  # texts without hits keep a row
    hits = hits.where(F.coalesce(sure, F.lit(False)) | one_each)
    hits = shared.materialise(hits.select("uid", "doc_id", "n_words", F.when(sure, F.col("template")).alias("template"), F.when(sure, F.col("at") + F.col("i")).alias("p"), F.when(sure, F.col("q")).alias("q")))
    texts = hits.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"))
    about = F.broadcast(grams.select("template", "label", "phrase", "size").distinct())
    known = hits.where("template is not null").withColumn("diagonal", F.col("p") - F.col("q")).join(about, "template")
    whole = known.where("phrase").groupBy("uid", "template", "diagonal", "label", "phrase", "size").agg(F.count("q").alias("votes")).where("votes = size")
    places = whole.select("uid", "label", "phrase", F.col("diagonal").alias("first_word"), (F.col("size") + K - 1).cast("long").alias("n_words"), F.lit(1.0).alias("cover"))
    part = F.floor(F.col("diagonal") / SPREAD)
    near = known.where("not phrase").withColumn("part", F.explode(F.array(part, part + 1)))
    near = near.groupBy("uid", "template", "part", "label", "size").agg(F.collect_set(F.struct("p", "q")).alias("hits"))
    near = near.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["q"]))) >= COVER * F.col("size") - 1e-9)
    found = near.select("uid", "label", "size", "hits").mapInArrow(_verified, "uid long, label string, phrase boolean, first_word long, n_words long, cover double")
    return texts, places.unionByName(found.dropDuplicates(["uid", "label", "first_word", "n_words"]))


def license_labels(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts, spans = scan(docs)
    found = spans.groupBy("uid").agg(
        F.count(F.when(F.col("phrase"), 1)).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first_word"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    out = texts.join(found, "uid", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
