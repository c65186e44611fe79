"""License scan by a positional rare-token index, in DataFrame expressions only.

Every file's words that belong to a notice template are kept with their positions.  A template is indexed under
the rarest word, by inverse document frequency over all files, of the phrases that it must have.  In a file that has
them, the file's own rarest words of the template are looked up in its postings; the starts they imply (position in
the file less position in the template) are intersected, and a start counts if the key phrases stand where they must.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

# Base phrases and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

# Notices as commonly written, with the phrases that must stand in them.
TEMPLATES = {
    "notice:mit": ("released under the mit license", ["mit license"]),
    "notice:apache-2.0": ("licensed under the apache license version 2 0", ["apache license"]),
    "notice:gpl": ("licensed under the gnu general public license version", ["gnu general public license"]),
    "notice:lgpl": ("licensed under the gnu lesser general public license version", ["lesser general public license"]),
    "notice:cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "notice:cc-by": ("licensed under a creative commons attribution license", ["creative commons attribution"]),
    "notice:reserved": ("all rights reserved", ["all rights reserved"]),
    "notice:bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        ["source and binary forms"],
    ),
    "notice:mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        ["permission is hereby granted"],
    ),
    "notice:mpl": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at",
        ["mozilla public license"],
    ),
    "notice:isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ["permission to use copy"],
    ),
    "notice:apache-text": (
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        ["except in compliance with the license"],
    ),
    "notice:gpl-text": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version of the license or at your option any later version",
        ["free software foundation"],
    ),
    "notice:zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose",
        ["permission is granted to anyone"],
    ),
    "notice:unlicense": ("this is free and unencumbered software released into the public domain", ["unencumbered software"]),
}
# Words too common to index.
COMMON = set("the of and in to is for with or this a by on as are that it be any all under 0 2 4".split())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A file's rarest words of a template, whose implied starts are intersected.
ANCHORS = 3


def vocabulary(templates: dict = TEMPLATES) -> list[str]:
    own = {w for text, _ in templates.values() for w in text.split()} | {w for p in BASE for w in p}
    return sorted(own - COMMON)


def positions(docs: DataFrame, templates: dict = TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, hits, present): hits are the indexed words of a text in order, as (i, w); present are
    their different words; row numbers the rows.

    lower() differs from folding A-Z alone only in characters outside ASCII, of which none but the
    Kelvin sign becomes an ASCII letter; k is in no base phrase.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    known = vocabulary(templates)
    marked = F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(i.alias("i"), w.alias("w"))))
    hits = docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(marked, lambda x: x.isNotNull()).alias("hits"))
    return hits.select(F.monotonically_increasing_id().alias("row"), "*", F.array_distinct(F.transform("hits", lambda h: h["w"])).alias("present"))


def inverse_frequencies(hits: DataFrame, templates: dict = TEMPLATES) -> dict[str, float]:
    """IDF of each indexed word over all files; the result is as long as the vocabulary."""
    n = hits.count()
    seen = hits.select(F.explode("present").alias("w")).groupBy("w").count().collect()
    df = {r["w"]: r["count"] for r in seen}
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary(templates)}


POSTING = "array<struct<w: string, at: int>>"


def posting_lists(spark: SparkSession, templates: dict, idf: dict[str, float]) -> DataFrame:
    """The index, a row per template under the rarest word of its key phrases: (key, label, rare, postings, must).

    postings are its indexed words with their places, must those of its key phrases, rare its different words from
    the highest IDF down.
    """
    rows = []
    for label, (text, phrases) in templates.items():
        words = text.split()
        postings = [(w, i) for i, w in enumerate(words) if w not in COMMON]
        must = []
        for phrase in phrases:
            own = phrase.split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            must += [(w, at + k) for k, w in enumerate(own) if w not in COMMON]
        rare = sorted({w for w, _ in postings}, key=lambda w: (-idf[w], w))
        rows.append((min((w for w, _ in must), key=rare.index), label, rare, postings, must))
    return spark.createDataFrame(rows, f"key string, label string, rare array<string>, postings {POSTING}, must {POSTING}")


def _places(word: Column) -> Column:
    """The places of a word in a file, in one pass over its hits."""
    return F.transform(F.filter("hits", lambda h: h["w"] == word), lambda h: h["i"])


def _starts(word: Column) -> Column:
    """The template starts that the occurrences of a word imply, from every place that it has in the template."""
    own = F.filter("postings", lambda p: p["w"] == word)
    return F.coalesce(F.flatten(F.transform(own, lambda p: F.transform(_places(word), lambda i: i - p["at"]))), F.array().cast("array<int>"))


def template_matches(hits: DataFrame, index: DataFrame) -> DataFrame:
    """(row, label, score): templates whose start two of the file's rarest words agree on, or the only one that it
    has, and whose key phrases stand there; score is the largest share of its indexed words that stand at one start.

    Starts are intersected as sets, so a file's work grows with its hits times the template's words.
    """
    keyed = hits.filter(F.size("hits") > 0).select("row", "hits", "present", F.explode("present").alias("key"))
    near = keyed.join(F.broadcast(index), "key")  # a row per template
    near = near.filter(F.size(F.array_except(F.transform("must", lambda p: p["w"]), "present")) == 0)
    own = F.slice(F.filter("rare", lambda w: F.array_contains("present", w)), 1, ANCHORS)
    near = near.withColumn("anchors", own)
    near = near.select("row", "label", "hits", "postings", "must", F.size("anchors").alias("n"), *[_starts(F.get("anchors", F.lit(k))).alias(f"s{k}") for k in range(ANCHORS)])
    pairs = [F.array_intersect(f"s{j}", f"s{k}") for k in range(ANCHORS) for j in range(k)]
    found = F.when(F.col("n") == 1, F.array_distinct("s0")).otherwise(reduce(F.array_union, pairs))
    stands = F.aggregate("must", found, lambda left, p: F.array_intersect(left, F.transform(_places(p["w"]), lambda i: i - p["at"])))
    near = near.withColumn("starts", stands).filter(F.size("starts") > 0)
    every = F.flatten(F.transform("postings", lambda p: F.array_intersect("starts", F.transform(_places(p["w"]), lambda i: i - p["at"]))))
    run = lambda x, s: F.struct(s.alias("s"), F.when(x["s"] == s, x["n"] + 1).otherwise(1).alias("n"), F.greatest(x["most"], F.when(x["s"] == s, x["n"] + 1).otherwise(1)).alias("most"))
    none = F.struct(F.lit(None).cast("int").alias("s"), F.lit(0).alias("n"), F.lit(0).alias("most"))
    most = F.aggregate(F.array_sort(every), none, run, lambda x: x["most"])
    return near.select("row", "label", (most / F.size("postings")).alias("score"))


def base_places(phrase: tuple) -> Column:
    """Word numbers at which a phrase's words stand one after another."""
    here = lambda h, j: reduce(lambda a, b: a & b, [(F.get("hits", j + k)["w"] == w) & (F.get("hits", j + k)["i"] == h["i"] + k) for k, w in enumerate(phrase)])
    marked = F.transform("hits", lambda h, j: F.when(here(h, j), h["i"]))
    return F.filter(marked, lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame, templates: dict = TEMPLATES) -> DataFrame:
    """Base phrase places, labels and a score per file.

    Null and empty texts have no words, null word numbers, empty labels and score 0.  Repeated rows each
    get their row; an empty table gives none.  What is broadcast is the index, as large as the templates; texts
    don't leave their partition, only the words' counts, the labels found, and the rows' numbers do.
    """
    hits = written(positions(docs, templates))
    index = posting_lists(docs.sparkSession, templates, inverse_frequencies(hits, templates))
    found = template_matches(hits, index).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    places = hits
    for phrase, label in BASE.items():
        places = places.withColumn(f"at_{label}", F.when(F.size("hits") > 0, base_places(phrase)).otherwise(F.array().cast("array<int>")))
    base = F.array(*[F.when(F.size(f"at_{x}") > 0, F.lit(x)) for x in BASE.values()])
    every = F.concat(*[F.col(f"at_{label}") for label in BASE.values()])
    places = places.select("row", "doc_id", "n_words", every.alias("places"), F.array_compact(base).alias("base"))
    places = places.select("row", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), "base")
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    scored = places.join(found, "row", "left")
    return scored.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 0.5).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document, as scan_licenses() has them."""
    return scan_licenses(documents(spark, sf_dir))
