"""License scans: TF-IDF cosine of lines and licence files to templates, then inheritance from directories.

Built-in functions only. A file's *headers* are its lines, its paragraphs (lines up to one without letters or digits, so
that comment marks do not matter), and from each line on as many lines of the paragraph as it takes to have the words of
each template, so that a notice is found however it is wrapped. A *licence file* (``LICENSE``, ``COPYING``, ... by name) is also compared whole, and
then with the full texts of licences as well. Vectors are sparse: only units that hold a word rare enough to matter are exploded. Each word, of a
template or not, has the inverse of its own document frequency over all files, so that a decision depends on the shares
of files that hold the words, not on the number of files.

A file without a licence of its own takes that of the licence file in its nearest ancestor directory. Directories,
not files, are joined with their ancestors' licences, so a directory that holds a third of all files is one row.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions.values import let
from parley.llm.store import own_columns, written

THRESHOLD = 0.75
LICENCE_FILES = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)(\.(txt|md|rst))?$"

# Usual notices of common licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
    ),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License",
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work, CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

Template = tuple[str, str]

#: Full texts, compared with whole licence files only.
FULL_TEXTS = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def document_frequencies(files: DataFrame) -> DataFrame:
    """(word, n): the number of files that hold each word of any file."""
    rows = files.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def template_vectors(templates: list[Template], idf: dict[str, float]) -> list[tuple[int, str, str, float]]:
    """(template, licence, word, weight) with vectors of length 1."""
    out = []
    for number, (licence, text) in enumerate(templates):
        words = words_of(text)
        raw = {w: words.count(w) * idf[w] for w in set(words)}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        out += [(number, licence, w, v / norm) for w, v in sorted(raw.items())]
    return out


def anchors_of(vectors: list[tuple[int, str, str, float]], threshold: float) -> list[str]:
    """Words of which a unit must have one to reach the threshold with any template.

    The words left out have, in every template together, a length below the threshold, which bounds the cosine of a
    unit that has only those.
    """
    left = {t: 0.0 for t, _, _, _ in vectors}
    by_word: dict[str, list[tuple[int, float]]] = {}
    for t, _, w, v in vectors:
        by_word.setdefault(w, []).append((t, v * v))
    anchors = set(by_word)
    for word in sorted(by_word, key=lambda w: (sum(v for _, v in by_word[w]) / len(by_word[w]), w)):
        if all(left[t] + v < threshold**2 for t, v in by_word[word]):
            anchors.discard(word)
            for t, v in by_word[word]:
                left[t] += v
    return sorted(anchors)


def _headers(paragraph: Column, by_length: dict[int, list[str]], anchors: list[str]) -> Column:
    """The lines of a paragraph, the paragraph and its windows as arrays of words, where they hold an anchor."""
    lines = F.filter(F.transform(F.split(paragraph, "\n"), _words), lambda ws: F.size(ws) > 0)

    def measured(ls: Column) -> Column:
        first = F.transform(ls, lambda ws: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), F.size(ws) - 1)))
        starts = F.filter(F.transform(F.flatten(first), lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
        return F.struct(
            F.flatten(ls).alias("words"), F.transform(ls, lambda ws: F.size(ws)).alias("sizes"), starts.alias("starts")
        )

    def ended(v: Column) -> Column:
        # For each word, where its line ends.
        stops = F.flatten(F.zip_with(v["starts"], v["sizes"], lambda p, n: F.array_repeat(p + n, n)))
        return F.struct(v["words"].alias("words"), v["sizes"].alias("sizes"), v["starts"].alias("starts"), stops.alias("stops"))

    def cut(v: Column) -> Column:
        words, starts, all_words = v["words"], v["starts"], F.size(v["words"])
        # Start and length in one number, which is cheap to compare.
        code = lambda start, n: start.cast("long") * 2**31 + n

        def windows(n: int, own: list[str]) -> Column:
            size = lambda p: v["stops"][F.least(p + n, all_words) - 1] - p
            near = F.filter(starts, lambda p: F.arrays_overlap(F.slice(words, p + 1, size(p)), F.lit(own)))
            return F.transform(near, lambda p: code(p, size(p)))

        parts = [windows(n, own) for n, own in by_length.items()]
        codes = F.array_distinct(
            F.concat(F.zip_with(starts, v["sizes"], code), F.array(code(F.lit(0), all_words)), *parts)
        )
        at = lambda c: F.slice(words, F.shiftright(c, 31).cast("int") + 1, (c % 2**31).cast("int"))
        return F.filter(F.transform(codes, at), lambda ws: F.arrays_overlap(ws, F.lit(anchors)))

    return let(let(let(lines, measured), ended), cut)


def matches(
    spark: SparkSession,
    files: DataFrame,
    templates: list[Template] = TEMPLATES,
    threshold: float = THRESHOLD,
    full_texts: list[Template] = FULL_TEXTS,
) -> DataFrame:
    """(path, licence, score): the best template of the units of each path that reaches the threshold.

    Ties go to the first licence by name. ``files`` has path, name and text.
    """
    vocabulary = sorted({w for _, text in [*templates, *full_texts] for w in words_of(text)})
    frequencies, total = written(document_frequencies(files), "license-words"), files.count()
    n = {r["word"]: r["n"] for r in frequencies.filter(F.col("word").isin(vocabulary)).collect()}
    idf = {w: math.log((1 + total) / (1 + n.get(w, 0))) + 1 for w in vocabulary}
    vectors = template_vectors(templates, idf)
    anchors = anchors_of(vectors, threshold)
    by_length: dict[int, list[str]] = {}
    for _, text in templates:
        own = words_of(text)
        by_length[len(own)] = sorted({*by_length.get(len(own), []), *(w for w in own if w in anchors)})
    # A line without letters and digits of any script parts two paragraphs.
    paragraphs = files.select("path", F.explode(F.split("text", r"\n[^\p{L}\p{N}]*\n")).alias("paragraph"))
    headers = paragraphs.filter(F.arrays_overlap(_words(F.col("paragraph")), F.lit(anchors))).select(
        "path", F.lit(False).alias("whole"), F.explode(_headers(F.col("paragraph"), by_length, anchors)).alias("words")
    )
    wholes = files.filter(F.col("name").rlike(LICENCE_FILES)).select(
        "path", F.lit(True).alias("whole"), _words(F.col("text")).alias("words")
    )
    known = written(
        headers.unionByName(wholes).select(F.monotonically_increasing_id().alias("unit_id"), "path", "whole", "words"),
        "license-units",
    )
    terms = (
        known.select("unit_id", "whole", F.explode("words").alias("word"))
        .groupBy("unit_id", "whole", "word")
        .agg(F.count(F.lit(1)).alias("times"))
        .join(frequencies, "word")
        .withColumn("weight", F.col("times") * (F.log((1 + total) / (1 + F.col("n"))) + 1))
    )
    norms = terms.groupBy("unit_id").agg(F.sqrt(F.sum(F.pow("weight", F.lit(2)))).alias("norm"))
    # The templates are a fixed list of a few thousand words.
    full = [(len(templates) + t, *rest) for t, *rest in template_vectors(full_texts, idf)]
    shape = "template int, licence string, word string, share double, full boolean"
    fixed = spark.createDataFrame([(*v, False) for v in vectors] + [(*v, True) for v in full], shape)
    dots = (
        terms.join(F.broadcast(fixed), "word")
        .filter(F.col("whole") | ~F.col("full"))
        .groupBy("unit_id", "template", "licence")
        .agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    )
    score = F.round(F.col("dot") / F.col("norm"), 9)
    near = dots.join(norms, "unit_id").withColumn("score", score).filter(F.col("score") >= threshold)
    close = near.join(known.select("unit_id", "path"), "unit_id")
    # The negated score first, so that one minimum takes the highest score and then the first licence by name.
    best = close.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("less"), "licence")).alias("best"))
    return best.select("path", (-F.col("best.less")).alias("score"), "best.licence")


def _ancestors(directory: Column) -> Column:
    """All directories above and the directory itself, the root as the empty text, with their depths."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")),
    )


def directory_of(path: Column) -> Column:
    return F.array_join(F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda p: p != ""), "/")


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    path_col: str = "path",
    text_col: str = "text",
    templates: list[Template] = TEMPLATES,
    threshold: float = THRESHOLD,
    full_texts: list[Template] = FULL_TEXTS,
) -> DataFrame:
    """(doc_id, path, own_license, score, license, inherited_from): one row per row of ``df``.

    ``own_license`` and ``score`` are the best match of the file itself, ``license`` that or the inherited one, and
    ``inherited_from`` the directory it comes from. NULL paths count as the empty path, NULL texts as empty; rows of
    one path are one file; files without any licence have NULLs; an empty table gives an empty result.
    Other columns of ``df`` are not read.
    """
    spark = df.sparkSession
    files = own_columns(df, doc_id=id_col, path=path_col, text=text_col).select(
        "doc_id",
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    named = files.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1))
    found = written(matches(spark, named, templates, threshold, full_texts), "licenses")
    placed = found.select(directory_of(F.col("path")).alias("directory"), "path", "score", "licence")
    in_files = placed.filter(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENCE_FILES))
    # Of several licence files in a directory the best match counts, then the first by licence name.
    ranked = Window.partitionBy("directory").orderBy(F.desc("score"), "licence", "path")
    offered = (
        in_files.withColumn("rank", F.row_number().over(ranked))
        .filter("rank = 1")
        .select(F.col("directory").alias("above"), F.col("licence").alias("offered"))
    )
    directories = files.select(directory_of(F.col("path")).alias("directory")).distinct()
    nearest = (
        directories.select("directory", F.inline(_ancestors(F.col("directory"))))
        .join(offered, "above")
        .groupBy("directory")
        .agg(F.max(F.struct("depth", "above", "offered")).alias("near"))
        .select("directory", "near.above", "near.offered")
    )
    rows = files.select("doc_id", "path", directory_of(F.col("path")).alias("directory"))
    own = F.col("licence").isNotNull()
    return (
        rows.join(found, "path", "left")
        .join(nearest, "directory", "left")
        .select(
            "doc_id",
            "path",
            F.col("licence").alias("own_license"),
            "score",
            F.coalesce("licence", "offered").alias("license"),
            F.when(~own, F.col("above")).alias("inherited_from"),
        )
    )
