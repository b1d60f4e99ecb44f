"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines that speak of a license are compared with the templates, each distinct line
once. A file takes the license of its own best line; a file without one takes that of
the licence file in the nearest directory above it. All of it is joins and
aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import staged

#: What licenses say of themselves. Any number of texts for a license.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
]
TEMPLATES += [(x, f"SPDX-License-Identifier: {x}") for x in sorted({x for x, _ in TEMPLATES})]
#: A line without any of these (in lower case) says nothing about licenses.
SPEAKS = "licen[cs]e|copyright|spdx|redistribution|permission is hereby|public domain"
#: Names of files whose license holds for their directory.
LICENCE_FILE = "(?i)^(licen[cs]e|copying|notice|unlicense)"
#: Bytes of templates that may be sent to every task.
MOST = 4 << 20
SIMILAR = 0.6


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def template_terms(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(license, template, term, n); refused beyond a size that can be broadcast."""
    if sum(len(a) + len(b) for a, b in templates) > MOST:
        raise ValueError("the templates are too large to send to every task")
    rows = spark.createDataFrame([(a, i, b) for i, (a, b) in enumerate(templates)], "license string, template int, body string")
    return rows.select("license", "template", F.explode(words(F.col("body"))).alias("term")).groupBy("license", "template", "term").agg(F.count("*").alias("n"))


def line_terms(lines: DataFrame) -> DataFrame:
    """(line, term, n) of lines, given with the digest ``line`` and the ``content``, which no later row carries."""
    return lines.select("line", F.explode(words(F.col("content"))).alias("term")).groupBy("line", "term").agg(F.count("*").alias("n"))


def term_weights(files: DataFrame, tokens: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """(term, idf) of all terms of the lines and the templates, over all files.

    Every file counts a term once; each task adds up its own files first.
    """
    total = float(files.count())
    seen = files.select(F.explode(F.array_distinct(words(F.coalesce(text, F.lit(""))))).alias("term"))
    counted = seen.groupBy("term").agg(F.count("*").alias("files"))
    wanted = tokens.select("term").union(terms.select("term")).distinct()
    idf = F.log((1 + F.lit(total)) / (1 + F.coalesce("files", F.lit(0)))) + 1
    return wanted.join(counted, "term", "left").select("term", idf.alias("idf"))


def line_licenses(tokens: DataFrame, terms: DataFrame, idf: DataFrame) -> DataFrame:
    """(line, license, cosine): the most similar template of each distinct line."""
    weight = F.col("n") * F.col("idf")
    weighted = staged(tokens.join(idf, "term").select("line", "term", weight.alias("w")), "weighted")
    norms = weighted.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    own = F.broadcast(terms).join(idf, "term").select("license", "template", "term", weight.alias("tw"))
    lengths = own.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("length"))
    unit = F.broadcast(own.join(lengths, "template").select("license", "template", "term", (F.col("tw") / F.col("length")).alias("tw")))
    dots = weighted.join(unit, "term").groupBy("line", "license", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "line").withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6))
    # the greatest cosine, then the first license by name
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "license"))
    return scored.groupBy("line").agg(best.alias("best")).select("line", "best.license", (-F.col("best.minus")).alias("cosine"))


def scan_licenses(
    files: DataFrame, path: str = "path", text: str = "text", templates: list[tuple[str, str]] | None = None, similar: float = SIMILAR,
) -> DataFrame:
    """(path, own_license, cosine, license, origin, inherited_from), a row for each file.

    ``own_license`` is that of the line of the whole text most similar to a template,
    if the cosine is at least ``similar`` (else null, as for null or empty texts);
    equal cosines go to the first license by name. ``origin`` is "own", "inherited"
    or null. A licence file (named LICENSE, COPYING, NOTICE or so) with a license of
    its own lends it to all files without one below its directory, unless a nearer
    directory lends another; of several in one directory the most similar counts,
    then the first license by name. A null path lies in no directory. Repeated rows
    stay repeated; other columns are dropped, so their names do not matter.
    """
    spark = files.sparkSession
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    terms = template_terms(spark, TEMPLATES if templates is None else templates)
    speaking = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(SPEAKS))
    # a digest of path and lines names a file: those that share it agree in all that follows;
    # silent files are spread by path and text, as they meet nothing
    named = F.md5(F.concat_ws("\n", F.coalesce("path", F.lit("\0")), "lines", F.when(F.size("lines") == 0, F.col("mark")))).alias("file")
    lines = rows.select(
        "path", F.coalesce(F.array_distinct(speaking), F.array().cast("array<string>")).alias("lines"), F.xxhash64("text").cast("string").alias("mark"))
    keyed = staged(lines.select("path", named, "lines"), "speaking")  # the texts are read for it once
    said = keyed.where(F.size("lines") > 0)
    contents = said.select(F.explode("lines").alias("content")).distinct().select(F.md5("content").alias("line"), "content")
    tokens = line_terms(contents)
    idf = staged(term_weights(rows, tokens, terms, "text"), "idf")
    scores = line_licenses(tokens, terms, idf)
    scores = scores.where(F.col("cosine") >= similar)
    digests = said.select("file", F.explode(F.transform("lines", lambda x: F.md5(x))).alias("line")).distinct()
    own = digests.join(scores, "line").groupBy("file").agg(F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best")).select(
        "file", F.col("best.license").alias("own_license"), (-F.col("best.minus")).alias("cosine"))
    held = keyed.select("path", "file").join(own, "file", "left")
    held = held.select("path", "own_license", "cosine", F.regexp_extract("path", "^(.*)/", 1).alias("directory"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    lent = held.where(F.col("name").rlike(LICENCE_FILE) & F.col("own_license").isNotNull()).groupBy(F.col("directory").alias("lender")).agg(
        F.min(F.struct((-F.col("cosine")).alias("minus"), F.col("own_license").alias("license"))).alias("best")).select("lender", F.col("best.license").alias("lent"))
    parts = F.split("directory", "/")
    above = held.select("directory").where(F.col("directory").isNotNull()).distinct().select(
        "directory", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))).alias("lender"))
    nearest = above.distinct().join(lent, "lender").groupBy(F.col("directory").alias("_directory")).agg(
        F.max(F.struct(F.length("lender").alias("depth"), "lender", "lent")).alias("best")).select("_directory", F.col("best.lender").alias("lender"), F.col("best.lent").alias("lent"))
    found = held.join(nearest, F.col("directory") == F.col("_directory"), "left")
    inherits = F.col("own_license").isNull() & F.col("lent").isNotNull()
    return found.select(
        "path", "own_license", "cosine", F.coalesce("own_license", "lent").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("lender")).alias("inherited_from"))
