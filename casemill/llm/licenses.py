"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A file offers its lines (its headers among them) and, if its name is that of a licence file, its whole text. Only lines
that cannot reach the threshold are left out: with t the share of a template's squared weights that a line's terms hold,
its cosine is at most sqrt(t), so it must hold one of so many of the template's terms that the others have less than that.
Each offer is compared with every template by the cosine of sparse TF-IDF vectors; the best one above the threshold is the
file's licence. A directory has the licence of its licence files, and a file without one of its own takes that of its
nearest ancestor directory, found by joining paths level by level. All is DataFrame functions: offers are cut and counted
inside the row, and joins move terms of offers, directories and paths, never texts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions.arrays import run_lengths
from casemill.sources.session import written

#: Names of licence files, without directory.
LICENCE_FILE = r"(?i)^(?:un)?(?:licen[cs]e|copying|copyright|notice)(?:[._-].*)?$"

#: Short standard notices by licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("proprietary", "Copyright. All rights reserved"),
)


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, licence string, text string")


def terms(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits, ``+``, ``-`` and inner dots."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"[a-z0-9+\-]+(?:\.[a-z0-9]+)*"), F.lit(0))


def weighted(given: DataFrame) -> tuple[DataFrame, int]:
    """``term, template, licence, weight`` with unit length per template, and the number of templates.

    Inverse document frequencies come from the templates, a fixed small table, with idf = ln((1 + n) / (1 + df)) + 1.
    """
    rows = given.select("template", "licence", F.explode(terms(F.col("text"))).alias("term"))
    n = given.count()
    counts = rows.groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    value = counts.join(df, "term").withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1).withColumn("w", F.col("tf") * F.col("idf"))
    length = value.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return value.join(length, "template").select("term", "template", "licence", "idf", (F.col("w") / F.col("length")).alias("weight")), n


def anchors(weights: DataFrame, threshold: float) -> list[str] | None:
    """Terms of which a text holds at least one if its cosine with some template reaches the threshold; None: any text may.

    Read from the templates' terms, a fixed small table.
    """
    needed = (threshold - 1e-5) ** 2 if threshold > 1e-5 else 0.0
    if not needed:
        return None
    # any order of a template's terms is exact; long ones are looked for, as texts have fewer of them
    by_length = W.partitionBy("template").orderBy(F.length("term"), "weight", "term")
    left = weights.withColumn("left", F.sum(F.col("weight") * F.col("weight")).over(by_length))
    return sorted(r.term for r in left.filter(F.col("left") >= needed).select("term").distinct().collect())


def offers(files: DataFrame, needed: list[str] | None, idf: dict[str, float], unseen: float, threshold: float) -> DataFrame:
    """``file, offer, length, term, w``: the templates' terms of each different offer of a file, and the offer's length as a vector.

    Lines are cut from the whole text; lines without any of the needed terms are left out. Terms are counted inside the
    row. An offer whose template terms are too small a part of its length for the threshold is not shuffled.
    """
    name = F.element_at(F.split("path", "/"), -1)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    if needed is not None:
        # a needed term that a dot and more letters follow is another term: it only makes one offer more
        some = F.lit(r"(?i)(?<![a-z0-9+\-])(?:" + "|".join(re.escape(t) for t in needed) + r")(?![a-z0-9+\-])" if needed else "(?!)")
        lines = F.filter(lines, lambda x: F.rlike(x, some))
    whole = F.when(F.rlike(F.coalesce(name, F.lit("")), F.lit(LICENCE_FILE)), F.array(F.coalesce("text", F.lit("")))).otherwise(F.array().cast("array<string>"))
    each = files.select("file", F.explode(F.array_distinct(F.concat(lines, whole))).alias("offer"))
    # a fixed table of some hundred terms
    known = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    counted = each.select("file", F.xxhash64("offer").alias("offer"), run_lengths(terms(F.col("offer")), "term", "tf").alias("counts"))
    valued = counted.select("file", "offer", F.transform("counts", lambda c: F.struct(
        c["term"].alias("term"), c["tf"].alias("tf"), F.try_element_at(known, c["term"]).alias("idf"))).alias("cells"))

    def square(cells: Column) -> Column:
        return F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.pow(c["tf"] * F.coalesce(c["idf"], F.lit(unseen)), F.lit(2.0)))

    parts = valued.select("file", "offer", square(F.col("cells")).alias("square"), F.filter("cells", lambda c: c["idf"].isNotNull()).alias("cells"))
    near = parts.filter((F.size("cells") > 0) & (square(F.col("cells")) >= max(threshold - 1e-5, 0.0) ** 2 * F.col("square")))
    return near.dropDuplicates(["file", "offer"]).select("file", "offer", F.sqrt("square").alias("length"), F.inline("cells")).select(
        "file", "offer", "length", "term", (F.col("tf") * F.col("idf")).alias("w"))


def detected(files: DataFrame, given: DataFrame, threshold: float) -> DataFrame:
    """``file, licence, cosine``: the best template of each file that reaches the threshold; ties by licence name."""
    weights, n = weighted(given)
    idf = {r.term: r.idf for r in weights.select("term", "idf").distinct().collect()}
    if not idf:
        return files.select("file", F.lit(None).cast("string").alias("licence"), F.lit(None).cast("double").alias("cosine")).limit(0)
    valued = offers(files, anchors(weights, threshold), idf, math.log(1.0 + n) + 1, threshold)
    # the templates are a fixed table of a few hundred terms
    dots = valued.join(F.broadcast(weights.select("term", "template", "licence", "weight")), "term").groupBy(
        "file", "offer", "length", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    near = dots.withColumn("cosine", F.round(F.col("dot") / F.col("length"), 6)).filter(F.col("cosine") >= threshold)
    return near.groupBy("file").agg(F.max_by(F.struct("licence", "cosine"), F.struct(F.col("cosine"), F.col("licence"))).alias("best")).select("file", "best.*")


def directory(path: Column) -> Column:
    """The path without its last part; empty at the top, null for a null path."""
    return F.regexp_replace(path, r"(?:^|/)[^/]*$", "")


def scan(files: DataFrame, given: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``file, path, licence, cosine, from_path`` for every row of ``files(file, path, text)``, repeated rows included.

    ``from_path`` is the directory whose licence a file takes, null for its own licence or none. Files with one id are
    one file; a null id has no licence of its own. Of several licence files in a directory the best match counts. A null path takes nothing
    from a directory. A null or empty text offers nothing, and an empty table gives an empty one.
    """
    found = written(detected(files, given, threshold))
    named = files.select("file", "path").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    of_directory = (named.filter(F.rlike(F.coalesce(name, F.lit("")), F.lit(LICENCE_FILE))).join(found, "file")
                    .groupBy(directory(F.col("path")).alias("ancestor"))
                    .agg(F.max_by("licence", F.struct("cosine", "licence")).alias("inherited")))
    directories = named.filter("path is not null").select(directory(F.col("path")).alias("directory")).distinct()
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("ancestor")))
    nearest = (directories.select("directory", F.explode(above).alias("a")).select("directory", "a.depth", "a.ancestor")
               .join(of_directory, "ancestor").groupBy("directory")
               .agg(F.max_by(F.struct("inherited", "ancestor"), "depth").alias("near")))
    rows = files.select("file", "path", directory(F.col("path")).alias("directory"))
    out = rows.join(found, "file", "left").join(nearest, "directory", "left")
    return out.select("file", "path", F.coalesce("licence", "near.inherited").alias("licence"), "cosine",
                      F.when(F.col("licence").isNull(), F.col("near.ancestor")).alias("from_path"))
