"""Licences of files: TF-IDF cosine of header lines to templates, then inheritance from the nearest directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, staged, text_of

# fixed values: licence statements by SPDX identifier
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the Apache License Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT license"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
)
CUES = ("licen", "copyright", "permission", "redistribution", "spdx")
FILE_NAME = "(?i)^(licen[cs]e|copying|copyright|notice)"
MIN_COSINE = 0.6
LEVELS = 64


def terms(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots or dashes, without the empty one."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9.-]+", " "), "[.-]+( |$)", " ")
    return F.filter(F.split(bare, " +"), lambda w: w != "")


def _cue(low: Column) -> Column:
    found = low.contains(CUES[0])
    for cue in CUES[1:]:
        found |= low.contains(cue)
    return found


def score_lines(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """``line, license, cosine`` of every distinct header line (``line``, ``n``: how often) that has a term.

    Term weights are tf * (1 + ln((1 + N) / (1 + df))); N and df count all header lines and the templates. The same line
    counts ``n`` times but is scored once. Vectors are rows (line, term), templates as well; dot products come from a
    join on the term, so work is in proportion to shared terms.
    """
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "template int, license string, line string")
    # the templates are a fixed list: a few hundred rows
    model = known.select("template", "license", F.explode(terms(F.col("line"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))
    words = lines.select("line", "n", F.explode(terms(F.col("line"))).alias("term")).groupBy("line", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    words = staged(words, "licence-terms")
    every = words.groupBy("term").agg(F.sum("n").alias("df")).unionByName(model.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    total = (lines.agg(F.sum("n").alias("n")).first()["n"] or 0) + len(TEMPLATES)
    weight = (F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf")
    idf = staged(every.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight), "licence-idf")
    own = words.join(idf, "term").select("line", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = own.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    side = model.join(idf, "term").select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("v"))
    size = side.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    side = side.join(size, "template").select("template", "license", "term", (F.col("v") / F.col("size")).alias("v"))
    dots = own.join(F.broadcast(side), "term").groupBy("line", "template", "license").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 4)
    best = dots.join(norms, "line").groupBy("line").agg(F.max(F.struct(cosine.alias("cosine"), (-F.col("template")).alias("t"), "license")).alias("best"))
    return best.select("line", "best.license", "best.cosine")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, ending with the root ""."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", min_cosine: float = MIN_COSINE, passed: tuple[str, ...] = ()) -> DataFrame:
    """Per file: the ``passed`` columns, ``path``, ``own_license``, ``cosine``, ``license``, ``how``, ``from_dir``.

    A header line is any line with a cue word such as "license"; all lines of the whole text are looked at. A file's own
    licence is that of its best line if its cosine to a template is ``min_cosine`` or more. A file without one takes the
    licence of the licence file (by its name) in the nearest directory above it; of several in a directory the best
    cosine counts, then the smallest path. ``how``: "own", "inherited" or "none". Null texts are empty and null paths
    lie in the root, nameless. Every row is a file, repeated paths too. Directories are joined once each, whatever the
    number of their files; a line repeated in many files is scored once.
    """
    spark = files.sparkSession
    row = fresh(files, "row")
    text = text_of(text_col)
    base = files.select(*passed, F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.when(_cue(F.lower(text)), text).alias("hit"))
    cued = F.filter(F.split(F.col("hit"), "\n"), lambda x: _cue(F.lower(x)))
    slim = base.select(*passed, "path", F.array_distinct(F.transform(cued, lambda x: F.trim(x))).alias("lines")).withColumn(row, F.monotonically_increasing_id())
    slim = staged(slim, "licence-files")
    held = slim.filter("lines IS NOT NULL").select(F.col(row).alias("row"), F.explode("lines").alias("line"))
    lines = staged(held.groupBy("line").agg(F.count(F.lit(1)).alias("n")), "licence-lines")
    scored = score_lines(spark, lines).filter(F.col("cosine") >= min_cosine)
    best = held.join(scored, "line").groupBy("row").agg(F.max(F.struct("cosine", "license")).alias("best"))
    known = slim.drop("lines").join(best.withColumnRenamed("row", "b_row"), F.col(row) == F.col("b_row"), "left")
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))
    known = staged(known.select(*passed, "path", folder.alias("dir"), F.col("best.license").alias("own_license"), F.col("best.cosine").alias("cosine")), "licence-own")
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME)
    givers = known.filter(named & F.col("own_license").isNotNull()).groupBy("dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("neg"), "path", "own_license")).alias("top")).select(F.col("dir").alias("up"), F.col("top.own_license").alias("dir_license"))
    dirs = known.filter("own_license IS NULL").select("dir").distinct()
    # every directory with itself and all above it; depth counts the parts of the upper one
    chain = dirs.select("dir", F.explode(F.concat(F.array("dir"), F.when(F.col("dir") != "", ancestors(F.col("dir"))).otherwise(F.array().cast("array<string>")))).alias("up"))
    near = chain.join(givers, "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("depth"), "up", "dir_license")).alias("near"))
    near = near.select(F.col("dir").alias("n_dir"), F.col("near.up").alias("up"), F.col("near.dir_license").alias("dir_license"))
    out = known.join(near, (F.col("dir") == F.col("n_dir")) & F.col("own_license").isNull(), "left")
    own = F.col("own_license").isNotNull()
    return out.select(
        *passed, "path", "own_license", "cosine", F.coalesce("own_license", "dir_license").alias("license"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(own, F.col("dir")).otherwise(F.col("up")).alias("from_dir"))
