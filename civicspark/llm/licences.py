"""Licence scans: TF-IDF cosine of lines to templates, and inheritance along directories."""

from __future__ import annotations

from math import log, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicspark.session import materialize

#: Least cosine of a line to a template.
LEAST = 0.6
#: A file whose notices make up this share of its lines' terms, or that is named so, is a licence file.
LICENCE_SHARE = 1 / 3
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice)([._-][^/]*)?$"

# Usual short notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("proprietary", "Copyright. All rights reserved."),
)


def templates(spark: SparkSession) -> DataFrame:
    """(licence, notice) of the usual notices."""
    schema = T.StructType([T.StructField("licence", T.StringType()), T.StructField("notice", T.StringType())])
    return spark.createDataFrame(list(TEMPLATES), schema)


def _terms(line: Column) -> Column:
    """Distinct runs of letters and digits of a line, lowered."""
    return F.array_distinct(F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _telling(lists: list[tuple[str, tuple[str, ...]]], weight: dict[str, float], least: float) -> list[str]:
    """Terms of which every line within ``least`` of a notice holds one.

    The terms such a line shares with the notice weigh at least least^2 of the notice's
    squares, so it cannot share only terms that weigh less together.
    """
    found = set()
    for _, terms in lists:
        squares = sorted((weight[t] ** 2, t) for t in terms)
        room = least**2 * sum(s for s, _ in squares) * (1 - 1e-9)
        for square, term in squares:
            room -= square
            if room <= 0:
                found.add(term)
    return sorted(found)


def scan(files: DataFrame, notices: DataFrame, least: float = LEAST) -> DataFrame:
    """(file_id, path, licence, found_in, cosine, licence_dir) of every row of (file_id, path, text).

    Each line is a vector of its distinct terms, weighted by 1 + ln((N + 1) / (df + 1)) with
    document frequencies over all files. The nearest notice with a cosine of ``least`` or more is
    the line's licence, the best line's licence is the file's own: ``found_in`` is 'header', or
    'file' in a licence file. A file without any inherits from the licence file in the nearest
    directory above or beside it ('directory'); otherwise it has no licence (null). Ties take
    the greatest licence name.

    Null or empty texts have no licence of their own. A null path has no directories. Repeated
    rows get the same result each. ``notices`` (licence, notice) is a catalogue: its terms
    are handed to every task, so it is held in a literal; files never are.
    """
    rows = files.select(
        F.col("file_id"),
        F.col("path").cast("string").alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    wanted = notices.select("licence", _terms(F.col("notice")).alias("terms")).collect()
    vocabulary = sorted({t for r in wanted for t in r.terms})
    words = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    term = F.col("term")
    every = rows.select(F.explode(F.array_append(_terms(F.col("text")), "")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # Terms of one file are not written: a term of a line that is not listed has a frequency of 1.
    counted = materialize(every.filter((F.col("df") > 1) | F.array_contains(words, term) | (term == "")))
    df = {r.term: r.df for r in counted.filter(F.array_contains(words, term) | (term == "")).collect()}  # '' comes once a file

    n = df.get("", 0)
    weight = {t: 1 + log((n + 1) / (df.get(t, 0) + 1)) for t in vocabulary}
    squares = F.array(*(F.lit(weight[t] ** 2) for t in vocabulary)) if vocabulary else F.array().cast("array<double>")
    zero = F.lit(0.0)

    def mass(terms: Column) -> Column:
        return F.aggregate(terms, zero, lambda s, t: s + F.element_at(squares, F.array_position(words, t).cast("int")))

    lists = sorted({(r.licence, tuple(sorted(r.terms))) for r in wanted if r.terms})

    def nearest_notice(known: Column) -> Column:
        """The best (share, licence) of a line with these known terms; its cosine is the share over its length."""
        options = [
            F.struct(
                (mass(F.array_intersect(known, F.array(*map(F.lit, terms)))) / F.lit(sqrt(sum(weight[t] ** 2 for t in terms)))).alias("share"),
                F.lit(licence).alias("licence"),
            )
            for licence, terms in lists
        ]
        return F.array_max(F.array(*options)) if options else F.lit(None).cast("struct<share:double,licence:string>")

    def judge(line: Column) -> Column:
        """What is known of a line without the frequencies of its other terms, null where no cosine can reach ``least``."""

        def by_terms(terms: Column) -> Column:
            known = F.filter(terms, lambda t: F.array_contains(words, t))

            def scored(k: Column) -> Column:
                # A term weighs 1 at least, and no cosine exceeds the length of the known part over the whole length.
                shortest = mass(k) + F.size(terms) - F.size(k)
                hopeless = (F.size(k) == 0) | (mass(k) < F.lit(least**2 * (1 - 1e-9)) * shortest)

                def with_notice(best: Column) -> Column:
                    near = best["share"] * best["share"] >= F.lit(least**2 * (1 - 1e-9)) * shortest
                    return F.when(near, F.struct(
                        best["share"].alias("share"), best["licence"].alias("licence"), mass(k).alias("mass"),
                        F.size(terms).alias("words"), F.array_except(terms, k).alias("others"),
                    ))

                return F.when(~hopeless, F.get(F.transform(F.array(nearest_notice(k)), with_notice), F.lit(0)))

            return F.get(F.transform(F.array(known), scored), F.lit(0))

        return F.get(F.transform(F.array(_terms(line)), by_terms), F.lit(0))

    def candidates(lines: Column) -> Column:
        def counted_words(found: Column) -> Column:
            n_words = F.aggregate(lines, F.lit(0), lambda s, x: s + F.size(_terms(x)))
            return F.when(F.size(found) > 0, F.struct(found.alias("lines"), n_words.alias("n_words")))

        found = F.filter(F.transform(lines, judge), lambda h: h.isNotNull())
        return F.get(F.transform(F.array(found), counted_words), F.lit(0))

    lines = F.split("text", r"\r?\n")
    low = F.lower("text")
    suspect = F.lit(False)
    for term in _telling(lists, weight, least):
        suspect = suspect | F.contains(low, F.lit(term))
    judged = materialize(
        rows.select("file_id", "path", F.when(suspect, F.get(F.transform(F.array(lines), candidates), F.lit(0))).alias("v"))
        .withColumn("row_no", F.monotonically_increasing_id())
    )
    near = judged.select("row_no", "path", "v.n_words", F.posexplode("v.lines").alias("line_no", "line"))
    # Only terms of the lines left are looked up. Sorted, so that sums do not depend on the order of rows.
    squared = F.pow(1 + F.log(F.lit(n + 1.0) / (F.coalesce("df", F.lit(1)) + 1)), F.lit(2.0))
    others = (
        near.select("row_no", "line_no", F.explode("line.others").alias("term"))
        .join(counted, "term", "left")
        .groupBy("row_no", "line_no")
        .agg(F.aggregate(F.sort_array(F.collect_list(squared)), zero, lambda s, x: s + x).alias("rest"))
    )
    hits = (
        near.join(others, ["row_no", "line_no"], "left")
        .withColumn("cosine", F.col("line.share") / F.sqrt(F.col("line.mass") + F.coalesce("rest", zero)))
        .filter(F.col("cosine") >= least)
    )
    whole = F.col("path").rlike(LICENCE_NAME) | (F.sum("line.words") >= F.col("n_words") * F.lit(LICENCE_SHARE))
    verdicts = hits.groupBy("row_no", "path", "n_words").agg(
        F.max(F.struct("cosine", F.col("line.licence").alias("licence"))).alias("best"), F.coalesce(whole, F.lit(False)).alias("whole")
    )
    own = materialize(
        judged.join(verdicts.drop("path", "n_words"), "row_no", "left").select(
            "file_id", "path", "best", "whole", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir")
        )
    )
    order = F.struct(F.col("best.cosine").alias("cosine"), F.col("best.licence").alias("licence"))
    of_dir = own.filter("whole and path is not null").groupBy("dir").agg(F.max(order).alias("rule"))
    # Directories, not files, look upwards: each is listed once with all that are above it.
    parts = F.split("dir", "/")
    above = (
        own.filter("best is null and path is not null").select("dir").distinct()
        .select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
        .select("dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("up"))
    )
    nearest = (
        above.join(of_dir.withColumnRenamed("dir", "up"), "up")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "up", "rule")).alias("near"))
    )
    return own.join(nearest, "dir", "left").select(
        "file_id",
        "path",
        F.coalesce("best.licence", F.when(F.col("best").isNull(), F.col("near.rule.licence"))).alias("licence"),
        F.when(F.col("whole"), "file").when(F.col("best").isNotNull(), "header").when(F.col("near").isNotNull(), "directory").alias("found_in"),
        F.round(F.coalesce("best.cosine", "near.rule.cosine"), 6).alias("cosine"),
        F.when(F.col("whole"), F.col("dir")).when(F.col("best").isNull(), F.col("near.up")).alias("licence_dir"),
    )
