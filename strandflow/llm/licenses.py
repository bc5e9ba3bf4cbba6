"""Operator 2: licence scans by sparse TF-IDF and directory inheritance.

Headers that speak of licensing, and licence files whole, are compared with
licence templates by the cosine of their TF-IDF vectors; document frequencies
are counted over all such segments.  A header is a comment block or a paragraph
joined to one segment, since notices are wrapped; each of its lines that speaks
of licensing is a segment too, since a paragraph may say other things.  What
speaks of licensing is told by :data:`LINE`, which finds every template.  A file
without a licence of its own inherits that of the nearest ancestor directory
with a licence file, found by joining each directory's ancestors with the
licensed directories.

Equal segments are compared once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

#: Least cosine with a template.
THRESHOLD = 0.35
LINE = "licen[cs]|copyright|spdx|permission is hereby granted|redistribution and use|public domain"
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"

# Licence notices and headings.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used. BSD 3-Clause License",
    "BSD-2-Clause": "BSD 2-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0. This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0. This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC0-1.0": "CC0 1.0 Universal. To the extent possible under law, the author has dedicated this work to the public domain by waiving all rights",
    "ISC": "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain. Unlicense",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential. Unauthorized copying is strictly prohibited",
}

#: SPDX header and the licence expression after it, in lower case.
SPDX = r"spdx-license-identifier:\s*(\(*[a-z0-9.+-]+\)*(?:\s+(?:or|and|with)\s+\(*[a-z0-9.+-]+\)*)*)"
#: SPDX identifiers of each template; the proprietary notice has none.
IDENTIFIERS = {name: [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name] for name in TEMPLATES if name != "Proprietary"}
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


_SAYS = re.compile(LINE)
_OPENS = re.compile(r"\s*(?://+!?|/\*+!?|\*+(?!/)|#+!?|--+|;+|%+|<!--|\"\"\"|''')\s?")
_CLOSES = re.compile(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$")


def header_blocks(text: str) -> Iterator[str]:
    """Comment blocks and paragraphs of several lines that speak of licensing, each joined to one line without comment signs."""
    held: list[str] = []
    kind, inside = "", False

    def joined() -> Iterator[str]:
        if len(held) > 1 and _SAYS.search((block := " ".join(" ".join(held).split())).lower()):
            yield block

    for line in text.split("\n"):
        opened = _OPENS.match(line)
        now = "comment" if opened or inside else "text" if line.strip() else ""
        if now != kind or not now:
            yield from joined()
            held, kind = [], now
        said = line[opened.end() :] if opened else line
        if "/*" in line:
            inside = "*/" not in line[line.index("/*") :]
        elif "*/" in line:
            inside = False
        held.append(_CLOSES.sub("", said))
    yield from joined()


def _header(identifier: str) -> str:
    return f"SPDX-License-Identifier: {identifier}".lower()


def _sentences(spark: SparkSession) -> DataFrame:
    """Templates, their sentences, since a header often quotes one sentence alone, and their SPDX headers."""
    rows = [(name, part) for name, text in TEMPLATES.items() for part in dict.fromkeys([text, *(p for p in text.split(". ") if len(p.split()) >= 4), *map(_header, IDENTIFIERS.get(name, []))])]
    return spark.createDataFrame(rows, "license string, segment string").withColumn("seg", F.xxhash64("license", "segment"))


def _terms(rows: DataFrame, *keys: str) -> DataFrame:
    # an SPDX header and its identifier are one term, so that headers of other licences share none
    joined = F.regexp_replace(F.lower("segment"), r"spdx-license-identifier:\s*", "spdx-license-identifier-")
    words = F.regexp_extract_all(joined, F.lit(TERM), F.lit(0))
    return rows.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def match_segments(segments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(seg, segment, license, cosine)``: each distinct segment's best template, if near enough.

    ``segments`` has distinct ``seg`` (a key), ``segment`` (text) and ``n`` (how
    often it occurs); frequencies count occurrences.
    """
    spark = segments.sparkSession
    templates = _sentences(spark)
    terms, wanted = _terms(segments, "seg", "n"), _terms(templates, "license", "seg")
    total = segments.agg((F.coalesce(F.sum("n"), F.lit(0)) + len(TEMPLATES)).alias("total"))
    df = terms.select("term", "n").unionByName(wanted.select("term", "license").distinct().select("term", F.lit(1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row of totals
    idf = stage(idf, "license-terms")  # a plain exchange in the joins below, so that a hot term is split
    a = terms.join(idf, "term").select("seg", "term", (F.col("tf") * F.col("idf")).alias("w"))
    b = wanted.join(idf, "term").select("license", F.col("seg").alias("template"), "term", (F.col("tf") * F.col("idf")).alias("v"))
    length_a, length_b = a.groupBy("seg").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("na")), b.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nb"))
    b = b.join(F.broadcast(length_b), "template")  # the templates are fixed and few
    dots = a.join(F.broadcast(b), "term").groupBy("seg", "license", "template").agg((F.sum(F.col("w") * F.col("v")) / F.first("nb")).alias("dot"))
    best = dots.groupBy("seg", "license").agg(F.max("dot").alias("dot")).join(length_a, "seg").withColumn("cosine", F.round(F.col("dot") / F.col("na"), 9))
    best = best.groupBy("seg").agg(F.max(F.struct("cosine", "license")).alias("top"))
    return best.select("seg", "top.license", "top.cosine").where(F.col("cosine") >= threshold)


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, path, license, cosine, origin, inherited_from)``, one row for each row of ``files``.

    ``origin`` is ``own``, ``inherited`` or ``none``; an inherited licence names
    the directory it comes from.  An SPDX header names its licence by identifier;
    identifiers that no template has give none.  Licence files are those named so.  A directory with several takes the best
    cosine, then the last name.  Null texts hold no licence, null paths lie in
    the root and inherit from it only; repeated rows keep their rows; an empty
    table gives an empty result; further columns are ignored.
    """
    files = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("array<string>")
    def blocks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else list(header_blocks(t)))

    lines = F.filter(F.split("text", "\n"), lambda x: F.lower(x).rlike(LINE))
    # each identifier of an SPDX header is asked by itself as well, whatever else its line says
    stated = F.flatten(F.transform(lines, lambda x: F.flatten(F.transform(F.regexp_extract_all(F.lower(x), F.lit(SPDX), F.lit(1)), lambda e: F.regexp_extract_all(e, F.lit(TERM), F.lit(0))))))
    stated = F.filter(F.array_distinct(stated), lambda t: t.isin([i.lower() for ids in IDENTIFIERS.values() for i in ids]))
    lines = F.concat(lines, F.transform(stated, lambda t: F.concat(F.lit(_header("")), t)), blocks(F.when(F.lower("text").rlike(LINE), F.col("text"))))
    named = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    asked = F.when(named, F.array_append(lines, F.col("text"))).otherwise(lines)
    folder = F.regexp_replace(F.regexp_replace(F.coalesce("path", F.lit("")), "^/+", ""), "/?[^/]*$", "")
    rows = stage(files.select("doc_id", "path", folder.alias("dir"), named.alias("named"), asked.alias("asked")).withColumn("row", F.monotonically_increasing_id()), "license-rows")
    each = rows.select("row", "named", F.explode("asked").alias("segment")).withColumn("seg", F.xxhash64("segment"))
    segments = each.groupBy("seg").agg(F.first("segment").alias("segment"), F.count("*").alias("n"))
    matches = stage(match_segments(segments, threshold), "license-matches")
    hits = each.select("row", "seg").join(matches, "seg")
    own = hits.groupBy("row").agg(F.max(F.struct("cosine", "license")).alias("own"))
    owned = stage(rows.drop("asked").join(own, "row", "left"), "license-own")

    given = owned.where("own is not null and named").groupBy("dir").agg(F.max(F.struct(F.col("own.cosine").alias("cosine"), F.col("own.license").alias("license"))).alias("from"))
    parts = F.filter(F.split("dir", "/"), lambda x: x != "")
    dirs = owned.select("dir").distinct()
    up = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("ancestor")))).alias("a"))
    near = up.join(given.withColumnRenamed("dir", "ancestor"), F.col("a.ancestor") == F.col("ancestor")).groupBy("dir").agg(F.max_by(F.struct("ancestor", "from"), "a.depth").alias("near"))
    out = owned.join(near, "dir", "left")
    return out.select(
        "doc_id",
        "path",
        F.coalesce("own.license", "near.from.license").alias("license"),
        F.coalesce("own.cosine", "near.from.cosine").alias("cosine"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("own").isNull(), F.col("near.ancestor")).alias("inherited_from"),
    )
