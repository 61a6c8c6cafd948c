"""License scans on DataFrame functions alone.

A passage that may state a licence begins with the first two words of a template. Each such place in a text, wherever it stands in a line or
file, gives windows: the words from there on, as many as the templates have. Windows are compared with the templates of their length by the
cosine of sparse TF-IDF vectors: header sentences, SPDX tags, notices, and the openings and bodies of licence files. Term frequencies come from all
windows of the corpus: equal windows are counted first, so one that stands in a third of all files is one row with a count. A file's own
licence is that of its best window; a file without one inherits that of the nearest directory above it that has a licence file, by joins of
path prefixes.

Defined results: a null or empty text has no licence; equal scores go to the longer window, then to the licence that comes first by name; a null
path inherits nothing; several licence files in one directory give that of the highest score, then the first by name; repeated rows
are scanned one by one; an empty table gives an empty result. Windows are counted in words, so what stands between words, however much, changes nothing.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import materialize, small

THRESHOLD, SALTS = 0.6, 16
WORD = r"([a-z]+|[0-9]+(?:\.[0-9]+)*)"
#: Names of licences as headers give them, by SPDX identifier.
NAMES = {
    "AGPL-3.0-only": "the GNU Affero General Public License, version 3",
    "Apache-2.0": "the Apache License, Version 2.0",
    "Artistic-2.0": "the Artistic License 2.0",
    "BSD-2-Clause": "the BSD 2-Clause License",
    "BSD-3-Clause": "the BSD 3-Clause License",
    "BSL-1.0": "the Boost Software License 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC0-1.0": "CC0 1.0 Universal",
    "EPL-2.0": "the Eclipse Public License 2.0",
    "GPL-2.0-only": "the GNU General Public License, version 2",
    "GPL-3.0-only": "the GNU General Public License, version 3",
    "ISC": "the ISC License",
    "LGPL-2.1-only": "the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0-only": "the GNU Lesser General Public License, version 3",
    "MIT": "the MIT License",
    "MPL-2.0": "the Mozilla Public License, v. 2.0",
    "Unlicense": "the Unlicense, a public domain dedication",
    "Zlib": "the zlib License",
}
FORMS = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.")
#: Identifiers that only tags give.
TAGS = (
    "0BSD", "AGPL-3.0-or-later", "CDDL-1.0", "EPL-1.0", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "MPL-1.1", "NCSA",
    "OFL-1.1", "PostgreSQL", "Python-2.0", "WTFPL", "X11",
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GNU = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Notices, and openings of licence files, as their texts have them.
PASSAGES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("BSD-2-Clause", _BSD + "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC0-1.0", "CC0 1.0 Universal Statement of Purpose"),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-2.0-or-later", _GNU.format("This program", "", 2)),
    ("GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-3.0-or-later", _GNU.format("This program", "", 3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "ISC License Copyright (c)"),
    ("LGPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-3.0-or-later", _GNU.format("This library", "Lesser ", 3)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "MIT License Copyright (c)"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions"),
)
#: Long passages are also known by their first so many words.
CUTS = (16, 32, 64)


def _words(text: str) -> list[str]:
    import re

    return re.findall(WORD, text.lower())


def templates() -> list[tuple[str, str]]:
    """(licence, words): all templates; a cut that two licences share is left out."""
    whole = [(k, f.format(v)) for k, v in NAMES.items() for f in FORMS]
    whole += [(k, f"SPDX-License-Identifier: {k}") for k in (*NAMES, *TAGS)] + list(PASSAGES)
    words = [(k, _words(t)) for k, t in whole]
    cut = [(k, " ".join(w[:n])) for k, w in words for n in {len(w), *(c for c in CUTS if c < len(w))}]
    owners: dict[str, set[str]] = {}
    for k, t in cut:
        owners.setdefault(t, set()).add(k)
    return sorted({(k, t) for k, t in cut if len(owners[t]) == 1})


def lengths() -> list[int]:
    return sorted({len(t.split()) for _, t in templates()})


def openings() -> list[str]:
    """The first two words of the templates, with which windows begin."""
    return sorted({" ".join(t.split()[:2]) for _, t in templates()})


def hint() -> str:
    """Pattern that every text with an opening has."""
    return "|".join("[^a-z0-9]*".join(o.replace(".", "[.]").split()) for o in openings())


def tokens(text: Column) -> Column:
    """Words and numbers of a lower-case text, as ``a-z`` and ``0-9`` runs with inner dots."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def windows(text: Column) -> Column:
    """Array of (size, line): the windows of a text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    sizes = F.array(*map(F.lit, lengths()))

    def cut(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
        begins = F.filter(F.transform(pairs, lambda p, i: F.when(p.isin(*openings()), i + 1)), lambda i: i.isNotNull())
        return F.flatten(F.transform(begins, lambda i: F.transform(sizes, lambda n: F.struct(n.alias("size"), F.array_join(F.slice(words, i, n), " ").alias("line")))))

    # as a variable of its own the array of words is made once
    return F.when(low.rlike(hint()), F.element_at(F.transform(F.array(tokens(low)), cut), 1))


def line_scores(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(h1, h2, license, score): the best template of each distinct window. ``lines``: h1, h2, size, line, n (times it occurs)."""
    made = [(k, len(t.split()), t) for k, t in templates()]
    known = spark.createDataFrame(made, "license string, size int, line string").withColumn("t", F.row_number().over(Window.orderBy("license", "size", "line")))

    def counted(line: str) -> Column:
        """The line's distinct words and how often each stands there; counted in the row, so no word moves for it."""
        words = F.split(line, " ")
        return F.explode(F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("term"), F.size(F.filter(words, lambda x: x == t)).alias("tf"))))

    term = lines.select("h1", "h2", "size", "n", counted("line").alias("w")).select("h1", "h2", "size", "n", "w.term", "w.tf")
    known_term = known.select("t", "license", "size", counted("line").alias("w")).select("t", "license", "size", "w.term", "w.tf")
    total = lines.agg((F.coalesce(F.sum("n"), F.lit(0)) + len(made)).alias("total"))
    df = term.select("term", "n").unionByName(known_term.select("term", F.lit(1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    idf = materialize(df.crossJoin(F.broadcast(total)).select("term", (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1).alias("idf")))  # one row
    idf = small(idf, idf.count())
    weighed = term.join(idf, "term").select("h1", "h2", "size", "term", (F.col("tf") * F.col("idf")).alias("w"))
    known_weighed = known_term.join(idf, "term").select("t", "license", "size", "term", (F.col("tf") * F.col("idf")).alias("tw"))
    norm = weighed.groupBy("h1", "h2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    known_norm = known_weighed.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    # the templates are a fixed list, so both of their tables are small
    dot = weighed.join(F.broadcast(known_weighed), ["size", "term"]).groupBy("h1", "h2", "t", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    cos = dot.join(F.broadcast(known_norm), "t").join(norm, ["h1", "h2"]).select("h1", "h2", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6).alias("score"))
    return cos.groupBy("h1", "h2").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("x")).select("h1", "h2", F.col("x.license").alias("license"), (-F.col("x.s")).alias("score"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_id, path, own_license, own_score) of every row of ``files`` (file_id, path, text)."""
    keyed = materialize(files.select("file_id", "path", F.monotonically_increasing_id().alias("row"), windows(F.col("text")).alias("windows")))
    hashed = keyed.select("row", F.explode("windows").alias("w")).select("row", "w.size", "w.line").withColumns({"h1": F.xxhash64("size", "line"), "h2": F.xxhash64(F.lit(1), "size", "line")})
    distinct = materialize(hashed.groupBy("h1", "h2").agg(F.first("size").alias("size"), F.first("line").alias("line"), F.count("*").alias("n")))
    scored = line_scores(files.sparkSession, distinct).where(F.col("score") >= threshold)
    # salts: one window may stand in very many files
    scored = scored.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = hashed.drop("line").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(scored, ["h1", "h2", "salt"])
    own = own.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("size")).alias("size"), "license")).alias("x"))
    return keyed.drop("windows").join(own, "row", "left").select("file_id", "path", F.col("x.license").alias("own_license"), (-F.col("x.s")).alias("own_score"))


def inherit(scanned: DataFrame, directories: DataFrame) -> DataFrame:
    """``scanned`` with ``license`` and ``inherited_from``. ``directories``: (directory, license, score) of licence files."""
    scanned = scanned.withColumn("row", F.monotonically_increasing_id())
    scanned = materialize(scanned)
    best = directories.where("directory is not null and license is not null").groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("x")).select("directory", F.col("x.license").alias("found"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    parts = F.split("path", "/", -1)
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("directory")))
    climbs = scanned.where("own_license is null and path is not null").select("row", F.explode(above).alias("a"), F.pmod("row", F.lit(SALTS)).cast("int").alias("salt")).select("row", "salt", "a.depth", "a.directory")
    near = climbs.join(best, ["directory", "salt"]).groupBy("row").agg(F.max_by(F.struct("directory", "found"), "depth").alias("y"))
    out = scanned.join(near, "row", "left")
    return out.select("file_id", "path", "own_license", "own_score", F.coalesce("own_license", "y.found").alias("license"), F.when(F.col("own_license").isNull(), F.col("y.directory")).alias("inherited_from"))
