"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts and templates are lower-cased words (runs of a-z and 0-9) in shingles of three:
the shortest notice has three words. Templates are grouped by size: a template of n
shingles, 2**(c-1) < n <= 2**c, is looked for in windows of 2**(c+1) shingles that start
every 2**c, so that each passage of its length lies whole inside a window. A window
whose share of a template is ``CONTAINMENT`` or more has a Jaccard similarity of at
least 0.8 * 2**(c-1) / (2**(c+1) + 0.2 * 2**(c-1)), 0.19; with BANDS = 48 bands of one
row the probability to meet is 1 - 0.81**48 = 0.99996. Whole copies have similarity 1/4
or more and meet with 0.999999. What meets is verified by exact shingle containment.

Windows that hold no shingle of any template cannot contain one and are left out
before they are hashed. DataFrame operations only. Defined results: a null text, and
one of fewer than three words, matches nothing; repeated rows with one id are one
document; templates of fewer than three words are refused. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import let

WIDTH = 3
BANDS = 48
CONTAINMENT = 0.8
# The index is broadcast and the shingles of all templates stand in the plan: more words
# than this are refused.
MAX_WORDS = 20_000

# The wording of common notices. What differs from a sibling in a few words
# only has the share of it that must be there.
NOTICES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2.0-header",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    (
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        1.0,
    ),
    (
        "cc-by-nc-4.0-notice",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        1.0,
    ),
    (
        "cc-by-nc-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        1.0,
    ),
    (
        "cc-by-nd-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        1.0,
    ),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-2.0-notice",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
        0.95,
    ),
    (
        "gpl-2.0-only-notice",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License version 2 as published by the Free Software Foundation.",
        0.95,
    ),
    (
        "lgpl-2.1-notice",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
        0.95,
    ),
    (
        "lgpl-3.0-notice",
        "This library is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        0.95,
    ),
    (
        "agpl-3.0-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        0.95,
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    ("mit", "Released under the MIT License."),
    (
        "mit-notice",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "bsd-notice",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "bsd-3-clause",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software.",
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at",
    ),
    (
        "bsl-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
    ),
]
# Licenses by their identifiers, and by names with versions.
IDENTIFIERS = [
    "0BSD", "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense",
    "WTFPL", "Zlib",
]
NAMES = [
    ("agpl-3.0", "GNU Affero General Public License", "3"),
    ("apache-2.0", "Apache License", "2.0"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike", "4.0"),
    ("epl-2.0", "Eclipse Public License", "2.0"),
    ("gpl-2.0", "GNU General Public License", "2"),
    ("gpl-3.0", "GNU General Public License", "3"),
    ("lgpl-2.1", "GNU Lesser General Public License", "2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License", "3"),
    ("mpl-2.0", "Mozilla Public License", "2.0"),
    ("bsd-2-clause", "BSD 2-Clause License", ""),
    ("bsd-3-clause", "BSD 3-Clause License", ""),
]


def known_templates() -> list[tuple]:
    """(license, wording[, share that must be there]): the notices; the identifier tags, each
    whole; the names with and without the word "version", each whole; and "licensed under"
    with a short Creative Commons name."""
    tags = [(f"tag:{i.lower()}", f"SPDX-License-Identifier: {i}", 1.0) for i in IDENTIFIERS]
    named = [
        (f"name:{license}{kind}", f"{name}{word}{version}", 1.0)
        for license, name, version in NAMES
        for kind, word in ((("", " version "), (":short", " ")) if version else (("", ""),))
    ]
    short = [
        (f"short:{i.lower()}", f"Licensed under {i.replace('CC-', 'CC ')}", 1.0)
        for i in IDENTIFIERS
        if i.startswith("CC-BY") and i != "CC-BY-NC-4.0"
    ]
    return [*NOTICES, *tags, *named, *short]


TEMPLATES = known_templates()


def shingles(text: Column) -> Column:
    """Hashes of the word triples of a text, in order; empty for fewer words."""
    split = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")

    def triples(words: Column) -> Column:
        return F.when(
            F.size(words) >= WIDTH,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - WIDTH),
                lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WIDTH)]),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return let(split, triples)


def _bands(found: Column) -> Column:
    """One MinHash per band, tagged with its number."""
    return let(
        found,
        lambda own: F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)),
            lambda band: F.xxhash64(
                band, F.array_min(F.transform(own, lambda s: F.xxhash64(s, band)))
            ),
        ),
    )


def scan(
    docs: DataFrame,
    templates: Sequence[tuple] = TEMPLATES,
    doc_id: str = "doc_id",
    text: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per (document, template) found: best containment, and the first word of the
    window's first shingle that the template has. Templates are (license, wording) or
    (license, wording, share); ``containment`` is the share of those without their own.

    The documents are read once and not shuffled; what is grouped at the end are the
    verified windows, counted per document and template on the map side first.
    """
    if sum(len(t[1].split()) for t in templates) > MAX_WORDS:
        raise ValueError(f"templates of more than {MAX_WORDS} words")
    spark = docs.sparkSession
    known = (
        spark.createDataFrame(
            [(*t, containment)[:3] for t in templates], "license string, wording string, least double"
        )
        .withColumn("own", F.array_distinct(shingles(F.col("wording"))))
        .withColumn("kind", F.ceil(F.log2(F.size("own").cast("double"))).cast("int"))
        .select("license", "own", "kind", "least")
    )
    rows = known.collect()  # as long as the templates
    if any(not r.own for r in rows):
        raise ValueError(f"a template has fewer than {WIDTH} words")
    wanted = F.array(*[F.lit(x) for x in sorted({x for r in rows for x in r.own})])
    kinds = F.array(*[F.lit(k) for k in sorted({r.kind for r in rows})])
    index = known.select("license", "own", "kind", "least", F.explode(_bands(F.col("own"))).alias("band"))

    candidates = docs.select(
        F.col(doc_id).alias("doc_id"), shingles(F.coalesce(F.col(text), F.lit(""))).alias("found")
    ).filter(F.arrays_overlap("found", wanted))
    windows = (
        candidates.select("doc_id", "found", F.explode(kinds).alias("kind"))
        .select(
            "doc_id",
            "kind",
            "found",
            F.explode(
                F.expr("sequence(0, greatest(size(found) - 1, 0), cast(pow(2, kind) as int))")
            ).alias("start"),
        )
        .select(
            "doc_id",
            "kind",
            "start",
            F.expr("slice(found, start + 1, cast(pow(2, kind + 1) as int))").alias("window"),
        )
        .filter(F.arrays_overlap("window", wanted))
    )
    met = (
        windows.select("*", F.explode(_bands(F.col("window"))).alias("band"))
        .join(F.broadcast(index), ["kind", "band"])
        .withColumn("shared", F.array_intersect("own", "window"))
        .withColumn("share", F.size("shared") / F.size("own"))
        .filter(F.col("share") >= F.col("least"))
    )
    # A window meets a template in many bands; it counts once.
    place = F.array_min(F.transform("shared", lambda s: F.array_position("window", s))) - 1
    return (
        met.select(
            "doc_id",
            "license",
            "share",
            (F.col("start") + place).alias("word"),
        )
        .groupBy("doc_id", "license")
        .agg(F.max("share").alias("containment"), F.min("word").alias("first_word"))
    )
