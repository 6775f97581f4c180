"""License notices found by MinHash bands over text windows and confirmed by containment.

A notice is a set of shingles of five words (of all its words, if it has fewer). Texts are cut
into overlapping windows, a little longer than the notices of a size class, at steps of an
eighth of their length, so a notice always lies whole inside some window. A window and a notice
that share a band of their MinHashes are a candidate; it counts when the window holds at least
`containment` per cent of the notice's distinct shingles, compared as texts.

At 80 per cent containment window and notice have a Jaccard similarity of 0.54 or more, and
with 32 bands of 2 the candidate is found with a probability above 0.9999; a window that is the
notice alone is found always.

Windows are only made around cue words. The cues of a notice are words that together touch more
of its shingles than may be missing, so a window without any of them cannot match.

Defined results: null and empty texts hold no notice; repeated rows are judged one by one;
notices with null or wordless texts match nothing; a notice whose id repeats counts as one of
several wordings, of which the best is told; extra columns pass, and those that share a name
with a result are replaced by it; empty tables give empty results. Of equal matches the first
is told.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import measured_bytes
from .common import carried, column, item, let, positions, written
from .decontam import norm_words

SHINGLE = 5
BANDS, ROWS_PER_BAND = 32, 2
BROADCAST_BYTES = 8 << 20
#: Notices up to so many bytes are read for their cue words; beyond it all windows are made.
CUE_BYTES = 4 << 20

# Public standard notices.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    ("all-rights-reserved", "All rights reserved."),
)


def notices(spark: SparkSession) -> DataFrame:
    """license, text: the notices of the query. Callers can pass any table of this form."""
    return spark.createDataFrame(list(NOTICES), "license string, text string")


def _class_size(m: int) -> int:
    """Shingle counts share a class with those up to an eighth larger."""
    size = 1
    while size < m:
        size += max(1, size // 8)
    return size


def _step(size: int) -> int:
    return max(1, size // 8)


def shingles(w: Column, k: Column | int) -> Column:
    """All runs of k words, as texts."""
    n = F.size(w) - k + 1
    return F.transform(positions(n), lambda i: F.array_join(F.slice(w, i + 1, k), " "))


def band_keys(grams: Column) -> Column:
    """One hash for each band. A gram is hashed once; masks make independent orders of it."""

    def low(h: Column, i: int) -> Column:
        mask = F.xxhash64(F.lit(i))
        return F.array_min(F.transform(h, lambda x: x.bitwiseXOR(mask)))

    def bands(h: Column) -> Column:
        return F.array(
            *[
                F.xxhash64(F.lit(b), *[low(h, b * ROWS_PER_BAND + r) for r in range(ROWS_PER_BAND)])
                for b in range(BANDS)
            ]
        )

    return let(F.transform(grams, lambda g: F.xxhash64(g)), bands)


def templates(known: DataFrame, license_id: str = "license", text: str = "text") -> DataFrame:
    """license, k, m (distinct shingles), run (all shingles), grams, bands; one row per wording."""
    w = known.select(F.col(license_id).cast("string").alias("license"), norm_words(F.col(text)).alias("w"))
    k = F.least(F.lit(SHINGLE), F.size("w"))
    rows = w.where(F.size("w") > 0).select("license", k.alias("k"), shingles(F.col("w"), k).alias("all"))
    rows = rows.select("license", "k", F.size("all").alias("run"), F.array_distinct("all").alias("grams"))
    return rows.select("license", "k", "run", F.size("grams").alias("m"), "grams", band_keys(F.col("grams")).alias("bands"))


def cue_words(grams: list[list[str]], containment: int) -> set[str]:
    """For each list of shingles, words that touch more of them than a match may lack; words of
    many lists, and long ones, first."""
    spread = Counter(word for g in grams for word in {x for s in g for x in s.split(" ")})
    cues: set[str] = set()
    for g in sorted(grams, key=len):
        touched = [set(s.split(" ")) for s in g]
        for word in sorted({x for s in touched for x in s}, key=lambda x: (x not in cues, -len(x) - spread[x], x)):
            missing = sum(not (s & cues) for s in touched)
            if 100 * missing < containment * len(g):
                break
            cues.add(word)
    return cues


def _starts(cues: Column, run: int, k: int) -> Column:
    """Starts, on the grid of a class, of the windows that share a shingle with a cue word."""
    step = _step(run)
    length = run + step - 1

    def around(p: Column) -> Column:
        first = F.greatest(F.ceil((p - (k - 1) - (length - 1)) / step), F.lit(0)).cast("int")
        return F.sequence(first, F.floor(p / step).cast("int"))

    return F.transform(F.array_distinct(F.flatten(F.transform(cues, around))), lambda g: g * step)


def scan(
    docs: DataFrame,
    known: DataFrame,
    text: str = "text",
    license_id: str = "license",
    license_text: str = "text",
    containment: int = 80,
) -> DataFrame:
    """Per document and license that it holds: the document's other columns, license,
    n_shingles (of the best wording), n_shared, start_word and n_words (the window)."""
    if not 80 <= containment <= 100:
        raise ValueError("the bands are set for a containment of 80 per cent or more")
    table = written(templates(known, license_id, license_text), "notices")
    classes = sorted({(r["k"], _class_size(r["run"])) for r in table.select("k", "run").distinct().collect()})
    small = measured_bytes(known.select(known[license_text].cast("string"))) <= CUE_BYTES
    cues = cue_words([r["grams"] for r in table.select("grams").collect()], containment) if small else None

    doc, back = carried(docs, [text, "license", "n_shingles", "n_shared", "start_word", "n_words"])
    rows = docs.select(doc, F.monotonically_increasing_id().alias("__row"), column(docs, text).alias("__text"))
    if cues:  # words hold no character that a pattern gives a meaning
        rows = rows.where(F.col("__text").rlike("(?i)" + "|".join(sorted(cues))))
    rows = rows.select("doc", "__row", norm_words(F.col("__text")).alias("__w"))

    def windows(w: Column) -> Column:
        at = positions(F.size(w))
        if cues:
            at = F.filter(at, lambda i: item(w, i).isin(sorted(cues)))
        return let(
            at,
            lambda p: F.flatten(
                F.array(
                    *[
                        F.transform(
                            F.filter(_starts(p, run, k), lambda s: s + k <= F.size(w)),
                            lambda s: F.struct(
                                F.lit(k).alias("k"),
                                F.lit(run).alias("cls"),
                                s.alias("start"),
                                F.slice(w, s + 1, run + _step(run) + k - 2).alias("win"),
                            ),
                        )
                        for k, run in classes
                    ]
                )
            ),
        )

    empty = "array<struct<k:int,cls:int,start:int,win:array<string>>>"
    found = let(F.col("__w"), windows) if classes else F.array().cast(empty)
    cut = rows.select("doc", "__row", F.explode(found).alias("x")).select("doc", "__row", "x.*")
    cut = cut.select("doc", "__row", "k", "cls", "start", F.size("win").alias("n"), shingles(F.col("win"), F.col("k")).alias("held"))
    keyed = cut.select("doc", "__row", "k", "cls", "start", "n", "held", F.explode(band_keys(F.col("held"))).alias("band"))

    size = F.lit(0)
    for k, run in classes:
        least = max((r for r in range(1, run + 1) if _class_size(r) < run), default=0)
        size = F.when((F.col("k") == k) & (F.col("run") > least) & (F.col("run") <= run), F.lit(run)).otherwise(size)
    wanted = table.select(
        F.col("k").alias("tk"), size.alias("tcls"), "license", F.col("m").cast("bigint").alias("m"), "grams", F.explode("bands").alias("tband")
    )
    flat = wanted.select("license", F.array_join("grams", " ").alias("g"), "tk", "tcls", "m", "tband")
    wanted = F.broadcast(wanted) if 4 * measured_bytes(flat) <= BROADCAST_BYTES else wanted
    met = keyed.join(wanted, (F.col("k") == F.col("tk")) & (F.col("cls") == F.col("tcls")) & (F.col("band") == F.col("tband")))
    exact = met.select(
        "doc", "__row", "license", "start", "n", "m", F.size(F.array_intersect("held", "grams")).cast("bigint").alias("shared")
    ).where(100 * F.col("shared") >= containment * F.col("m"))
    best = F.max(F.struct("shared", (-F.col("start")).alias("at"), (-F.col("n")).alias("n"), (-F.col("m")).alias("m")))
    told = exact.groupBy("__row", "license").agg(F.first("doc").alias("doc"), best.alias("b"))
    return told.select(
        *back,
        "license",
        (-F.col("b.m")).alias("n_shingles"),
        F.col("b.shared").alias("n_shared"),
        (-F.col("b.at")).cast("bigint").alias("start_word"),
        (-F.col("b.n")).cast("bigint").alias("n_words"),
    )
