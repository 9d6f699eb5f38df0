"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts are normalised (A-Z lower-cased, ASCII punctuation dropped) and become sequences of hashes of
five-word shingles. Windows of three lengths slide over the sequence, each by half its length or less, and a template is
cut into windows of its class's length at every place. A template of T shingles belongs to the longest class with
T >= length + stride - 1, so that some window of a text that holds it unchanged lies within it and has the very MinHashes of a
template window: all bands meet. Where a share s of a window's shingles agrees, one of b bands of one row meets with
probability 1 - (1 - s)^b, 0.94 for s = 0.5 in each window, and a template has several.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table
from .sketches import SHINGLE, let, shingle_hashes, word_hashes

#: Windows: length in shingles, stride, bands of one row.
CLASSES = [(16, 8, 4), (4, 2, 4), (1, 1, 1)]
#: Least share of a template's shingles that must stand where it was retrieved.
CONTAINMENT = 0.8

#: Notices and opening passages of public licenses.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}

_DROPPED = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER + _DROPPED, LOWER)


def template_shingles(text: str) -> list[int]:
    """The hashes that shingle_hashes gives for the normalised text, in Python."""

    def chain(values: list[int]) -> int:
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v % 2**64).to_bytes(8, "little"), seed)
        return seed - 2**64 if seed >= 2**63 else seed

    words = [xxhash.xxh64_intdigest(w, 42) for w in text.translate(str.maketrans(UPPER, LOWER, _DROPPED)).encode().split()]
    runs = [words[i : i + SHINGLE] for i in range(max(1, len(words) - SHINGLE + 1))]
    return [chain(r) for r in runs]


def band_value(shingle: int, band: int) -> int:
    seed = xxhash.xxh64_intdigest((shingle % 2**64).to_bytes(8, "little"), 42)
    value = xxhash.xxh64_intdigest((band % 2**64).to_bytes(8, "little"), seed)
    return value - 2**64 if value >= 2**63 else value


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


def license_matches(text: Column, templates: dict[str, list[str]] = TEMPLATES, least: float = CONTAINMENT) -> Column:
    """array<struct<license, containment, first_word>>: the templates that the text holds, in the templates' order.

    containment is the largest share of the template's distinct shingles within reach of a window that retrieved it;
    first_word is where that window begins, counted from 0.
    """
    listed = []  # license, class, distinct shingles, band values of its windows
    for name, texts in templates.items():
        for t in texts:
            sh = template_shingles(t)
            cls = next((c for c, (size, stride, _) in enumerate(CLASSES) if len(sh) >= size + stride - 1), len(CLASSES) - 1)
            size, _, bands = CLASSES[cls]
            windows = [sh[i : i + size] for i in range(len(sh) - size + 1)]
            listed.append((name, cls, sorted(set(sh)), len(sh), [sorted({min(band_value(v, b) for v in w) for w in windows}) for b in range(bands)]))
    used = [(c, b) for c in range(len(CLASSES)) if any(x[1] == c for x in listed) for b in range(CLASSES[c][2])]
    wanted = {(c, b): sorted({v for x in listed if x[1] == c for v in x[4][b]}) for c, b in used}

    def minima(h: Column, c: int, b: int) -> Column:
        size, stride, _ = CLASSES[c]
        each = F.transform(h, lambda v: F.xxhash64(v, F.lit(b).cast("bigint")))
        if size == 1:
            return each
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1)), F.lit(stride))
        return let(each, lambda e: F.transform(starts, lambda i: F.array_min(F.slice(e, i, size))))

    def verify(h: Column, m: Column) -> Column:
        met = F.exists(m, lambda x: F.lit(False))
        for i, key in enumerate(used):
            met = met | F.arrays_overlap(F.element_at(m, i + 1), _longs(wanted[key]))
        found = []
        for name, c, distinct, length, bands in listed:
            size, stride, _ = CLASSES[c]
            hits = F.array().cast("array<int>")
            for b, values in enumerate(bands):
                own = F.element_at(m, used.index((c, b)) + 1)
                at = F.filter(F.transform(own, lambda v, i: F.when(F.array_contains(_longs(values), v), i * stride)), lambda p: p.isNotNull())  # noqa: B023
                hits = F.array_union(hits, at)

            def share(p: Column) -> Column:
                begin = F.greatest(p - (length - 1), F.lit(0))  # noqa: B023
                near = F.slice(h, begin + 1, F.lit(size + 2 * (length - 1)))  # noqa: B023
                return F.struct((F.size(F.array_intersect(_longs(distinct), near)) / len(distinct)).alias("containment"), (-p).alias("place"))  # noqa: B023

            best = F.array_max(F.transform(hits, share))
            found.append(F.struct(F.lit(name).alias("license"), best["containment"].alias("containment"), (-best["place"]).cast("int").alias("first_word")))
        kept = F.filter(F.array(*found), lambda x: x["containment"] >= least)
        return F.when(F.size(h) > 0, F.when(met, kept))

    every = sorted({v for x in listed for v in x[2]})

    def scan(h: Column) -> Column:
        # a text without any template's shingle contains no share of one, so its bands need not be made
        return F.when(F.arrays_overlap(h, _longs(every)), let(F.array(*[minima(h, c, b) for c, b in used]), lambda m: verify(h, m)))

    hashes = shingle_hashes(word_hashes(normalised(text)))
    empty = F.array().cast("array<struct<license:string,containment:double,first_word:int>>")
    return F.coalesce(let(hashes, scan), empty)


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = CONTAINMENT) -> DataFrame:
    """doc_id and matches (see license_matches) for each row of docs (doc_id, text).

    Null and empty texts hold no license. Repeated rows are scanned alike; other columns are not carried; an empty
    table gives no rows. A text is scanned whole, in its row: there is no shuffle.
    """
    return docs.select("doc_id", license_matches(F.col("text"), templates, least).alias("matches"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_distinct(F.transform("matches", lambda m: m["license"]))
    best = F.array_max(F.transform("matches", lambda m: m["containment"]))
    first = F.array_min(F.transform("matches", lambda m: m["first_word"]))
    return found.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("matches").alias("n_matches"), F.coalesce(best, F.lit(0.0)).alias("containment"), first.alias("first_word"))
