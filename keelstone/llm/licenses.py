"""License scans: MinHash bands over overlapping windows, then exact containment.

Texts are cut into lower-case words; windows of `WINDOW` words begin every
`STRIDE`. Each window's shingles of `SHINGLE` words are hashed, and the bands of its
MinHash, one row each, are the least and the greatest of the hashes under the
permutations x -> x xor c (the greatest is the least under the complement of c).
Templates have windows at every word, texts only where a window holds a template's
shingle: a band is one of the window's own hashes, so others share none. A window that shares a band with a template's
window retrieves that template; the template is reported if at least `CONTAINED` of
its distinct shingles, as words, lie in the text around the window.

With r = 1 rows a band and b = 2 * `PERMUTATIONS` bands, windows of Jaccard
similarity J meet with probability 1 - (1 - J)^b where bands are independent. Those of
xor permutations are not quite: over all notices with one word replaced, the tests
measure how many are found. A verbatim template of
five words lies whole in some window and has J >= 3/7: 0.9988 for 12 bands. One of
WINDOW + STRIDE - 1 words or more holds a whole window, which equals a template
window: 1.

Everything is one projection of native functions: no shuffle, no join, no Python
on the executors. Templates are literals of the plan up to `MAX_LITERAL_WORDS` words of
all together. Longer lists are a table: the bands of texts' windows meet those of the
templates' windows in an equi-join, and the same containment check follows.

Defined results: null and empty texts, and texts of fewer words than a shingle,
match nothing (a template has at least `SHINGLE` words); repeated rows are each
reported; null ids are kept; a template that occurs twice is reported once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.session import stored

SHINGLE = 3
WINDOW = 9
STRIDE = 5
PERMUTATIONS = 6
CONTAINED = 0.8
#: Most words of all templates together that become literals of the plan, and that are broadcast as a table.
MAX_LITERAL_WORDS = 20_000
MAX_BROADCAST_WORDS = 2_000_000

#: Notices that licenses ask for, and sentences that mark them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced"),
)
_WORD = re.compile(r"[a-z0-9\u0080-￿]+")


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def words(text: Column) -> Column:
    """The lower-case words of a text, as an array; empty for null."""
    cleaned = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\x{80}-\\x{10ffff}]+", " "))
    return F.filter(F.split(cleaned, " "), lambda w: w != "")


def shingle_hashes(w: Column) -> Column:
    """One hash for each whole shingle, in order."""
    every = F.transform(w, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, SHINGLE))))
    return F.slice(every, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0)))


def constants(n: int = PERMUTATIONS) -> list[int]:
    """The permutations: 0, then a fixed sequence of 64-bit numbers."""
    out, x = [0], 0x2545F4914F6CDD1D
    while len(out) < n:
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        y = (x ^ x >> 31) * 0x9E3779B97F4A7C15 % 2**64
        out.append(y - 2**64 if y >> 63 else y)
    return out


def permuted(hashes: Column) -> list[Column]:
    """The hashes under each permutation."""
    return [hashes if c == 0 else F.transform(hashes, _xor(c)) for c in constants()]


def _xor(c: int):
    return lambda x: x.bitwiseXOR(F.lit(c))


def bands(hashes: Column) -> Column:
    """A window's bands. Band numbers need no tag: equal values of two bands would need
    shingles that differ by a given constant."""
    return F.array(*[f(y) for y in permuted(hashes) for f in (F.array_min, F.array_max)])


def _template_hashes(spark, texts: list[list[str]]) -> list[int]:
    """The distinct shingle hashes of all templates, by the expression that texts go through."""
    df = spark.createDataFrame([(w,) for w in texts], "w array<string>").select(F.explode(shingle_hashes(F.col("w"))).alias("h")).distinct()
    return sorted(r.h for r in df.collect())  # one a word of the templates at most


def _template_bands(spark, texts: list[list[str]]) -> list[set[int]]:
    """The bands of all windows of each template, by the same expressions that texts go through."""
    rows = [(t, w[i : i + WINDOW]) for t, w in enumerate(texts) for i in range(max(1, len(w) - WINDOW + 1))]
    df = spark.createDataFrame(rows, "t int, w array<string>").select("t", F.explode(bands(shingle_hashes(F.col("w")))).alias("k")).distinct()
    out: list[set[int]] = [set() for _ in texts]
    for r in df.collect():  # the windows of MAX_LITERAL_WORDS words at most
        out[r.t].add(r.k)
    return out


def contained_share(mine: Column, n: Column, w: Column, p: Column) -> Column:
    """The share of a template's distinct shingles (of n words) in the words around the window at p."""
    first = F.greatest(p - n, F.lit(0))
    around = F.slice(w, first + 1, p - first + WINDOW + n)

    def share(near: Column) -> Column:
        here = F.transform(F.sequence(F.lit(1), F.greatest(F.size(near) - (SHINGLE - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(near, i, SHINGLE)))
        return F.size(F.array_intersect(mine, here)) / F.size(mine)

    return F.get(F.transform(F.array(around), share), F.lit(0))  # around is cut once, not once a shingle


def _starts(h: Column, stride: int) -> Column:
    return F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def _windows(h: Column, starts: Column) -> Column:
    """Place and distinct bands of each window, as structs."""
    return F.transform(starts, lambda p: F.struct(p.alias("p"), F.array_distinct(bands(F.slice(h, p + 1, WINDOW - SHINGLE + 1))).alias("k")))


def _by_join(docs: DataFrame, templates, texts: list[list[str]], doc_id: str, text: str, contained: float) -> DataFrame:
    """scan() for templates that are too many for literals. Equal texts are searched once; only
    bands, places and, of texts with candidates, the words are joined."""
    spark = docs.sparkSession
    rows = [(t, name, w) for t, ((name, _), w) in enumerate(zip(templates, texts))]
    table = spark.createDataFrame(rows, "t int, license string, w array<string>")
    shingled = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, SHINGLE))))
    known = stored(table.select("t", "license", F.size("w").alias("n"), shingled.alias("mine"), shingle_hashes(F.col("w")).alias("h")), "templates")
    last = F.greatest(F.size("h") - (WINDOW - SHINGLE + 1), F.lit(0))  # the templates' windows are whole, as a text's are
    owners = known.select("t", F.explode(_windows(F.col("h"), F.sequence(F.lit(0), last))).alias("x")).select("t", F.explode("x.k").alias("k")).distinct()
    small = F.broadcast if sum(map(len, texts)) <= MAX_BROADCAST_WORDS else lambda df: df
    keyed = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("id"), words(F.col(text)).alias("w"))
    hashed = keyed.select("id", shingle_hashes(F.col("w")).alias("h"))
    each = hashed.select("id", F.explode(_windows(F.col("h"), _starts(F.col("h"), STRIDE))).alias("x")).select("id", "x.p", F.explode("x.k").alias("k"))
    met = each.join(small(owners), "k").select("id", "t", "p").distinct().groupBy("id", "t").agg(F.collect_list("p").alias("at"))
    texts_met = keyed.select("id", "w").join(met.groupBy("id").agg(F.collect_list(F.struct("t", "at")).alias("c")), "id").dropDuplicates(["id"])
    pairs = texts_met.select("id", "w", F.explode("c").alias("c")).select("id", "w", "c.t", "c.at").join(small(known.select("t", "license", "n", "mine")), "t")
    share = F.array_max(F.transform("at", lambda p: contained_share(F.col("mine"), F.col("n"), F.col("w"), p)))
    good = pairs.select("id", "license", "t", share.alias("share")).filter(F.col("share") >= contained)
    found = stored(good.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("license", F.col("t").alias("template"), F.col("share").alias("containment")))).alias("matches")), "license-matches")
    none = F.array().cast("array<struct<license:string,template:int,containment:double>>")
    return keyed.select("doc_id", "id").join(found, "id", "left").select("doc_id", F.coalesce("matches", none).alias("matches"))


def scan(docs: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text", contained: float = CONTAINED, literal_words: int = MAX_LITERAL_WORDS) -> DataFrame:
    """(doc_id, matches): per document the distinct licenses and templates found, as
    structs of license, template and containment."""
    texts = [template_words(t) for _, t in templates]
    if any(len(w) < SHINGLE for w in texts):
        raise ValueError(f"templates need {SHINGLE} words each")
    if sum(map(len, texts)) > literal_words:
        return _by_join(docs, templates, texts, doc_id, text, contained)
    keys = _template_bands(docs.sparkSession, texts)
    owners: dict[int, list[int]] = {}
    for t, ks in enumerate(keys):
        for k in ks:
            owners.setdefault(k, []).append(t)
    known = sorted(owners)
    of_key = F.map_from_arrays(F.array(*[F.lit(k) for k in known]), F.array(*[F.array(*[F.lit(t) for t in owners[k]]) for k in known]))
    whole = F.array(*[F.array(*[F.lit(g) for g in sorted({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})]) for w in texts])
    lengths = F.array(*[F.lit(len(w)) for w in texts])
    names = F.array(*[F.lit(n) for n, _ in templates])

    def share(t: Column, w: Column, p: Column) -> Column:
        """The share of template t's shingles in the words around the window at p."""
        return contained_share(F.get(whole, t), F.get(lengths, t), w, p)

    size = WINDOW - SHINGLE + 1
    ours = _template_hashes(docs.sparkSession, texts)
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), words(F.col(text)).alias("w")).select("doc_id", "w", shingle_hashes(F.col("w")).alias("h"))
    # a band of a window is the hash of one of its shingles, permuted: only windows that hold a
    # template's shingle can share a template's band, and only those are opened
    every = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1)).otherwise(F.array().cast("array<int>"))
    held = base.select("doc_id", "w", "h", F.when(F.exists("h", lambda x: x.isin(ours)), F.filter(every, lambda i: F.get("h", i).isin(ours))).otherwise(F.array().cast("array<int>")).alias("i"))
    last = lambda i: i - i % STRIDE
    around = F.transform("i", lambda i: F.filter(F.array(*[last(i) - k * STRIDE for k in range(size // STRIDE + 1)]), lambda p: (p >= 0) & (i - p < size)))
    near = held.select("doc_id", "w", "h", F.array_distinct(F.flatten(around)).alias("at"))
    met = F.filter(F.transform("at", lambda p: F.struct(p.alias("p"), F.filter(bands(F.slice("h", p + 1, size)), lambda k: k.isin(known)).alias("k"))), lambda m: F.size(m["k"]) > 0)
    found = near.select("doc_id", "w", met.alias("met"))
    verified = F.flatten(
        F.transform(
            "met",
            lambda s: F.transform(
                F.array_distinct(F.flatten(F.transform(s["k"], lambda k: F.element_at(of_key, k)))),
                lambda t: F.struct(t.alias("t"), share(t, F.col("w"), s["p"]).alias("share")),
            ),
        )
    )
    good = F.filter(F.array_distinct(verified), lambda v: v["share"] >= contained)
    best = F.transform(F.array_distinct(F.transform(good, lambda v: v["t"])), lambda t: F.struct(F.get(names, t).alias("license"), t.alias("template"), F.array_max(F.transform(F.filter(good, lambda v: v["t"] == t), lambda v: v["share"])).alias("containment")))
    return found.select("doc_id", F.when(F.size("met") > 0, F.array_sort(best)).otherwise(F.array().cast("array<struct<license:string,template:int,containment:double>>")).alias("matches"))


def digest_rows(found: DataFrame) -> DataFrame:
    """One row a document: how many templates it holds, and its licenses."""
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"))
