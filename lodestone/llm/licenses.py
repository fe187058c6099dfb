"""License scans (operator 4), in DataFrame functions only.

Each template of the catalog is a set of five-word shingles (a shorter one is a single shingle of all its words). Windows
of about a template's length slide over a text with an overlap; window and template have MinHash signatures, and a
window retrieves the templates with which it agrees in all rows of one band. The number of bands follows from the least
similarity that a window with the wanted containment can have, so that the chance to miss it stays below MISS. Retrieved
windows are verified by the exact share of the template's shingles that they contain.

A band can only agree if the window has the template's smallest shingle of that band. So signatures are computed where
such a shingle (an anchor) occurs; all other windows are known to retrieve nothing. One pass hashes the shingles of a
text and keeps it only if an anchor occurs; no text is shuffled.

Edge cases: null and word-less texts match nothing; a text shorter than a window is one window; rows with the same id
are one document, as are rows without an id; a text with equally good windows reports the first one; an empty table gives an empty table; further
columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, CONTAINMENT, MISS, ROWS = 5, 0.8, 1e-6, 2
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Notices of public licences.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-short": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions:"
    ),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "rights-reserved": "All rights reserved.",
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row, however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def shingles_of(words: Column, k: int, make) -> Column:
    """make(column of each of k neighbouring words) for each place; empty where there are fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(places, lambda i: make(*[F.get(words, i + j) for j in range(k)])))


def hashes_of(words: Column, k: int) -> Column:
    return shingles_of(words, k, F.xxhash64)


def strings_of(words: Column, k: int) -> Column:
    return F.array_distinct(shingles_of(words, k, lambda *w: F.concat_ws(" ", *w)))


def with_k(f, k: int):
    """f(words, k) as a function of the words alone."""
    return lambda words: f(words, k)


def signature(hashes: Column, functions: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), lambda i: F.array_min(F.transform(hashes, lambda x: F.xxhash64(i, x))))


def window_of(words: int) -> tuple[int, int]:
    """Length and stride of the windows for a template of so many words."""
    slack = words // 4 if words >= 16 else 0
    return words + slack, max(1, slack)


def bands_needed(containment: float = CONTAINMENT, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a window with the wanted containment agrees with its template in one, but for a chance of `miss`.

    A window of 5/4 of the template's length that has a share c of its shingles has a similarity of c / (5/4 + 1 - c) at least.
    """
    similarity = containment / (1.25 + 1 - containment)
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def catalog(spark: SparkSession, templates: dict[str, str] | None = None, bands: int | None = None) -> DataFrame:
    """One row a template: name, k, length, stride, shingles, signature and the anchors of its bands."""
    rows = []
    for name, text in sorted((TEMPLATES if templates is None else templates).items()):
        n = sum(1 for w in "".join(c if c.isalnum() else " " for c in text).split())
        if n:
            length, stride = window_of(n)
            rows.append((name, text, min(SHINGLE, n), length, stride))
    bands = bands or bands_needed()
    base = spark.createDataFrame(rows, "license string, template string, k int, length int, stride int")
    parts = []
    for k in range(1, SHINGLE + 1):
        own = base.where(F.col("k") == k).withColumn("words", words_of(F.col("template")))
        made = own.select("license", "k", "length", "stride", let(F.col("words"), with_k(strings_of, k)).alias("shingles"), let(F.col("words"), with_k(hashes_of, k)).alias("hashes"))
        signed = made.withColumn("signature", let(F.col("hashes"), lambda h: signature(h, bands * ROWS)))
        # The anchor of a band: the shingle whose hash is smallest under the band's first function.
        smallest = lambda h: F.array_distinct(
            F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.get(F.array_sort(F.transform(h, lambda x: F.struct(F.xxhash64(b * ROWS, x).alias("v"), x.alias("x")))), F.lit(0))["x"])
        )
        parts.append(signed.withColumn("anchors", let(F.col("hashes"), smallest)).drop("hashes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """For each text and template with a window of the wanted containment: key, license, start_word, n_words, containment of the best window."""
    spark = df.sparkSession
    bands = bands_needed(containment)
    rows = catalog(spark, templates, bands).collect()  # the catalog is a parameter, not data
    known = spark.createDataFrame(rows, "license string, k int, length int, stride int, shingles array<string>, signature array<bigint>, anchors array<bigint>") if rows else None
    sizes = sorted({r["k"] for r in rows})
    texts = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    anchors = {k: sorted({a for r in rows if r["k"] == k for a in r["anchors"]}) for k in sizes}
    reach = max((r["length"] for r in rows), default=1)

    def literal(k: int) -> Column:
        return F.array(*[F.lit(a).cast("long") for a in anchors[k]])

    def overlaps(words: Column) -> Column:
        tests = [F.arrays_overlap(F.coalesce(hashes_of(words, k), F.array().cast("array<bigint>")), literal(k)) for k in sizes]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    if known is None:
        return texts.where("false").select(F.col("_key").alias(key), F.lit("").alias("license"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"), F.lit(0.0).alias("containment"))
    near = texts.where(let(words_of(F.col("_text")), overlaps))

    def by_k(make) -> Column:
        """make(k) for the row's k."""
        return F.coalesce(*[F.when(F.col("k") == k, make(k)) for k in sizes])

    def hits(words: Column) -> Column:
        """Anchors in the text and what stands around each."""

        def of(k: int) -> Column:
            def places(h: Column) -> Column:
                at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(literal(k), F.get(h, i)))
                begin = lambda i: F.greatest(i - reach, F.lit(0))
                context = lambda i: F.slice(words, begin(i) + 1, 2 * reach)
                return F.transform(at, lambda i: F.struct(F.lit(k).alias("k"), F.get(h, i).alias("anchor"), i.alias("at"), begin(i).alias("begin"), context(i).alias("context"), F.size(words).alias("size")))

            none = F.array().cast("array<struct<k:int,anchor:bigint,at:int,begin:int,context:array<string>,size:int>>")
            return F.when(F.size(words) >= k, let(hashes_of(words, k), places)).otherwise(none)

        return F.concat(*map(of, sizes))

    hit = near.select("_key", F.xxhash64("_text").alias("_copy"), F.explode(let(words_of(F.col("_text")), hits)).alias("hit")).select("_key", "_copy", "hit.*")
    own = known.select("*", F.explode("anchors").alias("anchor")).drop("anchors")
    met = hit.join(F.broadcast(own), ["k", "anchor"])  # the catalog's anchors
    last = F.greatest(F.col("size") - F.col("length"), F.lit(0))
    lowest = F.least(F.greatest(F.col("at") + F.col("k") - F.col("length"), F.lit(0)), last)
    # Windows start at multiples of the stride; the last one ends with the text.
    lower = F.ceil(lowest / F.col("stride")).cast("int")
    grid = F.sequence(lower, F.greatest(lower, F.floor(F.least("at", last) / F.col("stride")).cast("int")))
    inside = F.filter(F.transform(grid, lambda g: g * F.col("stride")), lambda s: (s >= lowest) & (s <= F.least("at", last)))
    starts = F.array_union(inside, F.when(F.col("at") >= last, F.array(last)).otherwise(F.array().cast("array<int>")))
    window = met.select("_key", "_copy", "license", "k", "length", "shingles", "signature", "begin", "context", F.explode(starts).alias("start"))
    window = window.withColumn("words", F.slice("context", F.col("start") - F.col("begin") + 1, F.col("length")))
    once = window.groupBy("_key", "_copy", "license", "start").agg(*[F.any_value(c).alias(c) for c in ("k", "words", "shingles", "signature")])
    signed = once.withColumn("_signature", let(by_k(lambda k: hashes_of(F.col("words"), k)), lambda h: signature(h, bands * ROWS)))
    same = lambda i: F.get("signature", i) == F.get("_signature", i)
    drawn = signed.where(F.exists(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: same(b * ROWS) & same(b * ROWS + 1)))
    share = F.size(F.array_intersect("shingles", by_k(lambda k: let(F.col("words"), with_k(strings_of, k))))) / F.size("shingles")
    verified = drawn.select("_key", "license", "start", F.size("words").alias("n"), share.alias("share")).where(F.col("share") >= containment - 1e-9)
    best = verified.groupBy("_key", "license").agg(F.max(F.struct(F.col("share"), (-F.col("start")).alias("start"), "n")).alias("b"))
    return best.select(F.col("_key").alias(key), "license", (-F.col("b.start")).alias("start_word"), F.col("b.n").alias("n_words"), F.round("b.share", 6).alias("containment"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def oracle(templates: dict[str, str] | None = None) -> str:
    """DuckDB: the best containment over all windows of the same grid, without signatures."""
    values = ", ".join("('" + n.replace("'", "''") + "', '" + t.replace("'", "''") + "')" for n, t in sorted((TEMPLATES if templates is None else templates).items()))
    words = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""
WITH t AS (SELECT license, {words.format('x')} AS w FROM (VALUES {values}) v(license, x)),
t2 AS (SELECT license, w, least({SHINGLE}, len(w)) AS k, len(w) + CASE WHEN len(w) >= 16 THEN len(w) // 4 ELSE 0 END AS length,
  CASE WHEN len(w) >= 16 THEN greatest(1, len(w) // 4) ELSE 1 END AS stride FROM t),
ts AS (SELECT DISTINCT license, k, length, stride, array_to_string(w[i:i + k - 1], ' ') AS s FROM t2, LATERAL (SELECT unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i)),
tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
d AS (SELECT doc_id, row_number() OVER () AS r, {words.format('text')} AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, r, len(w) AS size, k, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM d, (SELECT DISTINCT k FROM t2) ks, LATERAL (SELECT unnest(range(1, (len(w) - k + 2)::BIGINT)) AS i)),
hit AS (SELECT doc_id, r, size, pos, license, ts.k, length, stride, s, greatest(size - length, 0) AS last FROM ds JOIN ts USING (k, s)),
low AS (SELECT *, least(greatest(pos + k - length, 0), last) AS lowest FROM hit),
win AS (SELECT doc_id, r, size, license, length, s, unnest(list_distinct(list_concat(
  list_filter(list_transform(range(lowest // stride, (least(pos, last) // stride + 1)::BIGINT), lambda g: g * stride), lambda x: x >= lowest),
  CASE WHEN pos >= last THEN [last] ELSE [] END))) AS start FROM low),
got AS (SELECT doc_id, r, license, start, any_value(least(length, size)) AS n_words, count(DISTINCT s) AS c FROM win GROUP BY doc_id, r, license, start),
best AS (SELECT doc_id, license, start, n_words, c / n AS share,
  row_number() OVER (PARTITION BY doc_id, license ORDER BY c / n DESC, start) AS rn FROM got JOIN tn USING (license) WHERE c / n >= {CONTAINMENT} - 1e-9)
SELECT doc_id, license, start::INTEGER AS start_word, n_words::INTEGER AS n_words, round(share, 6) AS containment FROM best WHERE rn = 1"""
