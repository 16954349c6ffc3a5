"""Licence scans: parts of texts are compared with licence templates by the Dice coefficient over their word bigrams.

The parts of a text are its lines, its sentences, its paragraphs (between lines without a letter or digit, so that of a comment they are
found, too) and the whole of it. Both sides are normalised: ASCII letters are lower-cased
and all but ASCII letters and digits separates words. For sets of bigrams A and B, Dice is 2 |A & B| / (|A| + |B|), so a template
of size s can reach t only with parts of sizes from s t / (2 - t) to s (2 - t) / t. The admissible (size, template) rows are a
small fixed table, and an equi-join on the size prunes the candidates before any bigram is compared. Before that, parts without any of a few words, of which each match needs one, are left out.

Only DataFrame functions are used; no row is shuffled but the findings.

Defined cases: a null text has no parts; a part with fewer than two words has no bigrams and no licence; a part equally like two
templates goes to the first name; rows that repeat a doc_id are reported together; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents

THRESHOLD = 0.8
#: Words that say little about a text; they are no signals.
_COMMON = set("a and any as be by for from in is it of on or that the this to with you".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PERMISSION = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:"""
_CONDITION = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""


def _gpl(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by
    the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""


#: (licence, text): fixed values, the public wording of licences and of the notices by which works name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", f"{_PERMISSION} {_CONDITION} {_AS_IS}"), ("MIT", _PERMISSION), ("MIT", _AS_IS),
    ("ISC", f"{_ISC} {_ISC_AS_IS}"), ("ISC", _ISC), ("BSD", _BSD), ("Apache-2.0", _APACHE),
    ("GPL-2.0", _gpl("GNU General Public License", "2")), ("GPL-3.0", _gpl("GNU General Public License", "3")),
    ("LGPL-3.0", _gpl("GNU Lesser General Public License", "3")), ("AGPL-3.0", _gpl("GNU Affero General Public License", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    *((name, f"{verb} under {what}.") for verb in ("Licensed", "Released", "Distributed", "This work is licensed") for name, what in (
        ("MIT", "the MIT License"), ("ISC", "the ISC License"), ("BSD", "the BSD License"), ("Apache-2.0", "the Apache License, Version 2.0"),
        ("GPL-2.0", "the GNU General Public License, version 2"), ("GPL-3.0", "the GNU General Public License, version 3"),
        ("LGPL-3.0", "the GNU Lesser General Public License, version 3"), ("AGPL-3.0", "the GNU Affero General Public License, version 3"),
        ("MPL-2.0", "the Mozilla Public License, version 2.0"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"),
        ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    )),
)


def template_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a normalised text."""
    w = re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def size_bounds(n: int, threshold: float = THRESHOLD) -> range:
    """The sizes of sets that can reach the threshold with a set of n."""
    least = math.ceil(n * threshold / (2 - threshold) - 1e-9)
    return range(max(1, least), math.floor(n * (2 - threshold) / threshold + 1e-9) + 1)


def signals(threshold: float = THRESHOLD) -> list[str]:
    """Words of which a part must have one to reach the threshold with any template: at most a share of
    (2 - 2 t) / (2 - t) of a template's bigrams may be missing, and more than that have one of these words."""
    open_ = [template_bigrams(t) for _, t in TEMPLATES]
    may_miss = [math.floor(len(g) * (2 - 2 * threshold) / (2 - threshold) + 1e-9) for g in open_]
    chosen: list[str] = []
    while True:
        gains: dict[str, int] = {}
        for g, m in zip(open_, may_miss, strict=True):
            rest = {x for x in g if not set(x.split()) & set(chosen)}
            if len(g) - len(rest) <= m:
                for word in {w for x in rest for w in x.split() if w not in _COMMON}:
                    gains[word] = gains.get(word, 0) + 1
        if not gains:
            return chosen
        chosen.append(min(gains, key=lambda w: (-min(len(w), 7), -gains[w], w)))  # long words are rare in other texts


#: What stands between paragraphs and between sentences.
_PARAGRAPH, _SENTENCE = r"\n[^A-Za-z0-9\n]*\n", r"[.!?][ \t\r\n\f\x0B]+"


def parts(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, bigrams: the distinct bigrams of each part that has some and may reach the threshold."""
    text = F.col("text").cast("string")
    signal = " OR ".join(f"contains(lower({{0}}), '{w}')" for w in signals(threshold))
    likely = docs.where(F.expr(signal.format("CAST(text AS STRING)")))
    units = likely.select("doc_id", F.explode(F.array_distinct(F.concat(F.array(text), *[F.split(text, by) for by in (_PARAGRAPH, _SENTENCE, "\n")]))).alias("part")).where(F.expr(signal.format("part")))
    words = "split(trim(BOTH ' ' FROM lower(regexp_replace(part, '[^A-Za-z0-9]+', ' '))), ' ')"
    # The words are bound to a variable first: written out in the inner function they would be split anew for each bigram.
    pairs = f"transform(array({words}), w -> array_distinct(transform(sequence(0, greatest(size(w) - 2, 0)), i -> concat(w[i], ' ', get(w, i + 1)))))[0]"
    return units.select("doc_id", F.expr(pairs).alias("bigrams")).where("bigrams[0] IS NOT NULL")


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice (of its likest part) and n_parts, for each licence found in a document."""
    spark = docs.sparkSession
    rows = [(size, name, grams) for name, t in TEMPLATES for grams in [template_bigrams(t)] for size in size_bounds(len(grams), threshold)]
    admissible = spark.createDataFrame(rows, "size int, licence string, template array<string>")
    sized = parts(docs, threshold).withColumn("size", F.size("bigrams"))
    dice = F.expr("2D * size(array_intersect(bigrams, template)) / (size + size(template))")
    best = F.expr("min_by(struct(licence, dice), struct(-dice, licence))")
    likely = sized.join(F.broadcast(admissible), "size").withColumn("dice", dice).where(F.col("dice") >= threshold)
    by_part = likely.groupBy("doc_id", "bigrams").agg(best.alias("b"))
    return by_part.groupBy("doc_id", F.col("b.licence").alias("licence")).agg(F.max("b.dice").alias("dice"), F.count("*").alias("n_parts"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).withColumn("dice", F.round("dice", 6))


def _sql() -> str:
    values = ", ".join(f"('{name}', [{', '.join(chr(39) + g + chr(39) for g in template_bigrams(t))}])" for name, t in TEMPLATES)
    return rf"""
WITH t(licence, template) AS (VALUES {values}),
u AS (SELECT DISTINCT doc_id, unnest(list_concat([text], string_split(text, chr(10)), regexp_split_to_array(text, '{_PARAGRAPH}'), regexp_split_to_array(text, '{_SENTENCE}'))) AS part FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, regexp_extract_all(translate(part, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+') AS w FROM u),
b AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM w WHERE len(w) > 1),
d AS (SELECT doc_id, g, licence, 2.0::DOUBLE * len(list_intersect(g, template)) / (len(g) + len(template)) AS dice FROM b JOIN t ON len(g) BETWEEN ceil(len(template) * {THRESHOLD / (2 - THRESHOLD)} - 1e-9) AND floor(len(template) * {(2 - THRESHOLD) / THRESHOLD} + 1e-9)),
k AS (SELECT doc_id, g, licence, dice, row_number() OVER (PARTITION BY doc_id, g ORDER BY dice DESC, licence) AS r FROM d WHERE dice >= {THRESHOLD})
SELECT doc_id, licence, round(max(dice), 6) AS dice, count(*) AS n_parts FROM k WHERE r = 1 GROUP BY doc_id, licence
"""


ORACLE_SQL = _sql()
