"""Licence scan by the Dice coefficient over word bigrams, with DataFrame functions only.

A document's units are its lines, its paragraphs and its whole text, normalised to lower-case words. A template can
reach a Dice coefficient of d only with between d / (2 - d) and (2 - d) / d times as many bigrams as the unit, so
templates are laid out once for every admissible size and a unit meets those of its own size alone. All bounds are on
numbers of distinct bigrams and in whole numbers, so nothing is lost at their edges.

A unit that matches a template can miss few of its bigrams. Of every template some words are picked that stand in more
bigrams than that, so a text without any of these words matches nothing and is not taken apart.

The template table is fixed below (its size does not depend on data), which is why it is broadcast.

Edge cases: null texts, and units of fewer than two words, match nothing; a document that matches nothing has no row;
equal units of a text count once in ``hits``, units of repeated rows once for each row; a null doc_id is a group of its
own. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

DICE = 0.8
#: Wordings of licence notices, of the paragraphs by which licence texts are known, and short licence texts whole.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "lgpl-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved."],
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing A-Z."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))


def plain_bigrams(text: str) -> list[tuple[str, str]]:
    """bigrams() of a template, on the driver."""
    w = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(zip(w, w[1:], strict=False)))


def sizes(of: int, least: Fraction) -> tuple[int, int]:
    """The fewest and most bigrams of a unit that can match a template with ``of`` of them."""
    return -(-of * least // (2 - least)), of * (2 - least) // least


def anchors(least: Fraction) -> list[str]:
    """Words of which every unit that matches a template holds one: in each template they are in more bigrams than a match can miss."""
    picked: list[str] = []
    for text in (t for texts in TEMPLATES.values() for t in texts):
        grams = plain_bigrams(text)
        misses = len(grams) - -(-least * (sizes(len(grams), least)[0] + len(grams)) // 2)
        own = sorted({w for g in grams for w in g}, key=lambda w: (w not in picked, -len(w), w))
        held: list[str] = []
        while sum(bool({*g} & {*held}) for g in grams) <= misses:
            held.append(own.pop(0))
        picked += [w for w in held if w not in picked]
    return picked


def templates(spark: SparkSession, least: Fraction) -> DataFrame:
    """A row for each template and each bigram count at which it can still match."""
    rows = [(name, i, text, *(int(x) for x in sizes(len(plain_bigrams(text)), least))) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    made = spark.createDataFrame(rows, "license string, template int, wording string, lo int, hi int").withColumn("grams", bigrams(words(F.col("wording"))))
    return made.select("license", "template", "grams", F.size("grams").alias("of"), F.explode(F.sequence("lo", "hi")).alias("n"))


def scan(docs: DataFrame, least: float = DICE) -> DataFrame:
    """doc_id, license, dice (the best unit's), hits (matching units) for every licence found in a document."""
    spark, exact = docs.sparkSession, Fraction(str(least))
    known = templates(spark, exact)
    most = max(int(sizes(len(plain_bigrams(t)), exact)[1]) for texts in TEMPLATES.values() for t in texts)
    named = "(?i)" + "|".join(anchors(exact))
    text = F.col("text").cast("string")
    units = F.array_union(F.split(text, "\n"), F.array_union(F.split(text, "\n[ \t\r]*\n"), F.array(text)))
    one = docs.where(text.rlike(named)).select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(units).alias("unit")).where((F.length("unit") >= 3) & F.col("unit").rlike(named))
    # n distinct bigrams have at most n + 1 distinct words, so a unit with more of them than that is no match; its length says nothing
    few = lambda w: (F.size(w) >= 2) & ((F.size(w) <= most + 1) | (F.size(F.array_distinct(w)) <= most + 1))
    own = F.transform(F.filter(F.array(words(F.col("unit"))), few), bigrams)
    near = one.select("doc_id", F.explode(own).alias("own")).withColumn("n", F.size("own"))
    met = near.join(F.broadcast(known), "n").withColumn("both", F.size(F.array_intersect("own", "grams")))
    enough = F.col("both") * 2 * exact.denominator >= (F.col("n") + F.col("of")) * exact.numerator
    found = met.where(enough).select("doc_id", "license", F.round(2 * F.col("both") / (F.col("n") + F.col("of")), 6).alias("dice"))
    return found.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("hits"))


def op5_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql() -> str:
    values = ", ".join(f"({_quoted(name)}, {i}, {_quoted(t)})" for name, texts in TEMPLATES.items() for i, t in enumerate(texts))
    words_of = "list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH t0(license, template, wording) AS (VALUES {values}),
t AS (SELECT license, template, {grams.format("w")} AS g FROM (SELECT *, {words_of.format("wording")} AS w FROM t0)),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), list_concat(string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text])))) AS unit FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, {grams.format("w")} AS g FROM (SELECT doc_id, {words_of.format("unit")} AS w FROM u WHERE length(unit) >= 3) WHERE len(w) >= 2),
m AS (SELECT doc_id, license, round(2.0 * len(list_intersect(d.g, t.g)) / (len(d.g) + len(t.g)), 6) AS dice FROM d JOIN t ON len(d.g) BETWEEN len(t.g) * {DICE / (2 - DICE)} - 1e-9 AND len(t.g) * {(2 - DICE) / DICE} + 1e-9)
SELECT doc_id, license, max(dice) AS dice, count(*) AS hits FROM m WHERE dice >= {DICE} GROUP BY doc_id, license"""


SQL = _sql()
