"""License scan: word-bigram Dice coefficient against license templates, with size bounds.

Texts are normalised (lower case; every run of other characters than letters and digits of ASCII is one space) and
compared by line, by sentence (where a line has several), by block (lines between blank lines, where a block has several
lines) and as a whole (where it has several blocks). A license text of several paragraphs is a template as a whole and by
paragraph, so it is also found paragraph by paragraph on top of a longer text. For a unit with a bigrams and a template with b, Dice is 2 * shared / (a + b), bigrams counted with
repeats. Dice of at least t needs t/(2-t) * b <= a <= (2-t)/t * b, so units outside the bounds of all templates are
dropped before their bigrams are made, and the bounds of each template are part of the join. Such a unit also shares
t/(2-t) * b bigrams at least, so it has one of a few anchor words (see anchors()); texts and units without any are dropped
by plain substring tests, before anything is normalised or split. The templates' bigrams are
a fixed table of a few thousand rows and are broadcast; bigrams that no template has end in that join.

DataFrame functions only; no Python runs on the executors.

Nulls: null and empty texts have no match; null ids come back as null. Repeated rows are reported each. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PERCENT = 80
#: Words of a paragraph that is a template of its own.
LEAST_WORDS = 10
#: Words that make poor anchors.
COMMON = {"a", "an", "and", "any", "are", "be", "by", "for", "in", "is", "it", "not", "of", "or", "other", "that", "the", "this", "to", "with", "without"}

# License names and the usual wordings of notices and license texts.
NAMES = {
    "MIT": ["MIT License", "MIT license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
NOTICES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "This project is licensed under the {}.", "Distributed under the terms of the {}."]
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\nThe origin of this software must not be misrepresented; you must not claim that you wrote the original software.\n\nAltered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\nThis notice may not be removed or altered from any source distribution.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "All-Rights-Reserved": "All rights reserved.",
}


def bigrams(text: str) -> Counter:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))


def templates() -> list[tuple[str, Counter]]:
    """(license, bigrams with counts) of every wording: notices, whole texts, and the longer paragraphs of texts."""
    paragraphs = [(k, p) for k, t in TEXTS.items() for p in t.split("\n\n") if len(p.split()) >= LEAST_WORDS]
    texts = [(k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES] + list(TEXTS.items()) + paragraphs
    return list({(k, tuple(sorted(b.items()))): (k, b) for k, b in ((k, bigrams(t)) for k, t in texts)}.values())


def bounds(b: int, percent: int) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the coefficient with a template of b."""
    return -(-percent * b // (200 - percent)), (200 - percent) * b // percent


def anchors(found: list[tuple[str, Counter]], percent: int) -> list[str]:
    """Words of which any unit that reaches the coefficient holds at least one: for each template, the bigrams without
    an anchor are fewer than the shared bigrams needed. Chosen greedily, the word that serves most templates first."""
    chosen: list[str] = []
    bare = lambda b: Counter({g: c for g, c in b.items() if not any(w in chosen for w in g.split())})
    while True:
        left = [(rest, sum(rest.values()) + 1 - bounds(sum(b.values()), percent)[0]) for _, b in found if sum((rest := bare(b)).values()) >= bounds(sum(b.values()), percent)[0]]
        if not left:
            break
        gain: Counter = Counter()
        for rest, over in left:
            mine = Counter()
            for g, c in rest.items():
                for w in set(g.split()):
                    mine[w] += c
            gain.update({w: min(c, over) for w, c in mine.items()})
        chosen.append(max(gain, key=lambda w: (w not in COMMON, min(len(w), 5), gain[w], w)))  # short words are in most texts
    return chosen


def template_table(spark: SparkSession, found: list[tuple[str, Counter]], percent: int) -> DataFrame:
    rows = [(n, k, sum(b.values()), *bounds(sum(b.values()), percent), g, c) for n, (k, b) in enumerate(found) for g, c in b.items()]
    return spark.createDataFrame(rows, "template int, license string, size int, low int, high int, bigram string, times int")


def once(value: Column, use) -> Column:
    """use(value) with value computed once per row; a plain reference would be computed at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def units(text: Column) -> Column:
    """Lines, sentences of lines that have several, blocks of several lines, and the whole of several blocks: array of (unit,
    place, said)."""
    kind_of = "array<struct<unit:string,place:int,said:string>>"

    def made(kind: str, parts: Column, several: bool) -> Column:
        rows = F.transform(parts, lambda s, i: F.struct(F.lit(kind).alias("unit"), i.cast("int").alias("place"), s.alias("said")))
        return F.filter(rows, lambda r: r.said.contains("\n")) if several else rows

    def cut(plain: Column) -> Column:
        blocks = F.split(plain, "\n *\n[ \n]*", -1)
        more = once(blocks, lambda b: F.concat(made("block", b, True), F.when(F.size(b) > 1, made("text", F.array(plain), False)).otherwise(F.array().cast(kind_of))))
        return F.concat(made("line", F.split(plain, "\n", -1), False), more)

    # the end of a sentence is marked before signs go
    marked = F.regexp_replace(F.regexp_replace(F.lower(text), "[.!?]+[ \t]+", "\x01"), "[^a-z0-9\n\x01]+", " ")
    lines = F.filter(F.transform(F.split(marked, "\n", -1), lambda x: F.rtrim(x, F.lit(" \x01"))), lambda x: x.contains("\x01"))
    sentences = F.flatten(F.transform(lines, lambda x: F.split(x, "\x01", -1)))
    return F.concat(once(F.regexp_replace(F.lower(text), "[^a-z0-9\n]+", " "), cut), made("sentence", sentences, False))


def scan(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per unit that holds a license: doc_id, unit, place, license, shared, n_bigrams, template_bigrams, dice."""
    spark = docs.sparkSession
    found = templates()
    rows = template_table(spark, found, percent)
    sizes = sorted({sum(b.values()) for _, b in found})
    least, most = bounds(sizes[0], percent)[0], bounds(sizes[-1], percent)[1]
    words = sorted(anchors(found, percent), key=len, reverse=True)
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    docs = docs.filter(once(F.lower("text"), lambda t: any_of([t.contains(w) for w in words])))
    said = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode(units(F.col("text"))).alias("u"))
    said = said.filter(once(F.concat(F.lit(" "), F.translate("u.said", "\n", " "), F.lit(" ")), lambda t: any_of([t.contains(f" {w} ") for w in words])))
    said = said.select("doc_id", "row", "u.unit", "u.place", F.explode(F.array(F.filter(F.split("u.said", "[ \n]+"), lambda w: w != ""))).alias("words"))
    said = said.withColumn("n_bigrams", F.size("words") - 1).filter(F.col("n_bigrams").between(least, most))
    pairs = F.transform(F.sequence(F.lit(1), F.col("n_bigrams")), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    grams = said.select("doc_id", "row", "unit", "place", "n_bigrams", F.explode(pairs).alias("bigram"))
    hits = grams.join(F.broadcast(rows), ["bigram"]).filter(F.col("n_bigrams").between(F.col("low"), F.col("high")))
    key = ["doc_id", "row", "unit", "place", "n_bigrams", "template", "license", "size"]
    shared = hits.groupBy(*key, "bigram", "times").count().groupBy(*key).agg(F.sum(F.least("count", "times")).alias("shared"))
    shared = shared.filter(200 * F.col("shared") >= percent * (F.col("n_bigrams") + F.col("size")))
    dice = F.round(2.0 * F.col("shared") / (F.col("n_bigrams") + F.col("size")), 6)
    best = Window.partitionBy("doc_id", "row", "unit", "place").orderBy(F.col("dice").desc(), "template")
    out = shared.withColumn("dice", dice).withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return out.select("doc_id", "unit", "place", "license", F.col("shared").cast("int"), "n_bigrams", F.col("size").alias("template_bigrams"), "dice")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every line, sentence, block or text of documents that matches a license template."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def sql(percent: int = PERCENT) -> str:
    found = templates()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({n}, {quoted(k)}, {sum(b.values())}, {bounds(sum(b.values()), percent)[0]}, {bounds(sum(b.values()), percent)[1]}, {quoted(g)}, {c})" for n, (k, b) in enumerate(found) for g, c in b.items())
    return rf"""
WITH t(template, license, size, low, high, bigram, times) AS (VALUES {values}),
p AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g') AS plain,
  regexp_replace(regexp_replace(lower(text), '[.!?]+[ \t]+', chr(1), 'g'), '[^a-z0-9\n\x01]+', ' ', 'g') AS marked FROM documents),
b AS (SELECT doc_id, plain, string_split_regex(plain, '\n *\n[ \n]*') AS blocks,
  flatten(list_transform(list_filter(list_transform(string_split(marked, chr(10)), lambda x: rtrim(x, ' ' || chr(1))), lambda x: contains(x, chr(1))), lambda x: string_split(x, chr(1)))) AS sentences FROM p),
u AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(plain, chr(10))))) AS place, unnest(string_split(plain, chr(10))) AS said FROM b
  UNION ALL SELECT * FROM (SELECT doc_id, 'block', unnest(range(len(blocks))), unnest(blocks) AS said FROM b) WHERE contains(said, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, plain FROM b WHERE len(blocks) > 1
  UNION ALL SELECT doc_id, 'sentence', unnest(range(len(sentences))), unnest(sentences) FROM b),
w AS (SELECT doc_id, unit, place, list_filter(string_split_regex(said, '[ \n]+'), lambda x: x <> '') AS words FROM u),
n AS (SELECT *, len(words) - 1 AS n_bigrams FROM w),
g AS (SELECT doc_id, unit, place, n_bigrams, unnest(list_transform(range(1, n_bigrams + 1), lambda i: words[i] || ' ' || words[i + 1])) AS bigram
      FROM n WHERE n_bigrams BETWEEN (SELECT min(low) FROM t) AND (SELECT max(high) FROM t)),
c AS (SELECT doc_id, unit, place, n_bigrams, template, license, size, bigram, times, count(*) AS k FROM g JOIN t USING (bigram)
      WHERE n_bigrams BETWEEN low AND high GROUP BY ALL),
s AS (SELECT doc_id, unit, place, n_bigrams, template, license, size, sum(least(k, times)) AS shared FROM c GROUP BY ALL),
r AS (SELECT *, round(2.0::DOUBLE * shared / (n_bigrams + size), 6) AS dice FROM s WHERE 200 * shared >= {percent} * (n_bigrams + size)),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, template) AS rn FROM r)
SELECT doc_id, unit, place::INTEGER AS place, license, shared::INTEGER AS shared, n_bigrams::INTEGER AS n_bigrams, size::INTEGER AS template_bigrams, dice FROM z WHERE rn = 1
"""
