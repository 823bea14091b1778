"""Operator 3: licence scans with DataFrame functions only.

Each line of a text, and the whole text where it has several, is a unit. Units and
templates are normalised (ASCII lower case, all else than letters and digits a
blank) and become sets of word bigrams. A template is compared with a unit only if
their sizes allow a Dice coefficient of `threshold`; of those that reach it the unit
counts for the one with the largest, and among equals for the first by id.

A notice may be wrapped over lines. So a template that no unit counts for is compared with
windows of two or more consecutive lines too (lines without words left out): those of no
more bigrams, repeats counted, than its size allows, which begin and end with a line that has
a bigram of the template. The best window counts if it reaches the threshold. Only templates of
which the whole text has enough bigrams are looked for so.

A set of words, chosen so that text without any of them cannot reach the threshold for any
template, tells beforehand which texts and lines need comparing.

Defined cases: a null or empty text has no units and no licences; units and
templates of fewer than two words have no bigrams and match nothing; repeated rows
each give a row; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

THRESHOLD, MAX_TEMPLATES = 0.8, 256
# Short public licence notices, and two licences in full.
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": _APACHE,
    "bsd-2-clause-full": f"{_BSD} {_DISCLAIMER}",
    "bsd-3-clause-full": f"{_BSD} {_THIRD} {_DISCLAIMER}",
    "gpl-3.0-header": _GPL,
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Licensed under the BSD 2-Clause License.",
    "bsd-3-clause": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-full": f"{_GRANT} {_NOTICE} {_WARRANTY}",
    "mit-grant": _GRANT,
    "mit-warranty": _WARRANTY,
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
_BIGRAM = "(?<![a-z0-9])(?=([a-z0-9]+ [a-z0-9]+))"


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a normalised template, sorted."""
    words = re.findall(r"[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def keywords(sets: list[list[str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which every text has one that reaches the threshold for one of some sets of bigrams. Such a
    text has threshold / (2 - threshold) of the bigrams; so the words are in more of each set's bigrams than
    may be missing. Long and frequent words of a set go first."""
    chosen: set[str] = set()
    for grams in sorted(sets, key=len):
        missing = len(grams) * (1 - threshold / (2 - threshold))
        words = {w for g in grams for w in g.split()}
        worth = sorted(words, key=lambda w: (len(w) < 4, -min(len(w), 7), -sum(w in g.split() for g in grams), w))
        for w in worth:
            if sum(any(x in chosen for x in g.split()) for g in grams) > missing:
                break
            chosen.add(w)
    return sorted(chosen)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, hits (id and Dice coefficient of each matching unit)."""
    sets = [(i, grams) for i, text in sorted((templates or TEMPLATES).items()) if (grams := bigrams(text))]
    if len(sets) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    if not sets:
        return docs.select("doc_id", F.array().cast("array<struct<dice:double,id:string>>").alias("hits"))
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(-k).alias("rank"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for k, (i, g) in enumerate(sets)])
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold
    low, high = min(len(g) for _, g in sets) * least, max(len(g) for _, g in sets) * most
    mark = "(?<![a-z0-9])(?:" + "|".join(keywords([g for _, g in sets], threshold)) + ")(?![a-z0-9])"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = C.texts(docs).select("doc_id", F.regexp_replace(F.translate("text", upper, lower), "[^a-z0-9\n]+", " ").alias("text"))

    def grams_of(text):
        return F.array_distinct(F.regexp_extract_all(text, F.lit(_BIGRAM), F.lit(1)))

    def dice_of(grams, t):
        return 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])

    def best(grams):
        near = F.filter(known, lambda t: (F.size(grams) >= t["n"] * F.lit(least)) & (F.size(grams) <= t["n"] * F.lit(most)))
        dice = F.transform(near, lambda t: F.struct(dice_of(grams, t).alias("dice"), t["rank"].alias("rank"), t["id"].alias("id")))
        return F.array_max(F.filter(dice, lambda d: d["dice"] >= threshold))

    # texts without a keyword are done; of the others, lines without one
    may = F.col("text").rlike(mark)
    lines = F.filter(F.split("text", "\n"), lambda u: u.rlike(mark))
    whole = F.regexp_replace("text", "[ \n]+", " ")
    several = F.col("text").contains("\n")
    units = F.concat(lines, F.when(several, F.array(whole)).otherwise(F.array().cast("array<string>")))
    sized = F.filter(F.transform(units, grams_of), lambda g: (F.size(g) >= low) & (F.size(g) <= high))
    none = F.array().cast("array<struct<dice:double,rank:int,id:string>>")
    first = plain.select("doc_id", "text", may.alias("may"), F.when(may, F.filter(F.transform(sized, best), lambda h: h.isNotNull())).otherwise(none).alias("hits"))

    # templates of which the text has enough, and that no unit counted for, by windows of lines
    every = F.when(F.col("may") & several, grams_of(whole))
    wanted = F.filter(known, lambda t: (F.size(F.array_intersect(t["grams"], F.col("every"))) >= t["n"] * F.lit(least)) & ~F.exists("hits", lambda h: h["id"] == t["id"]))
    told = F.transform(F.filter(F.split("text", "\n"), lambda u: u.rlike("[a-z0-9]")), lambda u: F.trim(u))
    cut = first.withColumn("every", every).withColumn("wanted", F.when(F.col("every").isNotNull(), wanted))
    some = F.size(F.coalesce("wanted", F.array().cast(_KNOWN))) > 0
    cut = cut.withColumn("lines", F.when(some, told)).withColumn("grams", F.when(some, F.transform("lines", grams_of)))
    cut = cut.withColumn("words", F.when(some, F.transform("lines", lambda u: F.size(F.regexp_extract_all(u, F.lit("[a-z0-9]+"), F.lit(0))))))

    def windows(t):
        holds = F.filter(F.transform("grams", lambda g, k: F.when(F.arrays_overlap(g, t["grams"]), k)), lambda k: k.isNotNull())
        last = (F.floor(t["n"] * F.lit(most)) + 1).cast("int")  # words of the largest window

        def from_(i):
            ends = F.filter(holds, lambda j: (j > i) & (j < i + last))
            fit = F.filter(ends, lambda j: F.aggregate(F.slice("words", i + 1, j - i + 1), F.lit(0), lambda a, w: a + w) <= last)
            return F.transform(fit, lambda j: dice_of(grams_of(F.array_join(F.slice("lines", i + 1, j - i + 1), " ")), t))

        found = F.array_max(F.flatten(F.transform(holds, from_)))
        return F.struct(found.alias("dice"), t["rank"].alias("rank"), t["id"].alias("id"))

    wrapped = F.when(some, F.filter(F.transform("wanted", windows), lambda h: h["dice"] >= threshold)).otherwise(none)
    return cut.select("doc_id", F.transform(F.concat("hits", wrapped), lambda h: F.struct(h["dice"].alias("dice"), h["id"].alias("id"))).alias("hits"))


_KNOWN = "array<struct<id:string,rank:int,n:int,grams:array<string>>>"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(C.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("hits").cast("long").alias("n_hits"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["id"]))), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def _oracle() -> str:
    rows = ", ".join("('{}', [{}])".format(i, ", ".join(f"'{g}'" for g in bigrams(t))) for i, t in sorted(TEMPLATES.items()))
    return f"""
WITH t(id, grams) AS (VALUES {rows}),
plain AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g') AS text FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10)) || CASE WHEN contains(text, chr(10)) THEN [translate(text, chr(10), ' ')] ELSE [] END) AS unit FROM plain),
split AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(unit, '[a-z0-9]+') AS w FROM units),
grams AS (SELECT u, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM split WHERE len(w) > 1),
hits AS (
  SELECT u, doc_id, id, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM grams, t),
best AS (
  SELECT u, any_value(doc_id) AS doc_id, arg_max(id, (dice, -rank)) AS id, max(dice) AS dice
  FROM (SELECT *, dense_rank() OVER (ORDER BY id) AS rank FROM hits WHERE dice >= {THRESHOLD}) GROUP BY u),
whole AS (SELECT doc_id, regexp_extract_all(translate(text, chr(10), ' '), '[a-z0-9]+') AS w FROM plain WHERE contains(text, chr(10))),
every AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM whole WHERE len(w) > 1),
wanted AS (
  SELECT every.doc_id, t.id, t.grams FROM every, t WHERE len(list_intersect(g, grams)) >= len(grams) * ({THRESHOLD} / (2 - {THRESHOLD}))
    AND NOT EXISTS (SELECT 1 FROM best WHERE best.doc_id = every.doc_id AND best.id = t.id)),
ranked AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, regexp_extract_all(line, '[a-z0-9]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM plain WHERE doc_id IN (SELECT doc_id FROM wanted))
  WHERE regexp_matches(line, '[a-z0-9]')),
edges AS (
  SELECT x.doc_id, x.id, x.grams, n FROM wanted x JOIN ranked r ON x.doc_id = r.doc_id
  WHERE len(list_intersect(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), grams)) > 0),
joined AS (
  SELECT a.doc_id, a.id, a.grams, a.n AS i, b.n AS j, flatten(list(r.w ORDER BY r.n)) AS w
  FROM edges a JOIN edges b ON a.doc_id = b.doc_id AND a.id = b.id AND b.n > a.n AND b.n - a.n <= len(a.grams) * ((2 - {THRESHOLD}) / {THRESHOLD})
  JOIN ranked r ON r.doc_id = a.doc_id AND r.n BETWEEN a.n AND b.n GROUP BY ALL),
windows AS (
  SELECT doc_id, id, grams, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g
  FROM joined WHERE len(w) <= floor(len(grams) * ((2 - {THRESHOLD}) / {THRESHOLD})) + 1),
wrapped AS (SELECT doc_id, id, max(2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams))) AS dice FROM windows GROUP BY doc_id, id),
counted AS (SELECT doc_id, id, dice FROM best UNION ALL SELECT doc_id, id, dice FROM wrapped WHERE dice >= {THRESHOLD}),
told AS (SELECT doc_id, count(*) AS n_hits, string_agg(DISTINCT id, ',' ORDER BY id) AS licenses, max(dice) AS best_dice FROM counted GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(licenses, '') AS licenses, coalesce(best_dice, 0.0)::DOUBLE AS best_dice
FROM documents d LEFT JOIN told ON d.doc_id = told.doc_id"""


QUERIES = {"op3_license_scan": query}
ORACLES = {"op3_license_scan": _oracle()}
