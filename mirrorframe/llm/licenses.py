"""License scans, with DataFrame operations only.

A file's candidates are its whole text, its blocks (runs of lines without a blank one between them, such as a header comment or a title) and its
single lines. Their terms are weighted by TF-IDF, and the cosine with each template decides which licence one states. Of the candidates that reach the threshold the widest
kind counts, and in it the best score: a complete BSD-3-Clause file is compared as a whole, third clause included. Templates are complete short licences, the notices that
long ones recommend for headers, their titles, and common one-line forms.

Licence files speak for their directory: those that the caller names, or else those whose whole text states a licence or that start with the title of one. A directory's licence is that of its first licence file (by id)
that states one. A file without a licence of its own inherits from the nearest ancestor directory that has one; headers of other files aren't inherited.

Document frequencies of the templates' terms are counted over all texts; a term that no template has weighs like one that no text has. Most candidates can be
passed over without loss: one that reaches the threshold must hold one of the terms that remain in some template once the terms that most texts have are
taken away as long as their norm stays below the threshold.

Plan: one pass counts terms (a row a term leaves each task), one writes ids, directories and the texts that can state a licence. Only those are exploded, keyed by row and candidate; templates are
literals of fixed size. Inheritance joins distinct directories, not files, with their ancestors.

Defined results: null or empty text has no own licence; a null path lies in the directory ''; of several best templates the first by name counts;
every row is a file of its own, also where ids repeat or are null; very long lines are candidates like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import stage, table

THRESHOLD = 0.7
TERM = "[^a-z0-9]+"
#: Blank lines part blocks.
BLANK = r"\n[ \t\r]*\n"
LINE, BLOCK, FILE = 0, 1, 2
#: Parts of licence texts.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
MIT_REST = """ (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL_TERMS = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
GPL_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
#: Complete short licences, notices as their licences recommend them, titles, and common short forms.
TEMPLATES = [
    ("AGPL-3.0", GPL_TERMS.format(3).replace("General", "Affero General")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", BSD_GRANT + BSD_REST),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", BSD_GRANT + BSD_THIRD + BSD_REST),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", BSD_THIRD),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", GPL_TERMS.format(2)),
    ("GPL-2.0", GPL_TERMS.format(2) + GPL_REST),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", GPL_TERMS.format(3)),
    ("GPL-3.0", GPL_TERMS.format(3) + GPL_REST),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", ISC),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", MIT_GRANT),
    ("MIT", MIT_GRANT + MIT_REST),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
]
#: Templates that stand at the start of a complete licence.
TITLES = {
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Boost Software License - Version 1.0 - August 17th, 2003",
    "Creative Commons Legal Code CC0 1.0 Universal",
    "Eclipse Public License - v 2.0",
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "Mozilla Public License Version 2.0",
    "This is free and unencumbered software released into the public domain.",
}


def terms_of(text: str) -> dict[str, int]:
    """Term counts of a template."""
    found: dict[str, int] = {}
    for t in re.split(TERM, text.lower()):
        if t:
            found[t] = found.get(t, 0) + 1
    return found


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms_of(text)})


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small fixed table as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def document_frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts, and how many hold each term of the vocabulary."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), TERM))
    found = F.array_append(F.array_intersect(words, F.array(*[F.lit(t) for t in VOCABULARY])), F.lit(" "))  # the blank counts texts
    counts = {r.term: r.n for r in files.select(F.explode(found).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop(" ", 0), counts


def required_terms(weights: list[dict[str, float]], threshold: float, df: dict[str, int]) -> set[str]:
    """Terms of which a candidate that reaches the threshold holds one at least: what is left of each template without its terms that most texts have, as far as their norm stays below the threshold."""
    out: set[str] = set()
    for w in weights:
        norm, dropped = sum(x * x for x in w.values()), 0.0
        for t, x in sorted(w.items(), key=lambda e: (-df.get(e[0], 0), e[1], e[0])):
            if dropped + x * x >= (0.999 * threshold) ** 2 * norm:
                out.add(t)
            else:
                dropped += x * x
    return out


class Weights:
    """TF-IDF weights of the templates, by the document frequencies of files."""

    def __init__(self, files: DataFrame, threshold: float):
        self.n, df = document_frequencies(files)
        self.idf = {t: math.log((1 + self.n) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.vectors = [{t: c * self.idf[t] for t, c in terms_of(text).items()} for _, text in TEMPLATES]
        self.norms = [math.sqrt(sum(x * x for x in v.values())) for v in self.vectors]
        self.needed = f"(^|[^a-z0-9])({'|'.join(sorted(required_terms(self.vectors, threshold, df)))})([^a-z0-9]|$)"
        self.unknown = math.log(1 + self.n) + 1


def own_licences(files: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """files: row (unique), text. (row, licence, score, kind, titled) of the files with a candidate that states a licence; titled: the first block is a licence's title."""
    spark, text = files.sparkSession, F.lower("text")
    of = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), ((i == 0) & F.lit(kind == BLOCK)).alias("head"), x.alias("words")))
    every = F.concat(of(FILE, F.array(text)), of(BLOCK, F.split(F.regexp_replace(text, r"^\s+", ""), BLANK)), of(LINE, F.split(text, "\n")))
    found = files.filter("text is not null").select("row", F.posexplode(F.filter(every, lambda x: x["words"].rlike(weights.needed))).alias("unit", "c"))
    terms = found.select("row", "unit", F.col("c.kind").alias("kind"), F.col("c.head").alias("head"), F.explode(F.split("c.words", TERM)).alias("term")).filter("term <> ''").groupBy("row", "unit", "kind", "head", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = _rows(spark, [{"term": t, "idf": x} for t, x in weights.idf.items()], "term: string, idf: double")
    sides = _rows(spark, [{"term": t, "template": k, "licence": TEMPLATES[k][0], "title": TEMPLATES[k][1] in TITLES, "unit_w": x / weights.norms[k]} for k, v in enumerate(weights.vectors) for t, x in v.items()], "term: string, template: int, licence: string, title: boolean, unit_w: double")
    weighted = stage(terms.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(weights.unknown))), "licence-terms")
    norm = weighted.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = weighted.join(F.broadcast(sides), "term").groupBy("row", "unit", "kind", "head", "template", "licence", "title").agg(F.sum(F.col("w") * F.col("unit_w")).alias("dot"))
    scored = dot.join(norm, ["row", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("kind")).alias("kind"), (-F.col("score")).alias("score"), "licence")).alias("b"), F.bool_or(F.col("head") & F.col("title")).alias("titled"))
    return best.select("row", F.col("b.licence").alias("licence"), (-F.col("b.score")).alias("score"), (-F.col("b.kind")).alias("kind"), "titled")


def ancestors(directory: Column) -> Column:
    """A directory and all above it, from the top, which is ''."""
    parts = F.split(directory, "/")
    return F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def scan_licences(files: DataFrame, *, id_col: str, directory: Column, text_col: str = "text", licence_file: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of files: id, directory, own_licence, own_score, licence and from_directory (the directory it is inherited from, null for its own).

    licence_file: which files speak for their directory, by their names for instance; by default those whose whole text states a licence or that start with the title of one.
    """
    files = files.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(directory, F.lit("")).alias("directory"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(licence_file, F.lit(False)).alias("speaks") if licence_file is not None else F.lit(None).cast("boolean").alias("speaks"))
    weights = Weights(files.select("text"), threshold)
    # Numbered once and written, so that the numbers stay; texts that can't state a licence are left out
    base = stage(files.select(F.monotonically_increasing_id().alias("row"), "id", "directory", "speaks", F.when(F.lower("text").rlike(weights.needed), F.col("text")).alias("text")), "licence-files")
    own = stage(own_licences(base.select("row", "text"), weights, threshold), "licences")
    named = base.select("row", "id", "directory", "speaks").join(own, "row", "left")
    of_directory = named.filter(F.col("licence").isNotNull() & F.coalesce("speaks", (F.col("kind") == FILE) | F.col("titled"))).groupBy("directory").agg(F.min(F.struct(F.col("id").isNull(), "id", "licence")).alias("first")).select("directory", F.col("first.licence").alias("given"))
    near = named.select("directory").distinct().select(F.col("directory").alias("below"), F.explode(ancestors(F.col("directory"))).alias("directory")).join(of_directory, "directory")
    near = near.groupBy(F.col("below").alias("directory")).agg(F.max_by(F.struct(F.col("directory").alias("from_directory"), "given"), F.length("directory")).alias("near"))
    out = named.join(near, "directory", "left")
    inherited = F.col("licence").isNull()
    return out.select("id", "directory", F.col("licence").alias("own_licence"), F.col("score").alias("own_score"), F.coalesce("licence", "near.given").alias("licence"), F.when(inherited, F.col("near.from_directory")).alias("from_directory"))


def document_directory() -> Column:
    """Documents have no paths: they lie in source/a/b with a = doc_id div 10000 and b = doc_id div 100, ids that end in 0 one level up, in 00 two. These last count as licence files."""
    d, source = F.col("doc_id"), F.coalesce("source", F.lit(""))
    a, b = F.expr("doc_id div 10000").cast("string"), F.expr("doc_id div 100").cast("string")
    return F.when(d % 100 == 0, source).when(d % 10 == 0, F.concat_ws("/", source, a)).otherwise(F.concat_ws("/", source, a, b))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licences of all documents. Those whose ids end in 0 stand for licence files."""
    found = scan_licences(table(spark, sf_dir, "documents"), id_col="doc_id", directory=document_directory(), licence_file=F.col("doc_id") % 10 == 0)
    return found.withColumnRenamed("id", "doc_id")


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE = rf"""
WITH templates AS (SELECT * FROM (VALUES {", ".join(f"({k}, {_sql(name)}, {_sql(text)})" for k, (name, text) in enumerate(TEMPLATES))}) t(template, licence, body)),
tt AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(string_split_regex(lower(body), '{TERM}')) AS term FROM templates) WHERE term <> '' GROUP BY ALL),
words AS (SELECT doc_id, unnest(list_distinct(string_split_regex(lower(coalesce(text, '')), '{TERM}'))) AS term FROM documents),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT v.term, ln((1 + n) / (1 + coalesce(d.df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) v CROSS JOIN n LEFT JOIN (SELECT term, count(*) AS df FROM words GROUP BY term) d USING (term)),
sides AS (SELECT template, licence, term, tf * idf AS w FROM tt JOIN idf USING (term)),
norms AS (SELECT template, sqrt(sum(w * w)) AS norm FROM sides GROUP BY template),
lines AS (SELECT doc_id, 2 AS kind, 1 AS line, lower(text) AS words FROM documents
 UNION ALL SELECT doc_id, 1, generate_subscripts(parts, 1), unnest(parts) FROM (SELECT doc_id, string_split_regex(lower(text), '{BLANK}') AS parts FROM documents)
 UNION ALL SELECT doc_id, 0, generate_subscripts(parts, 1), unnest(parts) FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS parts FROM documents)),
terms AS (SELECT doc_id, kind, line, term, count(*) AS tf FROM (SELECT doc_id, kind, line, unnest(string_split_regex(words, '{TERM}')) AS term FROM lines) WHERE term <> '' GROUP BY ALL),
weighted AS (SELECT doc_id, kind, line, term, tf * coalesce(idf, ln(1 + n) + 1) AS w FROM terms LEFT JOIN idf USING (term) CROSS JOIN n),
lnorm AS (SELECT doc_id, kind, line, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY ALL),
dots AS (SELECT doc_id, kind, line, template, licence, sum(weighted.w * sides.w) AS dot FROM weighted JOIN sides USING (term) GROUP BY ALL),
scored AS (SELECT doc_id, kind, licence, round(dot / (norms.norm * lnorm.norm), 6) AS score FROM dots JOIN norms USING (template) JOIN lnorm USING (doc_id, kind, line)),
own AS (SELECT doc_id, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind DESC, score DESC, licence) AS r FROM scored WHERE score >= {THRESHOLD}) WHERE r = 1),
named AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN coalesce(source, '') WHEN doc_id % 10 = 0 THEN concat_ws('/', coalesce(source, ''), doc_id // 10000) ELSE concat_ws('/', coalesce(source, ''), doc_id // 10000, doc_id // 100) END AS directory, licence, score FROM documents LEFT JOIN own USING (doc_id)),
given AS (SELECT directory AS above, arg_min(licence, doc_id) AS given FROM named WHERE licence IS NOT NULL AND doc_id % 10 = 0 GROUP BY directory),
near AS (SELECT directory, arg_max(above, length(above)) AS above, arg_max(given, length(above)) AS given FROM (SELECT DISTINCT directory FROM named) d JOIN given ON directory = above OR above = '' OR starts_with(directory, above || '/') GROUP BY directory)
SELECT doc_id, directory, licence AS own_licence, score AS own_score, coalesce(licence, given) AS licence, CASE WHEN licence IS NULL THEN above END AS from_directory FROM named LEFT JOIN near USING (directory)
"""
