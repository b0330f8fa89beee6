"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A text is cut into pieces at line ends and after sentences. Its units are all runs of one to three
neighbouring pieces, runs of 4, 8, 16 and 32 that begin at every half of their length, so that a header may
be one sentence of a long line or wrapped over many, and the text as a whole, so that a licence file is held
against licence texts. Units and templates
are vectors of word counts times idf, where document frequencies count the pieces of the whole
corpus; a word that no template or rule has counts as a term of its own with the largest idf. A unit
declares the licence of the template with the highest cosine, if that is at least ``threshold``.
Close relatives share nearly all their words, so a licence of ``TELLING`` is only declared by a unit that has the
words which tell it from its family, and none that tell another one, and by no part of such a unit of higher
cosine: a header of a version or variant that is not listed is none, not its neighbour.
Only units that hold an anchor word are compared: anchors are chosen so that the remaining words of
each template are too light a part of it to reach the threshold, so nothing is lost.

A file has the licence of its best unit. Files without one inherit from the licence file
in the nearest ancestor directory: directories are joined with all their ancestors, the
deepest that has a licence file wins, and files join their directory. A file is the licence file of its
directory if the caller says so, or if its best unit is at least half of its words, whatever its length.

Everything is DataFrame functions. Defined cases: null and empty texts have no header; ties
go to the unit of fewer pieces, then the first one, then the first licence by name, and in a directory
to the licence file with the highest cosine, then the first path; repeated rows are scanned alike and
each returned; very long texts are scanned whole; a null path is a file in the root; an empty table
gives an empty result; extra columns pass through, and one that has the name of a result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Short public statements by which works name their licence.
STATEMENTS = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", "Released under the ISC License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
#: Public licence texts and notices that are files or headers of their own.
TEXTS = [
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License"
        " along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
        " either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the"
        " above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR"
        " IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
        " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF"
        " USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN"
        " ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the"
        " above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names"
        " of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR"
        " IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR"
        " CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF"
        " USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN"
        " ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    (
        "CC0-1.0",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related"
        " and neighboring rights, to the extent allowed by law. You can copy, modify, distribute and perform the work, even for commercial purposes, all without asking permission.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this"
        " program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
        " appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION"
        " OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "LGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3"
        " of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License"
        " along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
        " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
        " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
        " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as"
        " a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all"
        " copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this"
        " dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY"
        " KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY"
        " CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]
#: (template number, licence, text)
TEMPLATES = [(i, *t) for i, t in enumerate([*STATEMENTS, *TEXTS])]
#: licence -> (groups of words of which a unit must have one each, words that it must not have)
TELLING: dict[str, tuple[list[set[str]], set[str]]] = {
    "AGPL-3.0": ([{"affero", "agpl"}, {"3", "3.0"}], set()),
    "Apache-2.0": ([{"apache"}, {"2", "2.0"}], set()),
    "BSD-2-Clause": ([{"2"}, {"clause", "redistributions"}], {"endorse", "advertising"}),
    "BSD-3-Clause": ([{"3", "endorse"}, {"clause", "endorse"}], {"advertising"}),
    "CC-BY-4.0": ([{"by", "attribution"}, {"4.0"}], {"sharealike", "sa", "noncommercial", "nc", "noderivatives", "nd"}),
    "CC-BY-NC-4.0": ([{"noncommercial", "nc"}, {"4.0"}], {"sharealike", "sa", "noderivatives", "nd"}),
    "CC-BY-SA-4.0": ([{"sharealike", "sa"}, {"4.0"}], {"noncommercial", "nc", "noderivatives", "nd"}),
    "GPL-2.0": ([{"2", "2.0"}], {"affero", "agpl", "lesser", "library", "lgpl"}),
    "GPL-3.0": ([{"3", "3.0"}], {"affero", "agpl", "lesser", "library", "lgpl"}),
    "LGPL-3.0": ([{"lesser", "lgpl"}, {"3", "3.0"}], {"affero", "agpl"}),
    "MPL-2.0": ([{"mozilla", "mpl"}, {"2", "2.0"}], set()),
}
#: (licence, word, bit): a unit declares a licence if the bits of its words are exactly those of the licence's groups; a higher bit denies it.
RULES = [(lic, w, 1 << i) for lic, (groups, against) in TELLING.items() for i, group in enumerate([*groups, against]) for w in sorted(group)]
NEEDS = {lic: (1 << len(groups)) - 1 for lic, (groups, _) in TELLING.items()}
#: Lengths of runs that begin at every piece, and of those that begin at every half of their length.
RUNS, LONG_RUNS = (1, 2, 3), (4, 8, 16, 32)
#: A file whose best unit is at least this part of its words is a licence file.
LICENCE_PART = 0.5
THRESHOLD = 0.6
RESULTS = ("license", "cosine", "how", "from_dir")


def words(text: str) -> str:
    """SQL of the words of a text: letters, digits and inner dots, lower case."""
    return f"filter(split(lower({text}), '(?:[^\\\\p{{L}}\\\\p{{N}}.]|\\\\.(?![0-9]))+'), w -> w <> '')"


def _templates(spark: SparkSession, templates) -> DataFrame:
    """(template, license, word, tf, bits): the words of each template, and with a tf of 0 those of the rules of its licence."""
    rows = _values(spark, "template, license, text", templates)
    found = rows.select("template", "license", F.explode(F.expr(words("text"))).alias("word"), F.lit(1).alias("tf"), F.lit(0).alias("bits"))
    told = rows.join(_values(spark, "license, word, bits", RULES), "license").select("template", "license", "word", F.lit(0).alias("tf"), "bits")
    return found.union(told).groupBy("template", "license", "word").agg(F.sum("tf").alias("tf"), F.bit_or("bits").alias("bits"))


def _strings(values) -> str:
    return ",".join("'" + v.replace("'", "\\'") + "'" for v in values)


def _values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small table written into the plan; numbers are doubles or ints, the rest strings."""
    cell = lambda v: _strings([v]) if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)
    return spark.sql(f"SELECT * FROM VALUES {','.join('(' + ','.join(map(cell, r)) + ')' for r in rows)} AS v({columns})")


def weighted_templates(pieces: DataFrame, templates) -> tuple[list, float]:
    """[(template, license, word, weight over norm, bits, idf)] and the idf of unseen words: a bounded list, one row for each word of a template."""
    terms = _templates(pieces.sparkSession, templates).collect()
    vocabulary = sorted({r["word"] for r in terms})
    # The empty word counts the pieces. No array here is empty, and the outer form of explode keeps Spark from
    # filtering on it first, which would cut the text into words once more.
    seen = pieces.select(F.explode_outer(F.concat(F.array(F.lit("")), F.array_distinct("words"))).alias("w")).where(F.col("w").isin(["", *vocabulary]))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = counts.get("", 0)
    idf = lambda df: math.log((total + 1) / (df + 1)) + 1
    squares: dict[int, float] = {}
    for r in terms:
        squares[r["template"]] = squares.get(r["template"], 0.0) + (r["tf"] * idf(counts.get(r["word"], 0))) ** 2
    return [(r["template"], r["license"], r["word"], r["tf"] * idf(counts.get(r["word"], 0)) / math.sqrt(squares[r["template"]]), r["bits"], idf(counts.get(r["word"], 0))) for r in terms], idf(0)


def anchors(weights: list, threshold: float) -> list[str]:
    """Words of which a unit at the threshold must have one: the commoner words of a template by themselves make up too little of it."""
    left = dict.fromkeys((t for t, *_ in weights), 0.99 * threshold**2)
    out: set[str] = set()
    for template, _, word, weight, _, _ in sorted(weights, key=lambda w: (w[0], w[5], w[2])):
        left[template] -= weight**2
        if weight and left[template] <= 0:
            out.add(word)
    return sorted(out)


#: SQL of the pieces of a text: lines, cut after sentences.
PIECES = "split(regexp_replace(text, '([.!?;])[ \\\\t]+([A-Z(])', '$1\\n$2'), '\\n')"


def _units(pieces: str) -> str:
    """SQL of the units of an array of pieces (arrays of words): (line, run, words), where run is the number of pieces."""
    run = lambda k, step: f"if({k} > size({pieces}), array(), transform(sequence(0, size({pieces}) - {k}, {step}), i -> struct(i as line, {k} as run, flatten(slice({pieces}, i + 1, {k})) as words)))"
    whole = f"if(size({pieces}) > 3, array(struct(0 as line, size({pieces}) as run, flatten({pieces}) as words)), array())"
    return f"concat({', '.join([*(run(k, 1) for k in RUNS), *(run(k, k // 2) for k in LONG_RUNS), whole])})"


def headers(files: DataFrame, *, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, line, run, part, license, cosine): the licence that a unit of a file declares, and what part of the file's words it is. ``files`` has key and text."""
    spark = files.sparkSession
    files = files.where("text is not null").select("key", F.expr(f"transform({PIECES}, p -> {words('p')})").alias("pieces"))
    weights, unseen = weighted_templates(files.select(F.explode_outer("pieces").alias("words")), templates)
    idf = {word: i for _, _, word, _, _, i in weights}
    anchored = f"w -> w in ({_strings(anchors(weights, threshold))})"
    units = files.where(F.expr(f"exists(pieces, p -> exists(p, {anchored}))"))
    units = units.select("key", F.expr("size(flatten(pieces))").alias("of"), F.explode_outer(F.expr(f"filter({_units('pieces')}, u -> exists(u.words, {anchored}))")).alias("u"))
    units = units.groupBy("key", "u.line", "u.run").agg(F.first("of").alias("of"), F.first("u.words").alias("words"))  # repeated rows are one
    vocabulary = F.broadcast(_values(spark, "word, idf", sorted(idf.items())))  # the words of the templates
    vectors = F.broadcast(_values(spark, "template, license, word, weight, bits, needs", [(*w[:5], NEEDS.get(w[1], 0)) for w in sorted(weights)]))
    unit = ["key", "line", "run"]
    terms = units.select(*unit, "of", F.size("words").alias("n"), F.explode("words").alias("word")).join(vocabulary, "word")
    terms = terms.groupBy(*unit, "of", "n", "word", "idf").agg(F.count(F.lit(1)).alias("tf"))
    norms = terms.groupBy(*unit).agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2) + (F.first("n") - F.sum("tf")) * unseen**2).alias("norm"), (F.first("n") / F.first("of")).alias("part"))
    dots = terms.join(vectors, "word").groupBy(*unit, "template", "license").agg(F.sum(F.col("tf") * F.col("idf") * F.col("weight")).alias("dot"), F.bit_or("bits").alias("bits"), F.first("needs").alias("needs"))
    found = dots.join(norms, unit).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("cosine") >= threshold)
    denied = F.max(F.when(F.col("bits") > F.col("needs"), F.col("cosine"))).over(Window.partitionBy("key", "license"))  # the units of one text
    found = found.select(*unit, "part", "license", "cosine", ((F.col("bits") == F.col("needs")) & (F.col("cosine") >= F.coalesce(denied, F.lit(0.0)))).alias("told"))
    best = F.min_by(F.struct("license", "cosine", "part", "told"), F.struct(-F.col("cosine"), F.col("license")))
    return found.groupBy(*unit).agg(best.alias("b")).where("b.told").select(*unit, "b.part", "b.license", "b.cosine")


def scan(files: DataFrame, *, path: Column, licence_file: Column | None = None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds path, license, cosine, how (header, inherited or none) and from_dir.

    licence_file: a condition on the columns of files that makes a file with a header the licence
    file of its directory; by default the share of its words that declare the licence.
    """
    key = F.struct(F.xxhash64("path", "text").alias("a"), F.xxhash64("text", F.lit(1), "path").alias("b"))
    files = files.drop("path", *RESULTS).withColumn("path", F.coalesce(path, F.lit("")))
    columns = files.columns
    keyed = files.withColumn("__key", key).withColumn("__dir", F.regexp_replace("path", "/?[^/]*$", ""))
    best = F.min_by(F.struct("license", "cosine", "part"), F.struct(-F.col("cosine"), F.col("run"), F.col("line")))
    own = headers(keyed.select(F.col("__key").alias("key"), "text"), templates=templates, threshold=threshold)
    own = cut(own.groupBy("key").agg(best.alias("__own")).select(F.col("key").alias("__key"), "__own"))
    rows = keyed.withColumn("__gives", licence_file if licence_file is not None else F.lit(True)).join(own, "__key", "left")
    gives = F.col("__own").isNotNull() & F.col("__gives")
    gives = gives if licence_file is not None else gives & (F.col("__own.part") >= LICENCE_PART)
    per_dir = rows.where(gives).select(F.col("__dir").alias("dir"), "__own", "path").groupBy("dir").agg(F.min_by(F.struct("__own.license", "__own.cosine"), F.struct(-F.col("__own.cosine"), F.col("path"))).alias("given"))
    dirs = keyed.select("__dir").distinct()
    parts = F.split("__dir", "/")
    above = dirs.select("__dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).select("__dir", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("dir"))
    inherited = cut(above.join(per_dir, "dir").groupBy("__dir").agg(F.max_by(F.struct("given", "dir"), "depth").alias("__from")))
    rows = rows.join(inherited, "__dir", "left")
    return rows.select(
        *columns,
        F.coalesce("__own.license", "__from.given.license").alias("license"),
        F.coalesce("__own.cosine", "__from.given.cosine").alias("cosine"),
        F.when(F.col("__own").isNotNull(), F.lit("header")).when(F.col("__from").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("how"),
        F.when(F.col("__own").isNull(), F.col("__from.dir")).alias("from_dir"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree source/lang/thousand; one that is mostly a licence statement is the licence file of its directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.expr("cast(doc_id div 1000 as string)"), F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))
    return scan(docs, path=path).select("doc_id", "path", "license", "cosine", "how", "from_dir")


OP5_SQL = r"""
WITH t(template, license, text) AS (VALUES __TEMPLATES__),
tw AS (SELECT template, license, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '\.([^0-9]|$)', ' \1', 'g'), '[^\p{L}\p{N}.]+'), lambda w: w <> '')) AS word FROM t),
rules(license, word, bits) AS (VALUES __RULES__),
needs AS (SELECT license, bit_or(bits) AS needs FROM (VALUES __NEEDS__) v(license, bits) GROUP BY license),
tt AS (SELECT template, license, word, sum(tf) AS tf, bit_or(bits) AS bits FROM (SELECT template, license, word, 1 AS tf, 0 AS bits FROM tw
       UNION ALL SELECT template, license, word, 0, bits FROM t JOIN rules USING (license)) GROUP BY ALL),
f AS (SELECT doc_id, text, concat_ws('/', coalesce(source, '_'), coalesce(lang, '_'), coalesce(CAST(doc_id // 1000 AS VARCHAR), '_'), coalesce(CAST(doc_id AS VARCHAR), '_')) AS path FROM documents),
fp AS (SELECT path, string_split(regexp_replace(text, '([.!?;])[ \t]+([A-Z(])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS pieces FROM f WHERE text IS NOT NULL),
l0 AS (SELECT path, unnest(pieces) AS piece, unnest(range(len(pieces))) AS line, len(pieces) AS pieces FROM fp),
l1 AS (SELECT path, line, pieces, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(piece), '\.([^0-9]|$)', ' \1', 'g'), '\.([^0-9]|$)', ' \1', 'g'), '[^\p{L}\p{N}.]+'), lambda w: w <> '') AS words FROM l0),
n AS (SELECT count(*) AS total FROM l1),
df AS (SELECT word, count(*) AS df FROM (SELECT path, line, unnest(list_distinct(words)) AS word FROM l1) GROUP BY word),
idf AS (SELECT v.word, ln(CAST(total + 1 AS DOUBLE) / (coalesce(df, 0) + 1)) + 1 AS idf, ln(CAST(total + 1 AS DOUBLE)) + 1 AS unseen
        FROM (SELECT DISTINCT word FROM tt) v LEFT JOIN df USING (word) CROSS JOIN n),
u AS (SELECT path, line, 1 AS run, words FROM l1
      UNION ALL SELECT a.path, a.line, 2, a.words || b.words FROM l1 a JOIN l1 b ON a.path = b.path AND b.line = a.line + 1
      UNION ALL SELECT a.path, a.line, 3, a.words || b.words || c.words FROM l1 a JOIN l1 b ON a.path = b.path AND b.line = a.line + 1 JOIN l1 c ON a.path = c.path AND c.line = a.line + 2
      UNION ALL SELECT path, begin, k, flatten(list(words ORDER BY line)) FROM (SELECT path, line, pieces, words, k, (line // (k // 2) - back) * (k // 2) AS begin
        FROM l1, (VALUES (4), (8), (16), (32)) r(k), (VALUES (0), (1)) s(back)) WHERE begin >= 0 AND begin + k <= pieces GROUP BY path, begin, k
      UNION ALL SELECT path, 0, any_value(pieces), flatten(list(words ORDER BY line)) FROM l1 GROUP BY path HAVING any_value(pieces) > 3 AND any_value(pieces) NOT IN (4, 8, 16, 32)),
whole AS (SELECT path, CAST(sum(len(words)) AS BIGINT) AS total_words FROM l1 GROUP BY path),
lw AS (SELECT path, line, run, len(words) AS n, unnest(words) AS word FROM u),
tf AS (SELECT path, line, run, n, word, count(*) AS tf FROM lw WHERE word IN (SELECT word FROM tt) GROUP BY ALL),
tv AS (SELECT template, license, word, bits, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS weight FROM tt JOIN idf USING (word)),
norms AS (SELECT path, line, run, any_value(n) AS n, sqrt(sum((tf * idf) ** 2) + (any_value(n) - sum(tf)) * any_value(unseen) ** 2) AS norm FROM tf JOIN idf USING (word) GROUP BY path, line, run),
dots AS (SELECT path, line, run, template, license, sum(tf * idf * weight) AS dot, bit_or(bits) AS bits, coalesce(any_value(needs), 0) AS needs
         FROM tf JOIN idf USING (word) JOIN tv USING (word) LEFT JOIN needs USING (license) GROUP BY path, line, run, template, license),
near AS (SELECT path, line, run, n, license, bits, needs, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (path, line, run) WHERE round(dot / norm, 6) >= 0.6),
told AS (SELECT *, bits = needs AND cosine >= coalesce(max(cosine) FILTER (bits > needs) OVER (PARTITION BY path, license), 0) AS told FROM near),
found AS (SELECT * FROM (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY path, line, run ORDER BY cosine DESC, license) = 1) WHERE told),
own AS (SELECT path, license, cosine, n / total_words AS part FROM found JOIN whole USING (path) QUALIFY row_number() OVER (PARTITION BY path ORDER BY cosine DESC, run, line) = 1),
per_dir AS (SELECT regexp_replace(path, '/[^/]*$', '') AS dir, license, cosine FROM own WHERE part >= 0.5
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
above AS (SELECT doc_id, path, unnest([3, 2, 1]) AS depth FROM f),
inherited AS (SELECT a.path, p.license, p.cosine, p.dir FROM above a JOIN per_dir p ON array_to_string(string_split(a.path, '/')[1:depth], '/') = p.dir
              QUALIFY row_number() OVER (PARTITION BY a.path ORDER BY depth DESC) = 1)
SELECT f.doc_id, f.path, coalesce(o.license, i.license) AS license, coalesce(o.cosine, i.cosine) AS cosine,
       CASE WHEN o.path IS NOT NULL THEN 'header' WHEN i.path IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN o.path IS NULL THEN i.dir END AS from_dir
FROM f LEFT JOIN own o USING (path) LEFT JOIN inherited i ON f.path = i.path
"""
for _name, _rows in (("TEMPLATES", TEMPLATES), ("RULES", RULES), ("NEEDS", sorted(NEEDS.items()))):
    OP5_SQL = OP5_SQL.replace(f"__{_name}__", ", ".join(map(str, _rows)))
