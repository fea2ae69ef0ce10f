"""License scans in DataFrame functions only: sparse TF-IDF cosine to templates, then nearest-ancestor inheritance.

Every text is cut into passages (lines, and sentences within lines). A passage is weighed against each template by the
cosine of their TF-IDF vectors; inverse document frequencies come from all texts of the corpus. A template's anchors are its
heaviest terms, taken until the rest is too light to reach the threshold on its own, so a passage without an anchor of any
template cannot match and is left out early; the bound is exact.

Notices are also wrapped and run over many lines, so runs of a text's terms, each as long as a notice, are weighed in the
same way against whole headers and licence texts (`WHOLE`) and against the short notices. As a run is as long as its notice,
neither line ends, comment marks nor the rest of the file dilute it. Runs begin wherever a notice's first two terms stand and at
every eighth of a notice, so one of them holds all of it, or 15/16 of one whose beginning was changed. Only runs with an anchor are made, in texts whose terms could reach the threshold at all.

A file's own licence is that of its best run of a whole notice; failing that, of its best passage; failing that, of its best
run of a short notice.

Licence files (by name) give their licence to their directory. A file without a licence of its own inherits from the
nearest directory above it that has one: distinct directories are spread to their ancestors and joined with the licensed
ones, so the work follows directories, and only the last join touches files.

Templates are fixed and few; their terms (at most `MOST_TERMS`) and vectors are the only data that goes to all tasks.

Defined results: null and empty texts have no licence of their own; rows that share a path are one file, and the result has
one row for each path; a null path stands for one file in no directory, which inherits nothing; ties go to the template that
sorts first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, write_shared

THRESHOLD, MOST_TERMS = 0.75, 1_000
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([-._].*)?$"

#: Short notices by which texts state their licence.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
}

_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
_GNU_TEXT = "GNU {0} Version {1} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_GPL, _LESSER, _AFFERO = "General Public License", "Lesser General Public License", "Affero General Public License"
_CC_TEXT = "Creative Commons {0} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {0} 4.0 International Public License (\"Public License\")."
_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_DISCLAIMER = " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

#: Whole headers, whole short licences, and the openings of the long ones.
WHOLE = {
    "AGPL-3.0": [_GNU.format(_AFFERO, 3), _GNU_TEXT.format(_AFFERO, "3, 19 November 2007")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    ],
    "BSD-2-Clause": [_BSD_CONDITIONS + _BSD_DISCLAIMER],
    "BSD-3-Clause": [_BSD_CONDITIONS + _BSD_THIRD, _BSD_CONDITIONS + _BSD_THIRD + _BSD_DISCLAIMER],
    "CC-BY-4.0": [_CC_TEXT.format("Attribution")],
    "CC-BY-NC-4.0": [_CC_TEXT.format("Attribution-NonCommercial")],
    "CC-BY-SA-4.0": [_CC_TEXT.format("Attribution-ShareAlike")],
    "GPL-2.0": [_GNU.format(_GPL, 2), _GNU_TEXT.format(_GPL, "2, June 1991")],
    "GPL-3.0": [_GNU.format(_GPL, 3), _GNU_TEXT.format(_GPL, "3, 29 June 2007")],
    "LGPL-2.1": [_GNU.format(_LESSER, 2.1), _GNU_TEXT.format(_LESSER, "2.1, February 1999")],
    "LGPL-3.0": [_GNU.format(_LESSER, 3), _GNU_TEXT.format(_LESSER, "3, 29 June 2007")],
    "MIT": [_MIT_GRANT, _MIT_GRANT + _MIT_DISCLAIMER],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    ],
}


def _terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def passages(text: Column) -> Column:
    """Lines, and sentences within lines; a number's point ends no sentence."""
    return F.split(text, r"\n+|(?<=[.!?;])\s+")


class Vectors:
    """Templates as TF-IDF vectors of length 1."""

    def __init__(self, templates: dict[str, list[str]], frequency: dict[str, int], texts: int, threshold: float):
        self.rare = math.log(1 + texts) + 1
        self.idf = {t: math.log((1 + texts) / (1 + frequency.get(t, 0))) + 1 for notices in templates.values() for n in notices for t in _terms(n)}
        self.entries: list[tuple[str, int, str, float]] = []
        self.anchors: set[str] = set()
        for licence, notices in sorted(templates.items()):
            for number, notice in enumerate(notices):
                weight = {t: n * self.idf[t] for t, n in Counter(_terms(notice)).items()}
                norm = math.sqrt(sum(w * w for w in weight.values()))
                rest = 1.0
                for term, w in sorted(weight.items(), key=lambda x: (-x[1], x[0])):
                    self.entries.append((licence, number, term, w / norm))
                    if rest >= threshold * threshold:
                        self.anchors.add(term)
                    rest -= (w / norm) ** 2


def term_frequencies(files: DataFrame, terms: list[str]) -> tuple[dict[str, int], int]:
    """In how many of all texts each of the given terms stands, and the number of texts."""
    held = files.select(F.array_intersect(tokens(F.coalesce("text", F.lit(""))), F.array(*(F.lit(t) for t in terms))).alias("held"))
    counts = held.select(F.explode("held").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return {r.term: r.n for r in counts.collect()}, files.count()


def _counted(files: DataFrame, *sets: dict[str, list[str]]) -> tuple[dict[str, int], int]:
    """term_frequencies() of all terms of some sets of templates."""
    terms = sorted({t for templates in sets for notices in templates.values() for n in notices for t in _terms(n)})
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} template terms")
    return term_frequencies(files, terms)


def own_licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, counts: tuple[dict[str, int], int] | None = None) -> DataFrame:
    """(path, licence, similarity) of the files (path, text) whose passages state a licence."""
    vectors = Vectors(templates, *(counts or _counted(files, templates)), threshold)
    spark = files.sparkSession
    anchor = rf"(?i)(^|[^A-Za-z0-9])({'|'.join(sorted(vectors.anchors))})([^A-Za-z0-9]|$)"
    near = files.where(F.col("text").rlike(anchor)).select("path", F.explode(F.array_distinct(passages(F.col("text")))).alias("passage")).where(F.col("passage").rlike(anchor)).distinct()
    # few and read twice, below different joins: texts are cut into passages once
    near = write_shared(near, "passages")
    counted = near.select("path", "passage", F.explode(tokens(F.col("passage"))).alias("term")).groupBy("path", "passage", "term").agg(F.count("*").alias("n"))
    idf = F.broadcast(spark.createDataFrame(sorted(vectors.idf.items()), "term string, idf double"))
    weighed = counted.join(idf, "term", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(vectors.rare)))
    template = F.broadcast(spark.createDataFrame(vectors.entries, "licence string, notice int, term string, t double"))
    norm = weighed.groupBy("path", "passage").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = weighed.join(template, "term").groupBy("path", "passage", "licence", "notice").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))
    alike = dot.alias("d").join(norm.alias("n"), F.expr("d.path <=> n.path AND d.passage = n.passage"))
    scored = alike.select("d.path", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("best"))
    return best.select("path", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("similarity"))


def _share(held: str, squares: dict[str, float]) -> Column:
    """The sum of the squares of the terms that the array column `held` has."""
    square = F.create_map(*(F.lit(x) for pair in squares.items() for x in pair))
    return F.aggregate(F.array_intersect(held, F.array(*map(F.lit, squares))), F.lit(0.0), lambda done, t: done + square[t])


def run_licences(files: DataFrame, templates: dict[str, list[str]], whole: dict[str, list[str]], threshold: float, counts: tuple[dict[str, int], int]) -> DataFrame:
    """(path, whole, licence, similarity) of the files (path, text) with a run of terms that is like a notice: the best of
    the whole notices and the best of the short ones."""
    spark = files.sparkSession
    vectors = [(True, whole, Vectors(whole, *counts, threshold)), (False, templates, Vectors(templates, *counts, threshold))]
    notices, entries, idf = [], [], {}
    for is_whole, said, v in vectors:
        idf |= v.idf
        for licence, number in sorted({e[:2] for e in v.entries}):
            own = [(t, w) for l, n, t, w in v.entries if (l, n) == (licence, number)]
            rest, anchors = 1.0, []
            for term, w in own:
                if rest >= threshold * threshold:
                    anchors.append(term)
                rest -= w * w
            size = len(_terms(said[licence][number]))
            entries += [(len(notices), t, w) for t, w in own]
            notices.append((len(notices), is_whole, licence, size, max(1, size // 8), anchors, _terms(said[licence][number])[:2]))
    anchor = rf"(?i)(^|[^A-Za-z0-9])({'|'.join(sorted({a for n in notices for a in n[5]}))})([^A-Za-z0-9]|$)"
    strings = lambda found: F.array(*(F.lit(t) for t in found))
    texts = files.where(F.col("text").rlike(anchor)).select("path", F.sha2("text", 256).alias("digest"), F.explode(F.array(tokens(F.col("text")))).alias("terms"))
    # explode() of one element: what follows uses the terms many times, and would otherwise cut the text as often
    texts = texts.select("path", "digest", "terms", F.explode(F.array(F.array_intersect("terms", strings(sorted(idf))))).alias("held"))
    # no run is more like a notice than the notice's share that the whole text holds
    weights = F.broadcast(spark.createDataFrame(entries, "number int, term string, t double"))
    reach = []
    for number, is_whole, licence, size, step, anchors, opening in notices:
        share = _share("held", {t: w * w for n, t, w in entries if n == number})
        known = F.struct(F.lit(number).alias("number"), F.lit(is_whole).alias("whole"), F.lit(licence).alias("licence"), F.lit(size).alias("size"), F.lit(step).alias("step"), strings(anchors).alias("anchors"), strings(opening).alias("opening"))
        reach.append(F.when(share >= threshold * threshold - 1e-9, known))
    near = texts.select("path", "digest", "terms", F.explode(F.array(*reach)).alias("n")).where("n IS NOT NULL").select("path", "digest", "terms", "n.*")
    at = F.expr("filter(transform(terms, (t, i) -> if(array_contains(anchors, t), i, -1)), i -> i >= 0)")
    # the begins of the runs that hold an anchor, multiples of step, and of those that open like the notice
    begins = F.expr("array_union(flatten(transform(at, i -> transform(sequence(greatest(0, (i - size) div step + 1), i div step), k -> int(k * step)))), filter(transform(terms, (t, i) -> if(t = opening[0] AND get(terms, i + 1) = opening[1], i, -1)), i -> i >= 0))")
    runs = near.select("*", F.explode(F.array(at)).alias("at")).select("path", "digest", "number", "whole", "licence", F.explode(begins).alias("begin"), "terms", "size")
    runs = runs.select("path", "digest", "number", "whole", "licence", "begin", F.explode(F.expr("slice(terms, begin + 1, size)")).alias("term"))
    key = ["path", "digest", "number", "whole", "licence", "begin"]
    counted = runs.groupBy(*key, "term").agg(F.count("*").alias("n"))
    rare = vectors[0][2].rare
    weighed = counted.join(F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double")), "term", "left").join(weights, ["number", "term"], "left")
    weighed = weighed.withColumn("w", F.col("n") * F.coalesce("idf", F.lit(rare)))
    scored = weighed.groupBy(*key).agg(F.round(F.sum(F.col("w") * F.coalesce("t", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    best = scored.groupBy("path", "whole").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence")).alias("best"))
    return best.select("path", "whole", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("similarity"))


def stated_licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, whole: dict[str, list[str]] = WHOLE) -> DataFrame:
    """(path, licence, similarity) of the files (path, text) that state a licence in a passage or in a run of terms."""
    counts = _counted(files, templates, whole)
    runs = run_licences(files, templates, whole, threshold, counts)
    found = own_licences(files, templates, threshold, counts).withColumn("rank", F.lit(1)).unionByName(runs.select("path", "licence", "similarity", F.when(F.col("whole"), 0).otherwise(2).alias("rank")))
    by_licence = found.groupBy("path", "licence").agg(F.min("rank").alias("rank"), F.max(F.when(F.col("rank") < 2, F.col("similarity"))).alias("s"), F.max("similarity").alias("any"))
    order = F.struct("rank", (-F.coalesce("s", "any")).alias("s"), "licence")
    best = by_licence.groupBy("path").agg(F.min(order).alias("best"))
    return best.select("path", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("similarity"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherited(paths: DataFrame, own: DataFrame, licence_file: str = LICENCE_FILE) -> DataFrame:
    """(path, from_dir, inherited) of the paths that have a licensed directory above them, the nearest one."""
    giving = own.where(F.element_at(F.split("path", "/"), -1).rlike(licence_file)).select(directory(F.col("path")).alias("dir"), "licence", "similarity")
    licensed = giving.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "licence"))["licence"].alias("inherited"))
    dirs = paths.where(F.col("path").isNotNull()).select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select(F.col("dir").alias("below"), F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth"), parts.alias("parts"))
    above = above.select("below", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = above.join(licensed, "dir").groupBy("below").agg(F.max(F.struct("depth", "dir", "inherited")).alias("near"))
    return paths.withColumn("below", directory(F.col("path"))).join(nearest, "below").select("path", F.col("near.dir").alias("from_dir"), F.col("near.inherited").alias("inherited"))


def scan_licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, licence_file: str = LICENCE_FILE) -> DataFrame:
    """A row for each path of files (path, text): path, licence, basis (own, inherited or none), similarity and from_dir."""
    files = files.select("path", "text")
    paths = files.select("path").distinct()
    own = write_shared(stated_licences(files, templates, threshold), "licences")
    joined = paths.alias("p").join(own.alias("o"), F.expr("p.path <=> o.path"), "left").join(inherited(paths, own, licence_file).alias("i"), F.expr("p.path = i.path"), "left")
    basis = F.when(F.col("o.licence").isNotNull(), "own").when(F.col("i.inherited").isNotNull(), "inherited").otherwise("none")
    return joined.select(F.col("p.path").alias("path"), F.coalesce("o.licence", "i.inherited").alias("licence"), basis.alias("basis"), "o.similarity", F.when(F.col("o.licence").isNull(), F.col("i.from_dir")).alias("from_dir"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a source is a tree of directories by thousands and fifties of doc_id; texts below 400 code points
    are named as licence files, of the directory of the thousand or of the fifty in turn."""
    thousand, fifty = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 50)
    short = F.length(F.coalesce("text", F.lit(""))) < 400
    up = F.concat_ws("/", "source", thousand.cast("string"))
    path = F.when(short & (F.pmod(F.col("doc_id"), F.lit(2)) == 0), F.concat_ws("/", up, F.concat(F.lit("LICENSE-"), "doc_id")))
    path = path.when(short, F.concat_ws("/", up, fifty.cast("string"), F.concat(F.lit("LICENSE-"), "doc_id")))
    return docs.select(path.otherwise(F.concat_ws("/", up, fifty.cast("string"), F.concat(F.col("doc_id"), F.lit(".txt")))).alias("path"), "text")


def op5_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licences(document_files(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
