"""Licence scans: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

Every sentence of a whole text that holds an anchor word is a candidate; one without any is no notice, however near ("Mit." is
near to "SPDX-License-Identifier: MIT", and German). Equal sentences are compared once. Beside its sentences, a text's paragraphs,
its leading comment and the whole of it are compared with standard headers and whole licence texts, line breaks joined.
A licence wins over "proprietary", since licence texts also reserve rights.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm import common

#: Notices by licence, each a sentence of its own.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This software is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the terms of the GNU GPL version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright, all rights reserved."),
)
#: Titles and standard headers by licence; the whole texts are beside this file.
HEADERS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    *((name, f"This {it} is free software{mark} you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation{either} version {v} of the License, or (at your option) any later version.{rest}")
      for name, it, mark, title, either, v, more in (
          ("GPL-3.0", "program", ":", "GNU General Public License", ", either", "3", "GNU General Public License"),
          ("GPL-2.0", "program", ";", "GNU General Public License", "; either", "2", "GNU General Public License"),
          ("LGPL-3.0", "library", ":", "GNU Lesser General Public License", ", either", "3", "GNU Lesser General Public License"),
          ("LGPL-2.1", "library", ";", "GNU Lesser General Public License", "; either", "2.1", "GNU Lesser General Public License"),
          ("AGPL-3.0", "program", ":", "GNU Affero General Public License", ", either", "3", "GNU Affero General Public License"))
      for rest in ("", f" This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {more} for more details. You should have received a copy of the {more} along with this {it}. If not, see https://www.gnu.org/licenses/.")),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("proprietary", "Copyright. All rights reserved."),
)
#: Words of which a sentence must hold one to be compared.
ANCHORS = ("licensed", "license", "licence", "released", "copyright", "rights", "reserved", "spdx", "gnu", "gpl", "apache", "mozilla", "dedicated", "domain", "cc0")
#: Base names of licence files.
LICENCE_FILES = r"(?i)(?:^|/)(?:licen[sc]e|copying|notice|unlicense)(?:[.-][a-z0-9.-]+)?$"
THRESHOLD = 0.7

_TERM = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
_SENTENCE_END = r"[\n\r]+|(?<=[.!?;])[\x20\x09]+"
#: Lines without a letter or digit part paragraphs; comments lead a file, after blanks.
_PARAGRAPH_END = r"\n(?:[^A-Za-z0-9\n]*+\n)++"
_LEADING = r"^\s*+(?:[\x20\x09]*+(?:#|//|/?\*|--|;|%|<!--|\"\"\")[^\n]*+\n?+)++"
_ANCHOR = r"(?i)\b(?:" + "|".join(ANCHORS) + r")\b"


def notices() -> tuple[tuple[str, str], ...]:
    """Headers and whole texts by licence, read on the driver."""
    return HEADERS + tuple((p.stem, p.read_text("utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))


def template_weights(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple[str, float]], list[tuple[int, str, str, float]], float]:
    """(term, idf), (template, licence, term, weight over the template's norm), and the idf of any other term."""
    counts = [Counter(re.findall(_TERM, text.lower())) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(counts)) / (1 + n)) + 1 for t, n in df.items()}
    weights = []
    for k, ((name, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        weights += [(k, name, t, n * idf[t] / norm) for t, n in c.items()]
    return sorted(idf.items()), weights, math.log(1 + len(counts)) + 1


def _best(found: DataFrame, known: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """From (path, k, s), k the hash of s: (path, b) with the best template's (other, neg, licence)."""
    spark = found.sparkSession
    idf, weights, other = template_weights(known)
    each = found.groupBy("k").agg(F.min("s").alias("s"))
    terms = each.select("k", F.explode(F.regexp_extract_all(F.lower("s"), F.lit(_TERM), F.lit(0))).alias("term")).groupBy("k", "term").agg(F.count("*").alias("n"))
    # the two tables below are as large as the templates, whatever the input
    vocabulary = F.broadcast(spark.createDataFrame(idf, "term string, idf double"))
    templates = F.broadcast(spark.createDataFrame(weights, "template int, licence string, term string, w double"))
    terms = terms.join(vocabulary, "term", "left").withColumn("v", F.col("n") * F.coalesce("idf", F.lit(other))).select("k", "term", "v")
    norms = terms.groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = terms.join(templates, "term").groupBy("k", "template", "licence").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scores = dots.join(norms, "k").withColumn("score", F.least(F.col("dot") / F.col("norm"), F.lit(1.0))).where(F.col("score") >= threshold)
    best = scores.groupBy("k").agg(F.min(F.struct((F.col("licence") == "proprietary").alias("other"), (-F.round("score", 9)).alias("neg"), "licence")).alias("b"))
    return common.salted_join(found.select("path", "k"), best, "k").select("path", "b")


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """From (path, text): (path, licence, score) of the paths whose text holds a notice; a licence before "proprietary",
    then the best one, then the first by name."""
    has = lambda s: s.rlike(_ANCHOR)
    some = files.where(has(F.col("text")))
    found = some.select("path", F.explode(F.filter(F.split("text", _SENTENCE_END), has)).alias("s"))
    found = common.written(found.select("path", F.md5("s").alias("k"), "s"), "licence-sentences")
    parts = F.array_append(F.array_append(F.split("text", _PARAGRAPH_END), F.regexp_extract("text", _LEADING, 0)), F.col("text"))
    wide = some.select("path", F.explode(F.array_distinct(F.filter(parts, has))).alias("s"))
    wide = common.written(wide.select("path", F.md5("s").alias("k"), "s"), "licence-notices")
    hits = _best(found, TEMPLATES, threshold).unionByName(_best(wide, notices(), threshold)).groupBy("path").agg(F.min("b").alias("b"))
    return hits.select("path", "b.licence", (-F.col("b.neg")).alias("score"))


def parent(path: Column) -> Column:
    """Path up to the last slash; empty at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan_licences(files: DataFrame, threshold: float = THRESHOLD, is_licence_file: Column | None = None, keep: str | None = None) -> DataFrame:
    """For each (path, text) row: path, licence, score, via (own, inherited or null) and ``from_dir``; and the column ``keep``.

    A file with a notice has its own licence. Any other file takes that of the nearest directory above it, its own included,
    that has a licence file with a notice; of several such files in a directory the best counts. Null paths and texts
    are empty; repeated rows repeat, and rows of one path share what any of its texts says.
    """
    kept = F.lit(None) if keep is None else F.col(keep)
    rows = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), kept.alias("__keep"))
    own = common.written(own_licences(rows, threshold), "licences")
    mark = F.col("path").rlike(LICENCE_FILES) if is_licence_file is None else is_licence_file
    marked = files.where(mark).select(F.coalesce("path", F.lit("")).alias("path")).distinct()
    per_dir = own.join(marked, "path", "left_semi").withColumn("dir", parent(F.col("path")))
    per_dir = per_dir.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("neg"), "licence")).alias("d"))
    paths = rows.select("path", "__keep").withColumn("dir", parent(F.col("path")))
    # each directory once, with every directory above it: the path join that finds the nearest
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nearest = paths.select("dir").distinct().select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "above"))
    nearest = common.salted_join(nearest, per_dir.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("d.licence", (-F.col("d.neg")).alias("score"), "above"), "depth").alias("up"))
    out = common.salted_join(common.salted_join(paths, own, "path", "left"), nearest, "dir", "left")
    has = F.col("licence").isNotNull()
    return out.select(
        *([] if keep is None else [F.col("__keep").alias(keep)]),
        "path",
        F.coalesce("licence", "up.licence").alias("licence"),
        F.coalesce("score", "up.score").alias("score"),
        F.when(has, "own").when(F.col("up").isNotNull(), "inherited").alias("via"),
        F.when(~has, F.col("up.above")).alias("from_dir"),
    )


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies at source/language/hundred of ids/id, and one that begins with a notice
    stands for a licence file of its directory. A document without an id lies beside source/language, by its text's hash, and
    inherits nothing from other documents; null texts are empty."""
    docs = common.table(spark, sf_dir, "documents")
    none = F.lit("none")
    place = F.concat_ws("/", F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    place = F.when(F.col("doc_id").isNull(), F.concat(F.lit("none-"), F.md5(F.coalesce("text", F.lit(""))), F.lit("/none"))).otherwise(place)
    path = F.concat_ws("/", F.coalesce("source", none), F.coalesce("lang", none), place)
    files = docs.select(path.alias("path"), "text", "doc_id")
    found = scan_licences(files, is_licence_file=F.col("text").rlike(r"(?i)^[^\n]{0,200}?\b(?:" + "|".join(ANCHORS) + r")\b"), keep="doc_id")
    return found.select("doc_id", "licence", F.round("score", 6).alias("score"), "via", "from_dir")
