"""License scans, in DataFrame functions only.

Units of a file are compared with license templates by sparse TF-IDF cosine: its lines (short
notices), its blocks (headers over several lines, the titles and paragraphs of licence texts), its
comments (headers of several paragraphs) and its whole text (licence files). A block is a run of lines between lines
without letters and digits, a comment a run of comment lines; a block ends where its comment does.

Of the templates that a file reaches, one that names a license goes before one that several licenses share, and both
before a notice that is none ("All rights reserved."); then the cosine decides. An identifier that the
file declares (SPDX) goes before all. Files without a license of their own
take that of the nearest directory above them which holds a licence file; one that is like no template stops
the search, and the license is ``unknown``.

Document frequencies are counted over all files, for the terms of the templates; a term
that no template has weighs like one that occurs nowhere, and only adds to a unit's length. A
unit is compared with a template only if they share one of the template's anchors: its
rarest terms, as many as it takes for the others to fall short of the threshold. A unit without an
anchor cannot reach the threshold, so nothing is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specweave.llm.common import boxed, hot_keys, lookup, quoted, sized, stored, unboxed

#: Notices, headers and texts of common licenses.
MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
BSD_3 = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
ZLIB = [
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    "This notice may not be removed or altered from any source distribution.",
]
LGPL_2_1 = [
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
]
APACHE_2 = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
]
GNU = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details.",
    "You should have received a copy of the GNU {kind} along with this program. If not, see https://www.gnu.org/licenses/.",
]
GNU_KINDS = [
    ("AGPL-3.0", "Affero General Public License", "3"),
    ("GPL-2.0", "General Public License", "2"),
    ("GPL-3.0", "General Public License", "3"),
    ("LGPL-3.0", "Lesser General Public License", "3"),
]
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", APACHE_2[0]),
    ("Apache-2.0", " ".join(APACHE_2)),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", " ".join([*BSD_3[:3], BSD_3[4]])),
    ("BSD-3-Clause", BSD_3[0]),
    ("BSD-3-Clause", BSD_3[3]),
    ("BSD-3-Clause", BSD_3[4]),
    ("BSD-3-Clause", " ".join(BSD_3)),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", MIT[0]),
    ("MIT", MIT[2]),
    ("MIT", " ".join(MIT)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", ZLIB[1]),
    ("Zlib", " ".join(ZLIB)),
    ("LGPL-2.1", LGPL_2_1[0]),
    ("LGPL-2.1", " ".join(LGPL_2_1)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    *[(name, text.format(kind=kind, version=version)) for name, kind, version in GNU_KINDS for text in (GNU[0], " ".join(GNU))],
]

#: Paragraphs of several licenses, and notices that are no license.
SHARED = {BSD_3[0], BSD_3[4]}
NOTICES = {"All-Rights-Reserved"}


def rank(name: str, text: str) -> int:
    """0 for a template that names its license, 1 for one that others share, 2 for a notice."""
    return 2 if name in NOTICES else int(text in SHARED)


TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.75

#: File names of licence files, and of those that are one whatever they hold.
LICENCE_NAME = r"(?i)^((?:un)?licen[cs]e|copying|notice)([-._].*)?\z"
ONLY_LICENCE_NAME = r"(?i)^((?:un)?licen[cs]e|copying)([-._].*)?\z"
UNKNOWN = "unknown"

#: A declared identifier or expression of such, and what it may say on later versions.
DECLARED = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+-]+)*)"
_LATER = r"(?:-only|-or-later|\+)(?=[ \t]|\z)"


def terms_of(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


#: A comment line before one that is none and the other way round, and the lines without letters and digits between blocks.
_COMMENT = r"[ \t]*(?:#|//|/?\*|--|;|%)"
_END_OF_COMMENT = rf"(?m)^({_COMMENT}[^\n]*)\n(?!{_COMMENT})"
_START_OF_COMMENT = rf"(?m)^(?!{_COMMENT})([^\n]*)\n(?={_COMMENT})"
_BETWEEN = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def blocks(text: Column) -> Column:
    """The blocks of a text."""
    return F.split(F.regexp_replace(text, _END_OF_COMMENT, "$1\n\n"), _BETWEEN)


def comments(text: Column) -> Column:
    """The runs of comment lines of a text, and the runs between them."""
    return F.split(F.regexp_replace(F.regexp_replace(text, _END_OF_COMMENT, "$1\n\x1e"), _START_OF_COMMENT, "$1\n\x1e"), "\x1e")


def vectors(templates: list[tuple[str, str]], files: int, df: dict[str, int], threshold: float) -> tuple[list[tuple[int, str, float]], dict[str, float], list[str]]:
    """(template, term, weight) of unit length, the idf of each term, and all anchors."""
    idf = {t: math.log((1 + files) / (1 + df.get(t, 0))) + 1 for _, text in templates for t in terms_of(text)}
    rows, anchors = [], set()
    for number, (_, text) in enumerate(templates):
        own = {t: n * idf[t] for t, n in Counter(terms_of(text)).items()}
        length = math.sqrt(sum(w * w for w in own.values()))
        left = 1.0
        for t, w in sorted(own.items(), key=lambda x: (df.get(x[0], 0), -x[1], x[0])):
            rows.append((number, t, w / length))
            if math.sqrt(max(0.0, left)) >= threshold - 1e-9:
                anchors.add(t)
                left -= (w / length) ** 2
    return rows, idf, sorted(anchors)


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The license of each file that has one: ``path``, ``own_license``, ``cosine``.

    A declared identifier wins (of several the first), with cosine 1 and without its word on later versions; then the template of
    the lowest `rank`, the highest cosine and the smallest name. Rows that
    repeat a path count as one file, whose units are those of all its rows. Null and empty
    texts and null paths have no license; texts of any length are taken whole; other columns of
    files are not read. An empty table gives an empty one."""
    templates = TEMPLATES if templates is None else templates
    spark = files.sparkSession
    files = files.select(quoted(path_col).alias("path"), quoted(text_col).alias("text")).filter("path is not null")
    named = F.regexp_replace(F.regexp_extract("text", DECLARED, 1), _LATER, "")
    declared = files.filter(F.col("text").contains("SPDX-License-Identifier:")).groupBy("path").agg(F.min(F.when(named != "", named)).alias("own_license")).filter("own_license is not null")
    declared = stored(declared.withColumn("cosine", F.lit(1.0)), "declared")
    if not templates:
        return declared
    known = sorted({t for _, text in templates for t in terms_of(text)})
    seen = files.select(F.array_intersect(terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, known))).alias("terms"))
    counts = {r["term"]: r["n"] for r in seen.select(F.explode(F.concat("terms", F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # one row a term
    total = counts.pop("", 0)
    rows, idf, anchors = vectors(templates, total, counts, threshold)
    unseen = math.log(1 + total) + 1

    anchor = rf"(?i)(?<![a-z0-9])(?:{'|'.join(map(re.escape, anchors))})(?![a-z0-9])"
    with_anchor = files.filter(F.col("text").rlike(anchor))
    units = with_anchor.select("path", F.explode(F.array_distinct(F.concat(F.filter(F.concat(F.split("text", "\n"), blocks(F.col("text")), comments(F.col("text"))), lambda u: u.rlike(anchor)), F.array("text")))).alias("unit"))
    units = units.select("path", F.xxhash64("unit").alias("unit"), terms(F.col("unit")).alias("terms"))
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))  # the templates' terms
    tf = stored(units.select("path", "unit", F.explode("terms").alias("term")).groupBy("path", "unit", "term").agg(F.count("*").alias("tf")), "tf")
    weighed = tf.join(weights, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    postings = F.broadcast(spark.createDataFrame(rows, "template int, term string, weight double"))
    # The length of a unit needs all its terms, the products only those of the templates.
    lengths = weighed.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    products = weighed.filter("idf is not null").join(postings, "term").groupBy("path", "unit", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("product"))
    of = F.array(*[F.struct(F.lit(rank(*t)).alias("rank"), F.lit(t[0]).alias("license")) for t in templates])
    scored = products.join(lengths, ["path", "unit"]).select("path", of[F.col("template")].alias("of"), F.round(F.col("product") / F.col("length"), 6).alias("cosine"))
    best = scored.filter(F.col("cosine") >= threshold).groupBy("path").agg(F.min(F.struct(F.col("of.rank").alias("rank"), (-F.col("cosine")).alias("far"), F.col("of.license").alias("license"))).alias("b"))
    best = best.select("path", F.col("b.license").alias("own_license"), (-F.col("b.far")).alias("cosine"))
    return best.join(declared.select("path"), "path", "left_anti").union(declared)


def directories(path: Column) -> Column:
    """All directories above a path, as (dir, depth); the one of depth 0 is ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth")))


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, keep_text: bool = True) -> DataFrame:
    """files with ``own_license``, ``cosine``, ``license`` (own, else inherited, else null),
    ``inherited_from`` (the directory) for inherited ones.

    A licence file is one whose name says so. Of several with a license in a directory that of the smallest path counts; a
    directory whose licence files, but for notices and empty ones, are like no template has the license ``unknown``. A file that is
    itself under such a name and like no template takes what its directory has. Rows stay rows; columns of these names are
    replaced, all others stay, whatever their names. A null path inherits nothing. An empty table gives an empty one."""
    made = ["own_license", "cosine", "license", "inherited_from"]
    box = boxed(files, (*made, *([] if keep_text else [text_col])), path=quoted(path_col))
    found = stored(scan(files, path_col, text_col, templates, threshold), "licenses")
    n_found = found.count()
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"/?[^/]*\z", "")
    seen = files.select(quoted(path_col).alias("path"), F.coalesce(F.lower(quoted(text_col)).rlike(TERM), F.lit(False)).alias("told")).filter("path is not null")
    stops = seen.filter(F.col("told") & name.rlike(ONLY_LICENCE_NAME)).select(folder.alias("dir")).distinct().withColumn("dir_license", F.lit(UNKNOWN))
    holders = found.filter(name.rlike(LICENCE_NAME)).groupBy(folder.alias("dir")).agg(F.min_by("own_license", "path").alias("dir_license"))
    holders = holders.union(stops).groupBy("dir").agg(F.coalesce(F.min(F.when(F.col("dir_license") != UNKNOWN, F.col("dir_license"))), F.lit(UNKNOWN)).alias("dir_license"))
    holders = stored(holders, "holders")
    paths = seen.select("path").distinct().join(sized(found.select("path"), n_found), "path", "left_anti")
    above = stored(paths.select("path", F.explode(directories(F.col("path"))).alias("d")).select("path", F.col("d.dir").alias("dir"), F.col("d.depth").alias("depth")), "above")
    counts = stored(above.groupBy("dir").agg(F.count("*").alias("n")), "dirs")
    near = lookup(above, holders, "dir", hot_keys(counts, "dir", above.count())).groupBy("path").agg(F.max_by(F.struct("dir", "dir_license"), "depth").alias("n"))
    verdict = found.select(F.col("path").alias("at"), "own_license", "cosine", F.col("own_license").alias("license"), F.lit(None).cast("string").alias("inherited_from"))
    verdict = verdict.union(near.select("path", F.lit(None).cast("string"), F.lit(None).cast("double"), F.col("n.dir_license"), F.col("n.dir")))
    verdict = stored(verdict, "verdict")
    return unboxed(box.join(sized(verdict, verdict.count()), F.col("path") == F.col("at"), "left"), *made)
