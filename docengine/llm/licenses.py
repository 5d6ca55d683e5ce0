"""License scans: sparse TF-IDF cosine to templates, then inheritance down directories.

A file's units are its lines, its blocks (lines between lines without a letter or digit) and,
if its name is that of a licence file (``LICENCE_FILE``), its whole text. Units and templates,
which are notices, titles and whole licence texts, become sparse vectors: term counts, dampened
by a logarithm, times the inverse frequency of the term among the templates (a term of no
template counts as the rarest). The inner products come from a join of exploded terms with the
templates' terms, a table of fixed size; the cosine is their sum over the two norms. The
best template of at least ``least`` is the licence of the unit; of a file's units the best
counts, and a named licence before ``RESERVED``, which the texts of others contain.

Only units that can reach ``least`` are exploded, which loses none: by Cauchy-Schwarz a unit
that has none of a template's heaviest terms, left over with squares of under ``least`` squared,
stays below (``keys``), and so does one whose terms that stand in any template have under
``least`` squared of the squares of all its weights (``can_reach``), as prose has.

A file without a licence of its own inherits that of the nearest directory above it with
a licence file: its path is exploded into its ancestor directories, which join the
directories of licence files, and the deepest wins. If a directory has more than one
licence, the best score counts, then the name.

Null and empty texts have no units and may inherit. A null path has no ancestors, but keeps
what its own text says. Rows of one path and text have equal results, and each row stays. An
empty table gives an empty result. Other columns are not read, so names cannot clash.
Equal units are compared once. A directory with a third of all files is joined as it is:
each file has at most one row for each of its ancestors, and each directory at most one
licence, so the join makes no more rows than ancestors, and Spark may split it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.shared import materialize

# Public licences' texts, titles and the notices by which they are applied.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GPL_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""


def _gnu(kind: str, version: str, title: str) -> list[str]:
    notice = _GPL.format(kind=kind, version=version, colon=":" if version.startswith("3") else ";")
    return [notice, f"{notice} {_GPL_END.format(kind=kind)}", title]


TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        _APACHE,
        f"{_APACHE} {_APACHE_END}",
    ],
    "MIT": [
        "Released under the MIT License",
        "Licensed under the MIT license",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        _MIT,
        f"MIT License Copyright (c) {_MIT} {_MIT_NOTICE} {_AS_IS}",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "SPDX-License-Identifier: BSD-3-Clause",
        f"{_BSD} {_BSD_THIRD}",
        f"Copyright (c) All rights reserved. {_BSD} {_BSD_THIRD} {_BSD_END}",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License",
        "SPDX-License-Identifier: BSD-2-Clause",
        _BSD,
        f"Copyright (c) All rights reserved. {_BSD} {_BSD_END}",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        *_gnu("General Public License", "2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "GNU General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        *_gnu("General Public License", "3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ],
    "LGPL-2.1": ["SPDX-License-Identifier: LGPL-2.1-only", *_gnu("Lesser General Public License", "2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999")],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0-only",
        *_gnu("Lesser General Public License", "3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ],
    "AGPL-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3",
        "SPDX-License-Identifier: AGPL-3.0-only",
        *_gnu("Affero General Public License", "3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0", "Licensed under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", f"ISC License Copyright (c) {_ISC}", _ISC.split("\n")[0]],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0", "SPDX-License-Identifier: BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003 {_BOOST}"],
    "Zlib": ["Licensed under the zlib License", "SPDX-License-Identifier: Zlib", _ZLIB],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense", _UNLICENSE],
    "Proprietary": ["All rights reserved. Proprietary and confidential", "Unlicensed copying of this file is strictly prohibited, all rights reserved"],
}
#: Counts only where no other licence is found.
RESERVED = "Proprietary"
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[sc]e|copying|notice)[^/]*$"
TERM = "[^a-z0-9.]+"
#: What stands between terms before letters are lower-cased: all but ASCII letters, digits, dots and the two other letters
#: that become ASCII ones (U+0130 and U+212A). Ranges, possessive: a negated class takes Java five times as long.
APART = r"[\x00-\x2d/:-@\[-`{-\u012f\u0131-\u2129\u212b-\x{10ffff}]++"
#: Between blocks: lines without a letter or digit.
BETWEEN = r"\n(?:[^A-Za-z0-9\n]*\n)+"
LEAST = 0.6


def terms_of(text: Column) -> Column:
    """Terms of a text: lower-case letters, digits and inner dots."""
    # U+0130 becomes an i and a mark, which is between terms
    lowered = F.replace(F.lower(F.regexp_replace(text, APART, " ")), F.lit("\u0307"), F.lit(" "))
    cut = F.transform(F.split(lowered, " "), lambda t: F.btrim(t, F.lit(".")))
    return F.filter(cut, lambda t: t != "")


def weights(templates=None) -> tuple[list[tuple], dict[str, float], float]:
    """[(license, template, term, weight over the template's norm)], idf of each term, idf of other terms."""
    flat = [(name, f"{name}/{i}", text) for name, texts in (templates or TEMPLATES).items() for i, text in enumerate(texts)]
    bags = [Counter(t for t in (x.strip(".") for x in re.split(TERM, text.lower())) if t) for _, _, text in flat]
    names = [name for name, _, _ in flat]
    kinds = len(set(names))
    spread: dict[str, set] = {}
    for name, bag in zip(names, bags, strict=True):
        for t in bag:
            spread.setdefault(t, set()).add(name)
    idf = {t: math.log((1 + kinds) / (1 + len(s))) + 1 for t, s in spread.items()}
    rows = []
    for (name, key, _), bag in zip(flat, bags, strict=True):
        own = {t: (1 + math.log(n)) * idf[t] for t, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in own.values()))
        rows += [(name, key, t, w / norm) for t, w in own.items()]
    return rows, idf, math.log(1 + kinds) + 1


def template_terms(spark, templates=None) -> tuple[DataFrame, DataFrame, float]:
    """``weights`` as tables: (license, template, term, share), (term, idf); and the idf of other terms.

    Both tables are as large as the templates given, and no larger.
    """
    rows, idf, other = weights(templates)
    made = spark.createDataFrame(rows, "license string, template string, term string, share double")
    return made, spark.createDataFrame(list(idf.items()), "term string, idf double"), other


def keys(templates=None, least: float = LEAST) -> str:
    """A pattern that every unit with a cosine of ``least`` or more to a template matches.

    Of each template the rest of its terms, when the heaviest are taken out, has squares of
    under ``least`` squared; a unit of only these stays below.
    """
    taken: set[str] = set()
    by_template: dict[str, list] = {}
    for _, key, term, share in weights(templates)[0]:
        by_template.setdefault(key, []).append((share, term))
    for terms in by_template.values():
        rest = sum(share * share for share, term in terms if term not in taken)
        for share, term in sorted(terms, reverse=True):
            if rest < least * least - 1e-9:
                break
            if term not in taken:
                taken.add(term)
                rest -= share * share
    # by first letter, so that a word's start is compared with few of them
    by_first = [f"{re.escape(first)}(?:{'|'.join(re.escape(t[1:]) for t in of)})" for first, of in groupby(sorted(taken), lambda t: t[0])]
    return r"(?i)(?<![a-z0-9])(?:" + "|".join(by_first) + r")(?![a-z0-9])"


def matches(texts: DataFrame, templates=None, least: float = LEAST) -> DataFrame:
    """``texts`` (text, each once) with a license: (text, license, score)."""
    made, idf, other = template_terms(texts.sparkSession, templates)
    # a term goes with the number of its text, which is written with it, not with the text: of long texts that would be the square of their length
    texts = materialize(texts.withColumn("unit", F.monotonically_increasing_id()), "license-texts")
    counts = texts.select("unit", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(F.broadcast(idf), "term", "left").withColumn("w", (1 + F.log("n")) * F.coalesce("idf", F.lit(other)))
    norms = weighed.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    inner = weighed.join(F.broadcast(made), "term").groupBy("unit", "license", "template").agg(F.sum(F.col("w") * F.col("share")).alias("inner"))
    scored = inner.join(norms, "unit").select("unit", "license", F.least(F.col("inner") / F.col("norm"), F.lit(1.0)).alias("score"))
    scored = scored.where(F.col("score") >= least).groupBy("unit", "license").agg(F.max("score").alias("score"))
    best = scored.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    return texts.join(best, "unit").select("text", "best.license", (-F.col("best.s")).alias("score"))


def ancestors(path: Column) -> Column:
    """Directories above a path, as structs (dir, depth); the root is the empty string."""
    cut = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(cut) - 1), lambda i: F.struct(F.array_join(F.slice(cut, 1, i), "/").alias("dir"), i.alias("depth")))


def can_reach(text: Column, templates=None, least: float = LEAST) -> Column:
    """False only for a unit whose cosine to every template is below ``least``, by the weights of its terms that stand in templates.

    Other terms count as if each stood once, so the bound holds however often they do.
    """
    _, idf, other = weights(templates)
    by_idf: dict[float, list[str]] = {}
    for t, value in idf.items():
        by_idf.setdefault(value, []).append(t)
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)

    def idf_of(t: Column) -> Column:
        # sets, commonest first; a look into a map goes through its keys
        (first, of), *rest = sorted(by_idf.items())
        out = F.when(t.isin(of), first)
        for value, of in rest:
            out = out.when(t.isin(of), value)
        return out

    def bound(x: Column) -> Column:
        square = lambda s, t: s + F.pow((1 + F.log((F.size(x["terms"]) - F.size(F.array_remove(x["terms"], t))).cast("double"))) * idf_of(t), F.lit(2.0))
        inside = F.aggregate(x["inside"], F.lit(0.0), square)
        return (F.size(x["different"]) - F.size(x["inside"])) * F.lit(other * other * least * least) <= (1 - least * least) * inside + 1e-6

    def cut(terms: Column) -> Column:
        different = F.array_distinct(terms)
        return let(F.struct(terms.alias("terms"), different.alias("different"), F.filter(different, lambda t: t.isin(list(idf))).alias("inside")), bound)

    return let(terms_of(text), cut)


def units(text: Column, named: Column, pattern: str, templates=None, least: float = LEAST) -> Column:
    """The different units of a text that match ``pattern`` and ``can_reach`` the bar."""
    none = F.array().cast("array<string>")
    every = F.concat(F.split(text, "\n", -1), F.split(text, BETWEEN, -1), F.when(named, F.array(text)).otherwise(none))
    # a text without any match has no unit
    return F.when(text.rlike(pattern), F.filter(F.array_distinct(every), lambda x: x.rlike(pattern) & can_reach(x, templates, least))).otherwise(none)


def first_of(license: Column, score: Column) -> Column:
    """What to take the least of: named licences before ``RESERVED``, then by score, then by name."""
    return F.struct((license == RESERVED).alias("reserved"), (-score).alias("s"), license.alias("license"))


def scan(files: DataFrame, path: str = "path", text: str = "text", templates=None, least: float = LEAST) -> DataFrame:
    """(path, license, score, origin, license_path) for each row of ``files``; origin is header, file, inherited or none."""
    rows = files.select(F.col(f"`{path}`").alias("path"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("path", "text"))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    found = rows.select("key", "path", named.alias("named"), F.explode(units(F.col("text"), named, keys(templates, least), templates, least)).alias("text"))
    found = materialize(found, "license-units")
    best = found.join(matches(found.select("text").distinct(), templates, least), "text")
    best = best.groupBy("key", "path", "named").agg(F.min(first_of(F.col("license"), F.col("score"))).alias("best"))
    own = materialize(best.select("key", "path", "named", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score")), "licenses")
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    dirs = own.where("named").groupBy(parent.alias("dir")).agg(F.min(F.struct(first_of(F.col("license"), F.col("score")).alias("of"), "path")).alias("top"))
    dirs = materialize(dirs.select("dir", F.col("top.of.license").alias("license"), (-F.col("top.of.s")).alias("score"), F.col("top.path").alias("license_path")), "license-dirs")
    paths = rows.select("path").where("path is not null").distinct()
    above = paths.select("path", F.explode(ancestors(F.col("path"))).alias("up")).select("path", "up.dir", "up.depth")
    nearest = above.join(dirs, "dir").groupBy("path").agg(F.max(F.struct("depth", "license", "score", "license_path")).alias("near"))
    out = rows.select("key", "path").join(own.select(F.col("key").alias("k"), "named", "license", "score"), F.col("key") == F.col("k"), "left")
    out = out.join(nearest.select(F.col("path").alias("q"), "near"), F.col("path") == F.col("q"), "left")
    has = F.col("license").isNotNull()
    origin = F.when(has & F.col("named"), "file").when(has, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        "path",
        F.coalesce("license", "near.license").alias("license"),
        F.coalesce("score", F.col("near.score"), F.lit(0.0)).alias("score"),
        origin.alias("origin"),
        F.when(has, F.col("path")).otherwise(F.col("near.license_path")).alias("license_path"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    """Documents as files of a directory for each source: ``source/doc_id``; a null id has an empty name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    files = docs.select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("path"), "text")
    out = scan(files)
    # the id is what follows the last slash
    named = F.substring_index("path", "/", -1)
    return out.select(F.when(named != "", named).cast("long").alias("doc_id"), "path", "license", F.round("score", 6).alias("score"), "origin", "license_path")


def _sql() -> str:
    """The query for DuckDB. Sources of these tables are no licence files' names, so nothing is inherited."""
    rows, idf, other = weights()
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    shares = ", ".join(f"({quote(n)}, {quote(k)}, {quote(t)}, {w!r}::DOUBLE)" for n, k, t, w in rows)
    idfs = ", ".join(f"({quote(t)}, {w!r}::DOUBLE)" for t, w in idf.items())
    return f"""
WITH made(license, template, term, share) AS (VALUES {shares}), idf(term, idf) AS (VALUES {idfs}),
d AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(doc_id::VARCHAR, '') AS path, coalesce(text, '') AS text FROM documents),
u AS (
  SELECT DISTINCT path, text, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n(?:[^A-Za-z0-9\n]*\n)+'))) AS unit FROM d
), v AS (SELECT DISTINCT unit FROM u), b AS (
  SELECT unit, trim(unnest(string_split_regex(lower(unit), '[^a-z0-9.]+')), '.') AS term FROM v
), c AS (SELECT unit, term, count(*) AS n FROM b WHERE term <> '' GROUP BY ALL),
w AS (SELECT c.unit, c.term, (1 + ln(n)) * coalesce(idf.idf, {other!r}::DOUBLE) AS w FROM c LEFT JOIN idf USING (term)),
norms AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY unit),
s AS (
  SELECT unit, license, template, sum(w * share) AS inner_product FROM w JOIN made USING (term) GROUP BY ALL
), m AS (
  SELECT unit, license, max(least(inner_product / norm, 1.0)) AS score FROM s JOIN norms USING (unit) WHERE inner_product / norm >= {LEAST} GROUP BY ALL
), best AS (
  SELECT unit, license, score, row_number() OVER (PARTITION BY unit ORDER BY score DESC, license) AS k FROM m
), own AS (
  SELECT u.path, u.text, license, score, row_number() OVER (PARTITION BY u.path, u.text ORDER BY license = '{RESERVED}', score DESC, license) AS k
  FROM u JOIN best ON u.unit = best.unit AND best.k = 1
)
SELECT d.doc_id, d.path, own.license, round(coalesce(own.score, 0), 6) AS score,
       CASE WHEN own.license IS NULL THEN 'none' ELSE 'header' END AS origin, CASE WHEN own.license IS NULL THEN NULL ELSE d.path END AS license_path
FROM d LEFT JOIN own ON d.path = own.path AND d.text = own.text AND own.k = 1
"""


OP9_SQL = _sql()
