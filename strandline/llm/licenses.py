"""License scans: sparse TF-IDF cosine to templates, then inheritance along paths.

Every sentence of a file is compared with short notices, and the whole file with
whole licence texts; a file without a licence of its own takes that of the
nearest directory above it that holds a licence file. A term weighs one and
the logarithm of its count, times its inverse document frequency over all
templates; a term that no template has weighs as much as the rarest one.
Everything is array arithmetic on a row, so the scan needs no shuffle;
inheritance joins directories, not files, with their ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WORD, let, materialize

#: Cosine from which a sentence, or a whole text, names a licence.
LEAST = 0.6
#: A file is a licence file if its matching sentences hold this share of its words, or its name says so.
FILE_SHARE = 0.5

#: What stands beside many licences; it says something only where nothing else does.
RESERVED = "All rights reserved."
#: Notices, headings and opening sentences of common licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work: CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("proprietary", RESERVED),
]
_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Whole texts of licences that are short, and the whole notices that stand for long ones.
FILE_TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_TAIL),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
]
#: The notice's other versions and licences.
_GNU = dict(FILE_TEMPLATES)["GPL-3.0"]
FILE_TEMPLATES += [
    ("GPL-2.0", _GNU.replace("version 3", "version 2")),
    ("LGPL-2.1", _GNU.replace("version 3", "version 2.1").replace("General Public", "Lesser General Public")),
    ("LGPL-3.0", _GNU.replace("General Public", "Lesser General Public")),
    ("AGPL-3.0", _GNU.replace("General Public", "Affero General Public")),
]
#: Names of licence files, without their extension.
FILE_NAMES = ["license", "licence", "copying", "copyright", "unlicense", "notice"]

#: Function words; they weigh as if every template held them.
FUNCTION_WORDS = [
    "a", "all", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "do", "either", "even", "for", "from", "has", "have", "how", "if", "in", "into", "is", "it", "its", "may", "more", "no", "non", "nor", "not", "of", "on", "or",
    "other", "our", "out", "shall", "should", "so", "such", "that", "the", "these", "this", "to", "under", "use", "was", "we", "were", "what", "whether", "which", "whom", "will", "with", "without", "would", "you", "your",
]
#: Anchors of whole licences that a text within reach of one holds at least.
FILE_ANCHORS = 2


def counts_of(text: str) -> dict[str, int]:
    return Counter(re.findall(r"[a-z0-9]+", text.lower()))


@cache
def weights() -> dict[str, float]:
    """Squared inverse document frequency of every template term."""
    bags = [set(counts_of(text)) for _, text in TEMPLATES + FILE_TEMPLATES]
    return {w: 1.0 if w in FUNCTION_WORDS else (math.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1) ** 2 for w in sorted(set().union(*bags))}


def unknown() -> float:
    """What a term outside the templates weighs, squared."""
    return (math.log(1 + len(TEMPLATES) + len(FILE_TEMPLATES)) + 1) ** 2


def damped(n: int) -> float:
    """What a count weighs: many a word that a long text repeats says no more than a few."""
    return 1 + math.log(n)


def vector(text: str) -> tuple[dict[str, float], float]:
    """A template's damped count times squared frequency weight by term, and its length."""
    w, found = weights(), counts_of(text)
    return {t: damped(n) * w[t] for t, n in sorted(found.items())}, math.sqrt(sum(damped(n) ** 2 * w[t] for t, n in found.items()))


def anchors_of(templates: list[tuple[str, str]], hits: int) -> list[str]:
    """Terms of which a text within ``LEAST`` of any of the templates has at least ``hits``.

    With fewer of a template's anchors, be they its heaviest, the share of its
    length that a text can still have in common keeps the cosine below ``LEAST``.
    """
    found: set[str] = set()
    w = weights()
    for _, text in templates:
        size = {t: damped(n) ** 2 * w[t] for t, n in counts_of(text).items()}
        total = sum(size.values())

        def open_share(found: set[str]) -> float:
            mine = sorted((size[t] for t in size if t in found), reverse=True)
            return (total - sum(mine[hits - 1 :])) / total

        # The rarest terms first: function words would let every text through.
        for t in sorted(size, key=lambda t: (-w[t], -size[t], t)):
            if math.sqrt(open_share(found)) < LEAST - 1e-9:
                break
            found.add(t)
    return sorted(found)


@cache
def anchors(whole: bool = False) -> list[str]:
    """Anchors of the notices, or of the whole licences."""
    return anchors_of(FILE_TEMPLATES, FILE_ANCHORS) if whole else anchors_of(TEMPLATES, 1)


def pattern(words: list[str]) -> str:
    """A pattern of any of the words, by first letter: most words of a text fail after one comparison."""
    initials = sorted({w[0] for w in words})
    return r"\b(?:" + "|".join(f"{c}(?:{'|'.join(w[1:] for w in words if w[0] == c)})" for c in initials) + r")\b"


#: What opens a comment's line, and where joined lines end a sentence.
_COMMENT = r"(?m)^[ \t]*(?://+|#+|/?\*+/?|--+|;+|%+|<!--)[ \t]?"
_END = r"(?<=[.!?])\s+(?=[\p{Lu}\"'(])"


def sentences(text: Column) -> Column:
    """The pieces of a text's lines, as they stand."""
    return F.split(text, r"\n|(?<=[.!?;:]) ")


def joined_sentences(text: Column) -> Column:
    """The sentences of a text's paragraphs: comment marks dropped, wrapped lines joined."""
    paragraphs = F.split(F.regexp_replace(text, _COMMENT, ""), r"\n[ \t\r]*\n")
    return F.flatten(F.transform(paragraphs, lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), _END)))


def term_counts(text: Column) -> Column:
    """(term, n) of a text's terms with their damped counts: sorted, then cut where the term changes."""
    words = F.array_sort(F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), ""))

    def of(s: Column) -> Column:
        changes = F.filter(F.transform(s, lambda x, j: F.when((j == 0) | (x != F.get(s, F.greatest(j - 1, F.lit(0)))), j)), lambda j: j.isNotNull())
        return let(changes, lambda f: F.transform(f, lambda j, k: F.struct(F.get(s, j).alias("term"), (1 + F.log((F.coalesce(F.get(f, k + 1), F.size(s)) - j).cast("double"))).alias("n"))))

    return let(words, of)


def best_match(text: Column, templates: list[tuple[str, str]]) -> Column:
    """Struct (score, license) of the nearest template; equal scores go to the name that sorts last."""
    of_map = lambda d: F.create_map(*[x for t, v in d.items() for x in (F.lit(t), F.lit(v))])
    idf = of_map(weights())
    forms = [(name, *vector(text)) for name, text in templates]
    shelf = F.array(*[F.struct(F.lit(name).alias("license"), of_map(v).alias("v"), F.lit(norm).alias("norm")) for name, v, norm in forms])

    def scored(found: Column) -> Column:
        known = F.filter(found, lambda c: F.map_contains_key(idf, c["term"]))
        square = lambda cs, w: F.aggregate(cs, F.lit(0.0), lambda s, c: s + c["n"] * c["n"] * w(c))
        nothing = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("license"))

        def of(known: Column) -> Column:
            mine = square(known, lambda c: F.element_at(idf, c["term"]))
            whole = square(found, lambda c: F.coalesce(F.try_element_at(idf, c["term"]), F.lit(unknown())))
            # The cosine with any template is at most the share of the length that known terms hold.
            near = let(F.greatest(F.sqrt(whole), F.lit(1e-9)), lambda n: F.array_max(F.transform(shelf, lambda t: F.struct((F.aggregate(known, F.lit(0.0), lambda s, c: s + c["n"] * F.coalesce(F.try_element_at(t["v"], c["term"]), F.lit(0.0))) / (n * t["norm"])).alias("score"), t["license"].alias("license")))))
            return F.when(mine < (LEAST * LEAST - 1e-9) * whole, nothing).otherwise(near)

        return let(known, of)

    return let(term_counts(text), scored)


def detect(files: DataFrame) -> DataFrame:
    """Add to every row of ``files`` (path, text): license, score, file_share.

    ``license`` is that of the licence nearest to the whole text or, if none is
    within ``LEAST``, of the notice or heading nearest to any sentence, as its
    lines stand and as wrapped lines read without comment marks (null if none is;
    reserved rights only if no licence is), ``score`` its cosine (0 if none),
    ``file_share`` the share of words in matching sentences, 1 if the whole text
    is a licence. Null and empty texts have none; texts are read whole. Columns
    of these names are replaced, others pass through.
    """
    anchor = pattern(anchors())

    def matched(parts: Column) -> Column:
        hits = F.when(F.lower("text").rlike(anchor), F.filter(parts, lambda x: F.lower(x).rlike(anchor))).otherwise(F.array().cast("array<string>"))
        found = F.filter(F.transform(hits, lambda x: F.struct(best_match(x, TEMPLATES).alias("m"), F.regexp_count(x, F.lit(WORD)).alias("words"))), lambda x: x["m"]["score"] >= LEAST)
        return F.coalesce(found, F.array().cast(found_type()))

    named = F.regexp_count(F.lower("text"), F.lit(pattern(anchors(whole=True)))) >= FILE_ANCHORS
    nothing = F.lit(None).cast("struct<score:double,license:string>")
    whole = F.when(named, best_match(F.col("text"), FILE_TEMPLATES)).otherwise(nothing)
    wrapped = F.col("text").contains("\n")
    files = files.withColumn("_lines", matched(sentences(F.col("text")))).withColumn("_joined", F.when(wrapped, matched(joined_sentences(F.col("text")))).otherwise(F.array().cast(found_type()))).withColumn("_whole", F.when(whole["score"] >= LEAST, whole))
    # A sentence may stand in several licences; the whole text tells them apart. Reserved rights count where nothing else is found.
    every = F.transform(F.concat("_lines", "_joined"), lambda x: x["m"])
    best = F.coalesce(F.col("_whole"), F.array_max(F.filter(every, lambda m: m["license"] != "proprietary")), F.array_max(every))
    said = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + x["words"])
    share = F.when(F.col("_whole").isNotNull(), F.lit(1.0)).otherwise(F.coalesce(F.greatest(said("_lines"), said("_joined")) / F.greatest(F.regexp_count("text", F.lit(WORD)), F.lit(1)), F.lit(0.0)))
    return files.withColumn("license", best["license"]).withColumn("score", F.coalesce(best["score"], F.lit(0.0))).withColumn("file_share", share).drop("_lines", "_joined", "_whole")


def found_type() -> str:
    return "array<struct<m:struct<score:double,license:string>,words:int>>"


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def inherit(found: DataFrame) -> DataFrame:
    """Give rows without a licence that of the nearest directory at or above theirs with a licence file.

    ``found`` has path and what ``detect`` adds. Adds origin: header, file,
    inherited or none; and licensed_by, the directory inherited from. Of several
    licence files in a directory the best score decides, then the name. Rows
    with a null path neither give nor inherit; repeated rows are judged each.
    """
    name = F.regexp_replace(F.lower(F.element_at(F.split("path", "/"), -1)), r"\.[a-z]+$", "")
    found = found.withColumn("dir", directory(F.col("path"))).withColumn("is_file", F.col("license").isNotNull() & (name.isin(FILE_NAMES) | (F.col("file_share") >= FILE_SHARE)))
    held = found.where("is_file AND path IS NOT NULL").groupBy(F.col("dir").alias("above")).agg(F.max(F.struct("score", "license")).alias("best")).select("above", F.col("best.license").alias("given"))
    dirs = found.where("license IS NULL AND path IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    ways = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))).alias("way")).select("dir", "way.*")
    nearest = ways.join(held, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("near")).select(F.col("dir").alias("_dir"), "near")
    joined = found.join(nearest, (found["dir"] == nearest["_dir"]) & found["license"].isNull(), "left")
    origin = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    columns = [c for c in found.columns if c not in ("dir", "is_file", "license", "file_share")]
    return joined.select(*columns, F.coalesce("license", F.col("near.given")).alias("license"), origin.alias("origin"), F.col("near.above").alias("licensed_by"))


def scan(files: DataFrame, keep: list[str]) -> DataFrame:
    """Licences of every row of ``files`` (path, text): the columns ``keep``, path, score, license, origin, licensed_by.

    Null texts name no licence but inherit one; a null path neither gives nor
    inherits. Repeated rows are judged each. No files give no rows.
    """
    found = materialize(detect(files.select(*keep, "path", "text")).drop("text"), "licenses")
    return inherit(found)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as files: source / thousands / hundreds of the id / id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), path).alias("path")), ["doc_id"])
