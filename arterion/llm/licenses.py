"""Licence scans by canonical digest lookup.

A text is put into canonical form: A-Z lower-cased, copyright lines gone,
equivalent spellings made one, and everything but letters and digits one blank.
A known licence has a length in that form, so of every run of whole lines of a
text that is as long as a known one, and begins like it, the digest is taken;
running sums of the lines' lengths tell where such runs end.  The digests are
hash-joined with those of the known licences, so a match means that an entire
licence stands there, as a file of its own or inside one, whatever its line
breaks and blank lines.  The list of licences is a parameter, in memory of each
task and thus to be of a bounded size (``MOST_KNOWN`` texts).

Defined results: a null or empty text has no run; a text that two licences share
counts for both; repeated texts count each time, also inside each other; rows
that repeat a doc_id count together; a null doc_id is a document of its own;
further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arterion.llm.common import LOWER, sql_literal, table, tidied, UPPER

#: Known texts, at most.
MOST_KNOWN = 10_000
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""

#: Known texts by licence: whole licences, and the notices and lines by which files name one.
KNOWN: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n" + _WARRANTY,
        "Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "SPDX-License-Identifier: ISC",
    ),
    "BSD-2-Clause": (f"{_BSD}\n{_BSD_WARRANTY}", "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (f"{_BSD}\n{_BSD3}\n{_BSD_WARRANTY}", "SPDX-License-Identifier: BSD-3-Clause"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n"
        "http://www.apache.org/licenses/LICENSE-2.0\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "SPDX-License-Identifier: 0BSD",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
        "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
        "For more information, please refer to <https://unlicense.org/>",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
        "SPDX-License-Identifier: Zlib",
    ),
    "BSL-1.0": (
        "Boost Software License - Version 1.0 - August 17th, 2003\n"
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "proprietary": ("All rights reserved.",),
}
#: Spellings that are one, after lower-casing.
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("https://", "http://"))
#: A line that opens with a copyright notice, not one that only opens with the word.
_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright[^a-z0-9\n]*(?:c\)|[0-9]{4}|by )|copyright *©|\(c\)|©)[^\n]*\n?"
_OTHER = r"[^a-z0-9\n]+"
#: So much of a known text is compared before a digest is taken.
HEAD = 12


def folded(texts: pa.Array) -> pa.Array:
    """The canonical form of each text, its line breaks kept."""
    low = bytes.maketrans(UPPER.encode(), LOWER.encode())
    out = pa.array([x.as_py().translate(low) for x in texts.cast(pa.large_binary()).fill_null(b"")], pa.large_binary()).cast(pa.large_string())
    out = pc.replace_substring_regex(out, _COPYRIGHT, "")
    for a, b in SPELLINGS:
        out = pc.replace_substring(out, a, b)
    return pc.replace_substring_regex(out, _OTHER, " ")


def lines_of(fold: str) -> list[str]:
    """The lines of a folded text that hold anything."""
    return [x for x in (x.strip(" ") for x in fold.split("\n")) if x]


def canonical(text: str) -> str:
    """The canonical form of a whole text."""
    return " ".join(lines_of(folded(pa.array([text]))[0].as_py()))


def digests(known: dict[str, tuple[str, ...]] = KNOWN) -> list[tuple[str, str, int, str]]:
    """(licence, sha256, length, head) of every known text's canonical form."""
    return sorted({(name, hashlib.sha256(c.encode()).hexdigest(), len(c), c[:HEAD]) for name, texts in known.items() for c in map(canonical, texts) if c})


def scan(docs: DataFrame, known: dict[str, tuple[str, ...]] = KNOWN) -> DataFrame:
    """(doc_id, license, n_places, first_line, whole): the licences whose entire text stands in a document; from which of
    its lines that hold anything at first (0: the first), and if that is all of it."""
    listed = digests(known)
    if len(listed) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    lengths: dict[str, list[int]] = {}
    for _, _, n, head in listed:
        lengths[head] = sorted({*lengths.get(head, []), n})
    heads = re.compile("|".join(map(re.escape, sorted(lengths, key=len, reverse=True))) or "(?!)")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shorter = {h: [n for g, found in lengths.items() if h.startswith(g) for n in found] for h in lengths}
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = []
                for k, fold in enumerate(folded(part.column(1))):
                    lines = lines_of(fold.as_py())
                    text = " ".join(lines)
                    if not heads.search(text):
                        continue
                    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]).tolist()
                    ends = set(at)
                    for j, a in enumerate(at[:-1]):
                        found = heads.match(text, a)
                        for n in shorter[found[0]] if found else ():
                            if a + n + 1 in ends:
                                rows.append((k, hashlib.sha256(text[a : a + n].encode()).hexdigest(), j, n == len(text)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())],
                    ["doc_id", "digest", "line", "whole"],
                )

    table_of = docs.sparkSession.createDataFrame([(a, b) for a, b, _, _ in listed], "license string, digest string")
    found = docs.select("doc_id", "text").mapInArrow(tidied(runs), f"doc_id {kind}, digest string, line long, whole boolean").join(F.broadcast(table_of), "digest")
    return found.groupBy("doc_id", "license").agg(F.count(F.lit(1)).alias("n_places"), F.min("line").alias("first_line"), F.max("whole").alias("whole"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    text = f"regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {sql_literal(_COPYRIGHT)}, '', 'g')"
    for a, b in SPELLINGS:
        text = f"replace({text}, '{a}', '{b}')"
    known = ", ".join(f"('{a}', '{b}', {n})" for a, b, n, _ in digests())
    return f"""
WITH k(license, digest, n) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace({text}, {sql_literal(_OTHER)}, ' ', 'g') AS t FROM documents),
u AS (SELECT r, doc_id, [trim(x, ' ') for x in string_split(t, chr(10)) if trim(x, ' ') <> ''] AS ls FROM d),
l AS (SELECT r, doc_id, array_to_string(ls, ' ') AS t, unnest(range(0, len(ls))) AS line, unnest([length(x) + 1 for x in ls]) AS n FROM u),
p AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY line) AS stop FROM l),
f AS (SELECT a.doc_id, a.line, a.t, a.stop - a.n AS start, k.n, license, digest FROM p a, (SELECT DISTINCT * FROM k) k WHERE EXISTS (SELECT 1 FROM p b WHERE b.r = a.r AND b.stop = a.stop - a.n + k.n + 1))
SELECT doc_id, license, count(*) AS n_places, min(line) AS first_line, bool_or(n = length(t)) AS whole
FROM f WHERE sha256(substring(t, CAST(start AS BIGINT) + 1, n)) = digest GROUP BY doc_id, license
"""


ORACLE_SQL = _oracle()
