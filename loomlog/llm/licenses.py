"""Licence scans by canonical digests of entire texts.

A text is normalised: lower case, copyright lines dropped, punctuation to single spaces, spellings
that licence guidelines call equivalent made one. Its SHA-256 is joined by hash to the digests of
known licences and notices. Three kinds of text are looked up entire: the document, its paragraphs
(between blank lines) and its lines. The known digests are a fixed list, so their side is broadcast;
documents aren't shuffled, only what was found.

The list is bounded: full texts of MIT, ISC and BSD alone; notices or one-line statements of
Apache-2.0, GPL-3.0 and Creative Commons, whose full texts have no match. A copyright line after a
comment mark stays in the text, which then has no match as a whole.

Defined results: null counts as empty; texts that normalise to nothing match nothing; a notice that
stands in a document twice is listed once; rows that share a doc_id share what is found in any of
them; null document ids have no notices; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, text_of

# Licence texts, and notices as they stand in files.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL3_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", _GPL3_NOTICE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
)
#: Equivalent spellings: left is written as right. Words of the normalised text.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("https", "http"),
)
#: A line that is a copyright notice, in lower case.
COPYRIGHT_LINE = r"(?m)^[ \t]*(?:copyright\b[ \t]*(?:\(c\)|©|[0-9])|\(c\)[ \t]|©)[^\n]*$"
#: What isn't part of a word; line feeds stay until the text is cut.
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def normalise(text: str) -> str:
    """The normal form of one text, as the expressions below make it."""
    text = re.sub(COPYRIGHT_LINE, "", text.lower())
    words = f" {' '.join(re.findall(r'[^\W_]+', text))} "
    for other, usual in SPELLINGS:
        words = words.replace(f" {other} ", f" {usual} ")
    return words.strip(" ")


def normal_lines(text: Column) -> Column:
    """A text in normal form that still has its line feeds."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), NOT_WORD, " ")
    return out


def collapsed(column: Column) -> Column:
    """Normal lines with single spaces for white space."""
    return F.trim(F.regexp_replace(column, r"[ \n]+", " "))


def one_text(column: Column) -> Column:
    """Normal lines -> the normal form of the whole."""
    return usual_spelling(collapsed(column))


def usual_spelling(column: Column) -> Column:
    out = F.concat(F.lit(" "), column, F.lit(" "))
    for other, usual in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {usual} "))
    return F.trim(out)


def known_digests() -> dict[str, str]:
    return {hashlib.sha256(normalise(text).encode()).hexdigest(): name for name, text in KNOWN}


def scan_licenses(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, whole_license (of the entire text, else null) and
    notices (sorted names found as the entire text, a paragraph or a line)."""
    spark = df.sparkSession
    digests = known_digests()
    known = spark.createDataFrame(sorted(digests.items()), "digest string, license string")
    longest = max(len(normalise(text)) for _, text in KNOWN)
    docs = df.select("doc_id", normal_lines(text_of("text")).alias("lines"))
    # the entire text, each paragraph and each line
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), collapsed(F.col("lines")).alias("unit"))),
        F.transform(F.split("lines", r"\n[ ]*\n"), lambda x: F.struct(F.lit(False).alias("whole"), collapsed(x).alias("unit"))),
        F.transform(F.split("lines", r"\n"), lambda x: F.struct(F.lit(False).alias("whole"), collapsed(x).alias("unit"))),
    )
    # equal spellings shorten a text by less than half, so what is longer than twice the longest
    # known one after its white space is collapsed can't match
    pieces = docs.select("doc_id", F.inline(F.filter(units, lambda u: (F.length(u["unit"]) <= 2 * longest) & (F.length(u["unit"]) > 1))))
    found = pieces.withColumn("digest", F.sha2(usual_spelling(F.col("unit")), 256)).join(F.broadcast(known), "digest")
    found = found.groupBy("doc_id").agg(F.max(F.when(F.col("whole"), F.col("license"))).alias("whole_license"), F.sort_array(F.collect_set("license")).alias("notices"))
    none = F.array().cast("array<string>")
    return df.select("doc_id").join(found, "doc_id", "left").select("doc_id", "whole_license", F.coalesce("notices", none).alias("notices"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licences and notices in every whole text of ``documents``."""
    out = scan_licenses(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce("whole_license", F.lit("")).alias("whole_license"), F.array_join("notices", ",").alias("notices"), F.size("notices").cast("long").alias("n_notices"))


def op5_sql() -> str:
    """DuckDB SQL for :func:`op5_license_scan`."""
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    spelled = "' ' || trim(regexp_replace(unit, '[ \\n]+', ' ', 'g')) || ' '"
    for other, usual in SPELLINGS:
        spelled = f"replace({spelled}, ' {other} ', ' {usual} ')"
    copyright_line = COPYRIGHT_LINE.replace("\n", "\\n")
    return f"""
WITH known(digest, license) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_replace(regexp_replace(lower(coalesce(text, '')), '{copyright_line}', '', 'g'), '{NOT_WORD}', ' ', 'g') AS t FROM documents),
u AS (
  SELECT doc_id, true AS whole, t AS unit FROM d
  UNION ALL SELECT doc_id, false, unnest(regexp_split_to_array(t, '\\n[ ]*\\n')) FROM d
  UNION ALL SELECT doc_id, false, unnest(string_split(t, chr(10))) FROM d
),
f AS (SELECT doc_id, whole, license FROM u JOIN known ON known.digest = sha256(trim({spelled}))),
g AS (SELECT doc_id, max(license) FILTER (WHERE whole) AS whole_license, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(DISTINCT license) AS n FROM f GROUP BY doc_id)
SELECT documents.doc_id, coalesce(whole_license, '') AS whole_license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM documents LEFT JOIN g ON documents.doc_id = g.doc_id
"""
