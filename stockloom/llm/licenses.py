"""Licence scan by canonical digests.

A text is normalised (A-Z folded, copyright lines (copyright with a year, a (c) sign or "by" behind it, or the sign with a
year) and "all rights reserved" removed, equivalent spellings
unified, punctuation and white space reduced to single spaces) and its SHA-256 is looked up, by a hash join, among the digests of
known licence texts, normalised the same way. Units are the whole document and each of its lines that
mentions a licence or copyright, for one-line notices. ``KNOWN`` holds four whole licences and common notices; the whole texts
of others (Apache, GPL, LGPL, MPL, CC0, ...) are long and come from a table (``catalog``) or a folder of them (``catalog_of_folder``), and ``scan`` takes any pattern of lines to look up.

Edge cases: a null text counts as empty and matches nothing; text that normalises to nothing matches nothing; rows that
repeat both doc_id and text give one row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n(©]*(copyright[^a-z0-9\n(©]*(\(c\)|©|[12][0-9][0-9][0-9]|by )|(\(c\)|©)[^a-z0-9\n]*(copyright|[12][0-9][0-9][0-9]))[^\n]*"
RESERVED = "all rights reserved"
#: Spellings taken as equal.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("organisation", "organization"), ("redistributions", "redistribution"), ("http://", "https://"), ("&", " and ")]
OTHER = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
MENTION = r"licen|copyright|spdx"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Fixed values: (licence, known text). Notices of one line stand beside whole licences.
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "The MIT License\n" + _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
]


def canonical(text: F.Column) -> F.Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    signed = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    out = F.when(signed, F.regexp_replace(low, COPYRIGHT_LINE, "$1")).otherwise(low)  # few texts need the pattern
    out = F.replace(out, F.lit(RESERVED), F.lit(" "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def digest(text: F.Column) -> F.Column:
    return F.sha2(canonical(text), 256)


def catalog(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """digest, license; one licence for a digest."""
    return spark.createDataFrame(known, "license string, text string").select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def catalog_of_folder(spark: SparkSession, folder: str) -> DataFrame:
    """digest, license of the texts of a folder, each named by its file (without .txt or .md)."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt|\.md)?$", 1).alias("license"), F.col("value").alias("text"))
    return files.select(digest(F.col("text")).alias("digest"), F.url_decode("license").alias("license")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(documents: DataFrame, known: DataFrame, mention: str | None = MENTION) -> DataFrame:
    """One row per document: doc_id, digest, license (of the whole text, or null), notices (licences of its lines, sorted,
    comma-joined), n_notices (lines that are a known notice). Lines that match ``mention`` are looked up; all of them
    where it is None. A row is known by its doc_id and text, so one that repeats is counted once."""
    if known.limit(shared.BROADCAST_ROWS + 1).count() <= shared.BROADCAST_ROWS:
        known = F.broadcast(known)
    text = shared.texts(documents).withColumn("text", F.coalesce("text", F.lit("")))
    every = F.split("text", "\n", -1)
    if mention is None:
        lines = every
    else:
        asked = F.filter(every, lambda x: F.translate(x, UPPER, LOWER).rlike(mention))
        lines = F.when(F.translate("text", UPPER, LOWER).rlike(mention), asked)
    units = text.select("doc_id", F.xxhash64("text").alias("raw"), digest(F.col("text")).alias("whole"), F.transform(lines, digest).alias("lines"))
    own = F.array(F.struct(F.lit(0).alias("line"), F.col("whole").alias("digest")))
    noted = F.transform(F.coalesce("lines", F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).alias("line"), x.alias("digest")))
    flat = units.select("doc_id", "raw", "whole", F.explode(F.concat(own, noted)).alias("u")).select("doc_id", "raw", "whole", "u.line", "u.digest")
    hit = flat.join(known, "digest", "left")
    line = F.when((F.col("line") > 0) & F.col("license").isNotNull(), F.struct("line", "license"))
    told = hit.groupBy("doc_id", "raw", "whole").agg(F.max(F.when(F.col("line") == 0, F.col("license"))).alias("license"), F.collect_set(line).alias("told"))  # known notices of one text
    return told.select("doc_id", F.col("whole").alias("digest"), "license", F.array_join(F.array_sort(F.array_distinct(F.transform("told", lambda x: x["license"]))), ",").alias("notices"), F.size("told").cast("long").alias("n_notices"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(shared.read(spark, sf_dir, "documents"), catalog(spark))


def _sql_canonical(x: str) -> str:
    out = f"translate(COALESCE({x}, ''), '{UPPER}', '{LOWER}')"
    out = f"regexp_replace({out}, '{COPYRIGHT_LINE}', '\\1', 'g')"
    out = f"replace({out}, '{RESERVED}', ' ')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '{OTHER}', ' ', 'g'))"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


ORACLE_SQL = f"""
WITH k AS (SELECT sha256({_sql_canonical("text")}) AS digest, MIN(license) AS license
           FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) x(license, text) GROUP BY 1),
d AS (SELECT DISTINCT doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, sha256({_sql_canonical("text")}) AS digest FROM d),
l AS (SELECT doc_id, text, unnest(str_split(text, chr(10))) AS line FROM w),
n AS (SELECT doc_id, text, k.license FROM l JOIN k ON sha256({_sql_canonical("line")}) = k.digest
      WHERE regexp_matches(translate(line, '{UPPER}', '{LOWER}'), '{MENTION}')),
a AS (SELECT doc_id, text, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, COUNT(*) AS n_notices FROM n GROUP BY ALL)
SELECT w.doc_id, w.digest, k.license, COALESCE(a.notices, '') AS notices, COALESCE(a.n_notices, 0)::BIGINT AS n_notices
FROM w LEFT JOIN k USING (digest) LEFT JOIN a ON a.doc_id IS NOT DISTINCT FROM w.doc_id AND a.text = w.text
"""
