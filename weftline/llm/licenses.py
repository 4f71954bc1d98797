"""License scans by canonical digests (operator 1): entire texts and entire lines are looked up among known licences."""

from __future__ import annotations

import functools
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Fixed values: (licence, text) of whole licences and of the lines by which texts name one.
KNOWN = (
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", "ISC License\n" + _ISC),
    ("ISC", _ISC),
    ("ISC", "Licensed under the ISC License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
)

#: Licences by SPDX id, whose lines are known; of the GNU ones also the ids that end in -only and -or-later.
SPDX = tuple("""MIT ISC 0BSD Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause MPL-1.1 MPL-2.0 Unlicense CC0-1.0 Zlib BSL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2
CDDL-1.0 CDDL-1.1 Artistic-1.0-Perl Artistic-2.0 OFL-1.1 NCSA WTFPL PSF-2.0 Unicode-3.0 MIT-0 BlueOak-1.0.0 PostgreSQL""".split()) + tuple(f"CC-BY{x}-{v}" for x in ("", "-SA", "-NC", "-ND", "-NC-SA", "-NC-ND") for v in ("1.0", "2.0", "2.5", "3.0", "4.0"))
GNU = ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3")
#: Titles that may stand over the shorter texts, and lines that may be missing or filled in.
TITLES = {"MIT": ("The MIT License", "The MIT License (MIT)", "MIT License"), "ISC": ("The ISC License", "ISC License"), "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'), "Zlib": ("zlib License", "The zlib License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"), "Unlicense": ("The Unlicense",)}
LAST, HOLDER, RIGHTS = "END OF TERMS AND CONDITIONS", "Copyright [yyyy] [name of copyright owner]", "All rights reserved."


@functools.cache
def shipped() -> tuple[tuple[str, str], ...]:
    """(licence, text) of KNOWN, of the whole texts in license_texts.json with their usual variants, and of SPDX lines.

    Variants are: without what follows the terms, with the appendix's holder filled in; of short texts, under a title, with
    a line that reserves all rights, and without the numbers of their clauses.
    """
    out = [*KNOWN, *((x, f"SPDX-License-Identifier: {x}") for x in SPDX)]
    out += [(x, f"SPDX-License-Identifier: {x}{end}") for x in GNU for end in ("", "-only", "-or-later")]
    files = json.loads(Path(__file__).with_name("license_texts.json").read_text(encoding="utf-8"))
    for name, text in [("MIT", _MIT), ("ISC", _ISC), *((x["license"], x["text"]) for x in files)]:
        bodies = [text, text.replace(HOLDER, "")]
        if LAST in text:
            bodies += [text[: text.index(LAST)], text[: text.index(LAST) + len(LAST)]]
        if name in TITLES:
            bodies.append(re.sub(r"(?m)^ *[0-9]\. ", "", text))
            bodies = [f"{title}\n{rights}\n{body}" for title in ("", *TITLES[name]) for rights in ("", RIGHTS) for body in bodies]
        out += [(name, body) for body in bodies]
    return tuple(dict.fromkeys(out))


#: Spellings that count as one, applied to lower-case text in this order.
SPELLINGS = (
    ("licence", "license"),
    ("non-commercial", "noncommercial"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("http://", "https://"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line of a copyright notice: the word or sign, and a year or a sign after it.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright[^a-z\n]*(\(c\)|©|[0-9]{4})|\(c\)[^a-z\n]*[0-9]{4}|©)[^\n]*$"
MARKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, in one spelling, words parted by single spaces. Null stays null."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), COPYRIGHT, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, MARKS, " "))


#: So many known digests at most are sent to all tasks.
SENT = 100_000


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """license and digest of the known texts (``shipped``, if none are given), each digest once."""
    rows = spark.createDataFrame(list(shipped() if known is None else known), "license string, text string")
    return rows.select(F.md5(canonical(F.col("text"))).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(docs: DataFrame, known: tuple[tuple[str, str], ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the whole canonical text), license (known for the whole text, or null) and notices.

    ``notices`` are the licences that whole lines of the text name, distinct and in order, joined by commas; empty if none.
    The known table is a parameter, by default ``shipped``; a digest that stands for several licences counts as the first.
    Its digests are sent to all tasks up to SENT of them and joined by exchange beyond. A null text has a null digest, an
    empty one the digest of the empty text; neither is known. Repeated rows have one result each; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    digests = known_digests(spark, known)
    if len(shipped() if known is None else known) <= SENT:
        digests = F.broadcast(digests)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    # only lines that are known leave the task
    named = rows.select("doc_id", "text_key", F.explode(F.transform(lines, lambda x: F.md5(canonical(x)))).alias("line")).join(digests.select(F.col("digest").alias("line"), "license"), "line")
    named = named.groupBy("doc_id", "text_key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = rows.select("doc_id", "text_key", F.md5(canonical(F.col("text"))).alias("digest")).join(digests, "digest", "left").alias("a")
    named = named.alias("b")
    out = whole.join(named, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key")), "left")
    return out.select("a.doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql(column: str) -> str:
    out = f"regexp_replace(translate({column}, '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"md5(trim(regexp_replace({out}, '{MARKS}', ' ', 'g'), ' '))"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The SQL knows KNOWN alone.
ORACLE_SQL = f"""
WITH k AS (SELECT {_sql("text")} AS digest, min(license) AS license FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in KNOWN)}) AS v(license, text) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, text, {_sql("text")} AS digest FROM documents),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l JOIN k ON {_sql("line")} = k.digest WHERE line <> '' GROUP BY r)
SELECT doc_id, d.digest, k.license, coalesce(notices, '') AS notices FROM d LEFT JOIN k ON d.digest = k.digest LEFT JOIN n USING (r)
"""
