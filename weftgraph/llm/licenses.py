"""Licence scans by canonical digest lookup (operator 3), in DataFrame functions only.

A unit of text is canonical when copyright lines and list marks are gone, letters are lower case,
equivalent spellings are one spelling and everything between runs of letters and digits is one space; so
comment signs, bullets and line breaks don't matter.  Units are whole documents, whole lines and
paragraphs, which lines without a letter or digit part.  Their SHA-256 is joined to the digests of known
licence texts and notices.  A text of several paragraphs is found where all of them follow each other.
Every known form holds one of a few telling strings in each of its spellings (a test goes through them
all), so only documents and lines with one of these are canonicalised; that leaves nothing out.  A
caller's own digests tell nothing of their texts, so with these all are.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import only, stored, text_of

# Patterns of the canonical form, on lower case, alike in Java, RE2 and Python with ASCII classes.
#: A line that names a holder: with a year, a sign or "by"; one that only goes on with "copyright notice ..." stays.
COPYRIGHT_LINE = r"(^|\n)[^\w\n]*((copyright|\(c\)|©)[^\n]*[0-9]{4}|copyright[^\n]*(\(c\)|©)|copyright:? by )[^\n]*"
RESERVED_LINE = r"(^|\n)[^\w\n]*all rights reserved[^\w\n]*"
#: Numbers and letters of lists, at the start of a line or behind a stop.
LIST_MARK = r"(^|\n|[.:;,][^\S\n]+)[^\w\n]*([0-9]{1,2}|[a-z])[.)][^\S\n]+"
BETWEEN = r"[^\p{L}\p{N}]+"
#: What parts paragraphs: lines without a letter or digit.
BLANK = r"\n([^\p{L}\p{N}\n]*\n)+"
#: What any known form holds.
WORDS = ["licen", "permission", "warrant", "released", "distributed", "available"]
TELLING = "(?i)" + "|".join(WORDS)

# Equivalent spellings, on canonical words.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("authorised", "authorized"), ("authorisation", "authorization"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("honour", "honor"), ("judgement", "judgment"), ("merchantibility", "merchantability"), ("noncommercial", "non commercial"), ("organisation", "organization"),
    ("per cent", "percent"), ("programme", "program"), ("recognise", "recognize"), ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"),
    ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("v2", "version 2"), ("v3", "version 3"), ("ver", "version"),
]

# Names of licences in notices.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GPLv2 License", "GPL-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GPLv3 License", "GPL-3.0 License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0 License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "ISC": ["ISC License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero License"],
}
OPENINGS = ["Released", "Licensed", "Distributed", "Available", "This work is licensed", "This project is licensed", "This software is licensed", "This file is licensed"]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
# Public licence texts.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        f"Software.\n{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        'appear in all copies.\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_TWO + _BSD_END,
    "BSD-3-Clause": (
        _BSD_TWO + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission.\n" + _BSD_END
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\nPermission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would "
        "be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed "
        "or altered from any source distribution."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n'
        "http://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
}


# Titles above licence texts, besides the names in notices.
TITLES = {
    "MIT": ["The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "Expat License"],
    "ISC": ["The ISC License", "ISC License (ISC)", "ISC License (ISCL)"],
    "BSD-2-Clause": ["The BSD 2-Clause License", "FreeBSD License"],
    "BSD-3-Clause": ["The BSD 3-Clause License", "Modified BSD License"],
    "Zlib": ["The zlib/libpng License", "zlib License", "The zlib License"],
}
# SHA-256 of the canonical form of published full texts, too long to be kept here.
FULL_TEXTS = {
    "Apache-2.0": "b8b4b7a1a3fc45a40c173b28ca0fcfde44b6289443f009fcb8d3cd6162c57d6e",
    "Artistic-1.0-Perl": "4834e699353522cfb463bd8b374752ecf02156bb3f5dfb53d0edb502a112a651",
    "CC0-1.0": "51c4bf27767d074bdefc84db7420b4c55e27827dac6d8de3ef0d37b2042fb6fa",
    "GFDL-1.2": "66c938a4f3d2114cc3d60f4233a4f26e8c730064aa767788d4745dedea334da1",
    "GFDL-1.3": "196b51c8977291f601cc4b0712d6ab94eee07ddbc100b9ceaba3df650297607c",
    "GPL-1.0": "c2782eb348f9f68b0eda95b69ccab03d02099a4fec2c4362c552cdec537b1399",
    "GPL-2.0": "d97a76124fa907d78ee815043140e4a5404f9270cb679869ed0ae11e7e844e5a",
    "GPL-3.0": "1d853c80efe5ceb4de7b2f36ad97f5659946947afc9c6c75fa3fa50e20368ef2",
    "LGPL-2.0": "76e95bde887e452fdbf364b6e132f70904f43582182b76e0f71d88a2d8911ef7",
    "LGPL-2.1": "3c172029ca14deedef915e5d03e83bcc73647736d10c2be07d384571ca06b440",
    "LGPL-3.0": "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45",
    "MPL-1.1": "eba0a966528a8ede6a6847299cfaf0a84a7e032d6f03b7c57e4ee8c7e31c6042",
    "MPL-2.0": "08b1a22856394bde458c0d6061e7d669836ba5c6beab605f27eb3758223c7586",
}


def canonical_text(text: str) -> str:
    """The canonical form, on the driver, for known texts and tests."""
    t = text.lower()
    for pattern in (COPYRIGHT_LINE, RESERVED_LINE, LIST_MARK):
        t = re.sub(pattern, "\n", t, flags=re.ASCII)
    # two spaces between words, so that neighbouring spellings don't share one
    t = " " + "  ".join("".join(c if c.isalpha() or c.isnumeric() else " " for c in t).split()) + " "
    for a, b in SPELLINGS:
        t = t.replace(f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ")
    return " ".join(t.split())


def known_forms() -> list[tuple[str, str]]:
    """(canonical form, licence id) of texts and notices; a notice is an opening and a name, with or without an article."""
    forms: dict[str, str] = {}
    for name, text in TEXTS.items():
        forms[canonical_text(text)] = name
        for title in [*NAMES.get(name, [f"{name} License"]), *TITLES.get(name, [])]:
            forms[canonical_text(f"{title}\n{text}")] = name
    for name, words in NAMES.items():
        for opening in OPENINGS:
            for w in words:
                for article in ("", "the "):
                    for end in ("", " license"):
                        forms[canonical_text(f"{opening} under {article}{w}{end if 'licen' not in w.lower() else ''}")] = name
        for w in words:
            forms[canonical_text(f"{w} license" if "licen" not in w.lower() else w)] = name
        forms[canonical_text(f"SPDX-License-Identifier: {name}")] = name
    return sorted((t, name) for t, name in forms.items())


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def known_licenses() -> list[tuple[str, str]]:
    """(canonical digest, licence id) of all known forms."""
    return sorted([(_digest(t), name) for t, name in known_forms()] + [(d, name) for name, d in FULL_TEXTS.items()])


def known_paragraphs() -> list[tuple[str, str, int, int, int]]:
    """(canonical digest, licence id, way, place, of) of the paragraphs of known texts.

    A text can be parted in several ways: all its lines are paragraphs, all are one, or all but the last are.
    """
    out: list[tuple[str, str, int, int, int]] = []
    way = 0
    for name, text in sorted(TEXTS.items()):
        lines = text.split("\n")
        for parts in {tuple(lines), (text,), ("\n".join(lines[:-1]), lines[-1])}:
            for place, part in enumerate(parts):
                out.append((_digest(canonical_text(part)), name, way, place, len(parts)))
            way += 1
    return sorted(out)


def canonical(col: Column) -> Column:
    t = F.lower(col)
    for pattern in (COPYRIGHT_LINE, RESERVED_LINE, LIST_MARK):
        t = F.regexp_replace(t, pattern, "\n")
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, BETWEEN, "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b.replace(' ', '  ')} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def _tells(col: Column) -> Column:
    low = F.lower(col)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in WORDS])


def known_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_licenses(), "digest string, license_id string")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: id, text_license, n_license_lines, n_license_blocks, licenses.

    text_license is the licence that the whole text is (else null), n_license_lines counts lines that
    are a known text or notice, n_license_blocks counts runs of paragraphs that are a known text, licenses
    lists the distinct ids of all, sorted and comma-joined (empty string for none).  ``known`` has digest
    and license_id; where a digest has several ids the smallest counts, and every text, line and paragraph
    is looked up, whatever it holds.  Null and empty texts hold nothing; very long ones are read whole.
    Repeated rows are scanned alike, null ids are kept.  An empty table gives an empty result.  Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    told_by = _tells if known is None else (lambda c: c != "")
    if known is None:
        parts = spark.createDataFrame(known_paragraphs(), "digest string, license_id string, way int, place int, of int")
    else:
        parts = known.groupBy("digest").agg(F.min("license_id").alias("license_id")).select("*", F.lit(0).alias("way"), F.lit(0).alias("place"), F.lit(1).alias("of"))
    known = (known if known is not None else known_table(spark)).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    own = only(docs, id_col, text_col).select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    own = own.withColumn("_told", told_by(F.col("_text"))).select("_id", F.when(F.col("_told"), F.xxhash64("_text")).alias("_key"), F.when(F.col("_told"), F.col("_text")).alias("_text"))
    own = stored(own, "licenses")  # one pass over all texts keeps those that may hold something
    told = own.where(F.col("_key").isNotNull())
    lines = F.transform(F.filter(F.split("_text", "\n"), told_by), canonical)
    paragraphs = F.filter(F.transform(F.split("_text", BLANK), canonical), lambda x: x != "")
    # kinds of units: 0 the text, 1 lines, 2 paragraphs
    units = F.array(F.struct(F.lit(0).alias("kind"), F.array(canonical(F.col("_text"))).alias("u")), F.struct(F.lit(1).alias("kind"), lines.alias("u")), F.struct(F.lit(2).alias("kind"), paragraphs.alias("u")))
    rows = told.select("_id", "_key", F.explode(units).alias("k")).select("_id", "_key", "k.kind", F.posexplode("k.u").alias("_at", "_unit"))
    digests = stored(rows.select("_id", "_key", "kind", "_at", F.sha2("_unit", 256).alias("digest")), "license-units").distinct()
    single = digests.where("kind < 2").join(known, "digest").select("_id", "_key", "kind", "_at", "license_id")
    met = digests.where("kind = 2").join(parts, "digest").groupBy("_id", "_key", "license_id", "way", "of", (F.col("_at") - F.col("place")).alias("_at"))
    runs = met.agg(F.count_distinct("place").alias("n")).where("n = of").select("_id", "_key", F.lit(2).alias("kind"), "_at", "license_id").distinct()
    hits = single.unionByName(runs).groupBy("_id", "_key").agg(
        F.max(F.when(F.col("kind") == 0, F.col("license_id"))).alias("text_license"),
        F.count_if(F.col("kind") == 1).alias("n_license_lines"),
        F.count_if(F.col("kind") == 2).alias("n_license_blocks"),
        F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("licenses"),
    )
    hits = hits.withColumnsRenamed({"_id": "_hid", "_key": "_hkey"})
    rows = own.select("_id", "_key")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(hits, rows["_id"].eqNullSafe(hits["_hid"]) & (rows["_key"] == hits["_hkey"]), "left").select(
        F.col("_id").alias(id_col), "text_license", zero("n_license_lines"), zero("n_license_blocks"), F.coalesce("licenses", F.lit("")).alias("licenses")
    )


def license_sql() -> str:
    """The same rows in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        t = f"lower({x})"
        for pattern in (COPYRIGHT_LINE, RESERVED_LINE, LIST_MARK):
            t = f"regexp_replace({t}, {quote(pattern)}, chr(10), 'g')"
        t = f"concat(' ', trim(regexp_replace({t}, {quote(BETWEEN)}, '  ', 'g')), ' ')"
        for a, b in SPELLINGS:
            t = f"replace({t}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(replace({t}, '  ', ' '))"

    values = ", ".join(f"('{d}', '{n}')" for d, n in known_licenses())
    parts = ", ".join(f"('{d}', '{n}', {w}, {p}, {of})" for d, n, w, p, of in known_paragraphs())
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (VALUES {values}) v(digest, license_id) GROUP BY 1),
parts AS (SELECT * FROM (VALUES {parts}) v(digest, license_id, way, place, n_parts)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
told AS (SELECT r, t FROM d WHERE regexp_matches(t, {quote(TELLING)})),
units AS (SELECT r, 0 AS kind, t AS u FROM told UNION ALL
          SELECT r, 1, u FROM (SELECT r, unnest(string_split(t, chr(10))) AS u FROM told) WHERE regexp_matches(u, {quote(TELLING)})),
single AS (SELECT r, kind, license_id FROM (SELECT r, kind, sha256({canon('u')}) AS digest FROM units) JOIN known USING (digest)),
paragraphs AS (SELECT r, i, {canon('u')} AS u FROM (SELECT r, unnest(s) AS u, generate_subscripts(s, 1) AS i FROM (SELECT r, string_split_regex(t, {quote(BLANK)}) AS s FROM told))),
numbered AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY i) AS i, sha256(u) AS digest FROM paragraphs WHERE u <> ''),
runs AS (SELECT DISTINCT r, first_, license_id FROM (SELECT r, i - place AS first_, license_id, way FROM numbered JOIN parts USING (digest) GROUP BY r, i - place, license_id, way, n_parts HAVING count(DISTINCT place) = n_parts)),
hits AS (SELECT r, max(CASE WHEN kind = 0 THEN license_id END) AS text_license, count(*) FILTER (WHERE kind = 1) AS n, count(*) FILTER (WHERE kind = 2) AS b,
         string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses
         FROM (SELECT r, kind, license_id FROM single UNION ALL SELECT r, 2, license_id FROM runs) GROUP BY r)
SELECT doc_id, text_license, coalesce(n, 0) AS n_license_lines, coalesce(b, 0) AS n_license_blocks, coalesce(licenses, '') AS licenses FROM d LEFT JOIN hits USING (r)
"""
