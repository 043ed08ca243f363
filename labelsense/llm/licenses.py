"""Licence scan by canonical digests: whole texts are normalised and hash-joined to known licences.

Normal form: lower case; lines that state a copyright are dropped; spellings that mean the same are
made one; all but letters and digits becomes a blank. Two units are looked up by the SHA-256 of
their normal form: the text as a whole, and each of its lines as a whole, because notices of one
line are put above or below a document. The catalogue is fixed and of a few hundred rows, so it is
broadcast. It holds the full texts of MIT, BSD, ISC and 0BSD, the file headers of Apache-2.0 and
GPL-3.0, and notices of one line; further full texts are a parameter.

Defined results: null and empty texts, and units without a letter or digit, match nothing; equal
rows give equal matches, a notice that stands on several lines matches once per line, an empty table
gives an empty table; other columns of the input are not read.
"""

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that mean the same, after lower-casing.
SPELLINGS = (
    ("licence", "license"),
    ("licencing", "licensing"),
    ("licencee", "licensee"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("merchantibility", "merchantability"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("©", "(c)"),
)
# A line that states a copyright: with a year, a sign or a place for the year; "copyright notice" and the
# like at the start of a line state none. Before a clause on the same line, only the statement goes.
_STATED = r"^[^\p{L}\p{N}(©]*(?:copyright[^\n]{0,200}?(?:(?:19|20)[0-9][0-9]|\(c\)|©|[<\[{]year)|\(c\)|©)"
CLAUSE = r"(permission is hereby granted|permission to use, copy|redistribution and use in)"
BEFORE_CLAUSE = _STATED + r"[^\n]{0,200}?" + CLAUSE
COPYRIGHT_LINE = _STATED + r"[^\n]*$"
RESERVED_LINE = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}\n]*$"
MARKS = r"[^\p{L}\p{N}\n]+"

# The texts of licences as published, without their copyright lines.
_NO_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
_NO_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted{0}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

"""
    + _NO_WARRANTY_MIT,
    "BSD-2-Clause": _BSD_START + _NO_WARRANTY_BSD,
    "BSD-3-Clause": _BSD_START + _BSD_NAMES + _NO_WARRANTY_BSD,
    "ISC": _ISC.format(", provided that the above\ncopyright notice and this permission notice appear in all copies"),
    "0BSD": _ISC.format(""),
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
}

# Names under which licences are given in notices of one line.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "ISC": ("ISC License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0"),
} | {f"CC-{kind.replace(' ', '-')}-4.0": (f"CC {kind} 4.0", f"Creative Commons {kind} 4.0 License")
     for kind in ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")}
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License"),
    "ISC": ("ISC License", "The ISC License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
}
NOTICES = ("{verb} under {name}", "{verb} under the {name}", "This {thing} is {verb} under {name}",
           "This {thing} is {verb} under the {name}")
VERBS, THINGS = ("licensed", "released", "distributed"), ("work", "project", "software", "file")


_WIDE = [(spelling, one) for spelling, one in SPELLINGS if " " in spelling]  # a line may end inside them


def normal_lines(text: Column) -> Column:
    """The lines of a text in normal form; white space and marks are single blanks, ends are bare."""
    column = F.regexp_replace(F.lower(text), "(?m)" + BEFORE_CLAUSE, "$1")
    for dropped in (COPYRIGHT_LINE, RESERVED_LINE):
        column = F.regexp_replace(column, "(?m)" + dropped, "")
    for spelling, one in SPELLINGS:
        column = F.replace(column, F.lit(spelling), F.lit(one))
    lines = F.split(F.regexp_replace(column, MARKS, " "), "\n")
    return F.transform(lines, lambda line: F.trim(line))


def normal_text(text: str) -> str:
    """The same for a text of the catalogue."""
    column = text.lower()
    for pattern, new in ((BEFORE_CLAUSE, r"\1"), (COPYRIGHT_LINE, ""), (RESERVED_LINE, "")):
        column = re.sub(pattern.replace(r"\p{L}\p{N}", r"\w"), new, column, flags=re.M)
    for spelling, one in SPELLINGS:
        column = column.replace(spelling, one)
    column = " ".join(re.findall(r"[^\W_]+", column))
    for spelling, one in _WIDE:
        column = column.replace(spelling, one)
    return column


def catalogue(more: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """Digest, licence and kind ("text" or "notice") of every known form; some hundred rows.

    ``more``: further full texts by licence, of which the caller knows the number.
    """
    forms = {}
    for name, text in [*TEXTS.items(), *(more or {}).items()]:
        for title in ("", *TITLES.get(name, ())):
            forms[normal_text(f"{title}\n{text}")] = (name, "text")
    for license_id, names in NAMES.items():
        for name in names:
            for verb in VERBS:
                for thing in THINGS:
                    for notice in NOTICES:
                        form = normal_text(notice.format(verb=verb, thing=thing, name=name))
                        forms.setdefault(form, (license_id, "notice"))
    return [(hashlib.sha256(form.encode()).hexdigest(), *entry) for form, entry in forms.items()]


def license_matches(
    docs: DataFrame, text: str = "text", id_: str = "doc_id", more: dict[str, str] | None = None
) -> DataFrame:
    """One row per match: id, ``scope`` ("text" or "line"), ``line_no`` from 1 (null for a text), licence.

    ``more``: further full licence texts by licence.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(catalogue(more), "digest string, license_id string, form string")
    lines = docs.select(F.col(id_), F.inline_outer(F.array(F.struct(normal_lines(F.col(text)).alias("_lines")))))
    held = F.filter(
        F.transform("_lines", lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("form"))),
        lambda unit: unit["form"] != "",
    )
    whole = F.array_join(F.filter("_lines", lambda line: line != ""), " ")
    for spelling, one in _WIDE:
        whole = F.replace(whole, F.lit(spelling), F.lit(one))
    units = lines.select(
        F.col(id_),
        F.inline(F.concat(F.array(F.struct(F.lit(None).cast("int").alias("line_no"), whole.alias("form"))), held)),
    )
    hashed = units.filter("form <> ''").select(F.col(id_), "line_no", F.sha2(F.col("form").cast("binary"), 256).alias("digest"))
    return hashed.join(F.broadcast(known), "digest").select(
        F.col(id_), F.when(F.col("line_no").isNull(), "text").otherwise("line").alias("scope"), "line_no",
        "license_id", "form", "digest",
    )


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    column = f"regexp_replace(lower(text), '(?m){BEFORE_CLAUSE}', '\\1', 'g')"
    for dropped in (COPYRIGHT_LINE, RESERVED_LINE):
        column = f"regexp_replace({column}, '(?m){dropped}', '', 'g')"
    for spelling, one in SPELLINGS:
        column = f"replace({column}, '{spelling}', '{one}')"
    whole = "array_to_string(list_filter(l, lambda x: x <> ''), ' ')"
    for spelling, one in _WIDE:
        whole = f"replace({whole}, '{spelling}', '{one}')"
    known = ", ".join(f"('{d}', '{name}', '{form}')" for d, name, form in catalogue())
    return f"""WITH known(digest, license_id, form) AS (VALUES {known}),
lines AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
    list_transform(string_split(regexp_replace({column}, '{MARKS}', ' ', 'g'), chr(10)), lambda x: trim(x)) AS l
  FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, NULL::INT AS line_no, {whole} AS f FROM lines
  UNION ALL
  SELECT doc_id, line_no::INT, f FROM (
    SELECT doc_id, unnest(l) AS f, generate_subscripts(l, 1) AS line_no FROM lines))
SELECT doc_id, CASE WHEN line_no IS NULL THEN 'text' ELSE 'line' END AS scope, line_no, license_id, form, digest
FROM (SELECT *, sha256(f) AS digest FROM units WHERE f <> '') JOIN known USING (digest)"""


ORACLE = _oracle()
