"""Licence scan by canonical digests, with DataFrame functions only.

A unit is a whole text, one of its paragraphs, a block of two to five neighbouring paragraphs (not all), or one of its lines.
It is brought to a canonical form (lower case, copyright lines dropped, equivalent spellings unified, everything but letters
and digits made one space), hashed whole, and the digests are joined to those of known licence texts. How a text is wrapped
or indented makes no difference. Nothing is searched inside a unit: a licence is found where an entire unit is one.

A null or empty text has no unit with a licence. A unit that is found several times in a text counts each time; a text that
is one single line is a "text" and not a "line" as well. Blocks that differ by a copyright paragraph each count. Repeated
rows of the input, and rows with a null id, each give their own rows in license_hits; license_report counts by id. Very long
texts are read once for each kind of unit. Columns other than id and text are not read, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (canonical spelling, its variants), applied in this order to lower-cased text.
SPELLINGS = (
    ("license", r"licence"),
    ("sublicense", r"sub-license"),
    ("version ", r"\bv\. ?"),
    ("and", r"&"),
    ("noncommercial", r"non-commercial"),
)
#: Fixed value: a line that only claims copyright.
COPYRIGHT_LINE = r"^[ \t]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|by\b)|\(c\)[ \t]|©|all rights reserved\.?[ \t]*$)"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
ZERO_BSD = ISC.replace("granted, provided that the above copyright notice and this permission notice appear in all copies.", "granted.")
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version {n} of the License, or (at your option) any
later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Known licence texts and notices: (SPDX id, text). Callers may give their own.
KNOWN = (
    ("MIT", MIT), ("MIT", "MIT License " + MIT), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC), ("ISC", "ISC License " + ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", APACHE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-3-Clause", BSD_HEAD + BSD_NAMES + BSD_TAIL), ("0BSD", ZERO_BSD), ("Zlib", ZLIB), ("BSL-1.0", BOOST), ("Unlicense", UNLICENSE),
    ("GPL-2.0", GPL_NOTICE.format(n=2)), ("GPL-3.0", GPL_NOTICE.format(n=3)), ("MPL-2.0", MPL_NOTICE),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
)


#: Fixed value: what parts paragraphs.
PARAGRAPH = "\n[ \t]*\n"


def block_sizes(known) -> range:
    """How many neighbouring paragraphs may hold a known text: as many as the longest of them has lines."""
    return range(2, 1 + max([2, *(t.count("\n") + 1 for _, t in known)]))


#: Words of which every known text has one; a caller's own texts may have none of them, then nothing is left out.
TELLING = "licen[sc]e|permission|redistribut|unencumbered"


def canonical(text: Column) -> Column:
    """The canonical form of a unit; empty if nothing but copyright lines, punctuation or blanks is in it."""
    x = F.lower(text)
    x = F.array_join(F.filter(F.split(x, "\n"), lambda line: ~line.rlike(COPYRIGHT_LINE)), "\n")
    for plain, variant in SPELLINGS:
        x = F.regexp_replace(x, variant, plain)
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def n_words(text: Column) -> Column:
    """Words of the canonical form."""
    x = canonical(text)
    return F.when(x == "", 0).otherwise(F.size(F.split(x, " ")))


def units(text: Column, sizes: range, lengths: list[int]) -> Column:
    """array<struct<unit, body>>: the text; its paragraphs if there are several; blocks of `sizes` neighbouring ones that have as many
    words as a known text (lengths); its lines likewise."""
    none = F.array().cast("array<struct<unit:string,body:string>>")

    def as_units(kind: str, parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(F.lit(kind).alias("unit"), p.alias("body")))

    def several(kind: str, parts: Column) -> Column:
        return F.when(F.size(parts) > 1, as_units(kind, parts)).otherwise(none)

    paragraphs = F.split(text, PARAGRAPH)

    def found(counts: Column) -> Column:
        """(first paragraph, how many) of the blocks. Sums are of a few whole numbers; a body is built where one fits."""
        known = F.array(*map(F.lit, lengths)).cast("array<int>")
        fits = lambda k, n: F.array_contains(known, F.aggregate(F.slice(counts, k, n), F.lit(0), lambda a, x: a + x))
        of = lambda n: F.when(F.size(counts) > n, F.transform(F.filter(F.sequence(F.lit(1), F.size(counts) - n + 1), lambda k: fits(k, n)), lambda k: F.struct(k.alias("k"), F.lit(n).alias("n"))))
        return F.concat(*[F.coalesce(of(n), F.array().cast("array<struct<k:int,n:int>>")) for n in sizes])

    # counted once: a filter over a single-element array binds the counts for all sizes
    blocks = F.flatten(F.transform(F.array(F.transform(paragraphs, n_words)), found))
    bodies = F.transform(blocks, lambda b: F.array_join(F.slice(paragraphs, b["k"], b["n"]), "\n\n"))
    return F.concat(F.array(F.struct(F.lit("text").alias("unit"), text.alias("body"))), several("paragraph", paragraphs), F.when(F.size(paragraphs) > 2, as_units("block", bodies)).otherwise(none), several("line", F.split(text, "\n")))


def known_digests(spark, known=KNOWN) -> DataFrame:
    """(license_id, digest) of the given texts."""
    rows = spark.createDataFrame(list(known), "license_id string, body string")
    return rows.select("license_id", F.md5(canonical(F.col("body"))).alias("digest")).distinct()


def license_hits(df: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, unit, license_id, digest), a row for each unit that is a known licence.

    The digests of the known texts are a few dozen rows given by the caller, whatever the corpus; that is why they are
    broadcast. Texts and units without any of the words of which every known text has one are not hashed: they can't be equal
    to one."""
    spark = df.sparkSession
    word = _common_word([t for _, t in known])
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("body_text"))
    if word:
        named = named.where(F.lower("body_text").rlike(word))
    given = spark.createDataFrame(list(known), "license_id string, body string")
    lengths = sorted({r.n for r in given.select(n_words(F.col("body")).alias("n")).collect()})  # one number for each known text
    found = named.select("id", F.inline(units(F.col("body_text"), block_sizes(known), lengths)))
    if word:
        found = found.where(F.lower("body").rlike(word))
    found = found.select("id", "unit", F.md5(canonical(F.col("body"))).alias("digest"))
    hits = found.join(F.broadcast(known_digests(spark, known)), "digest")
    return hits.select(F.col("id").alias(id_col), "unit", "license_id", "digest")


def _common_word(texts: list[str]) -> str:
    """A pattern that every one of these texts matches, or ''."""
    import re

    return TELLING if all(re.search(TELLING, t.lower()) for t in texts) else ""


def license_report(df: DataFrame, known=KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license_id, unit, n_units, digests): how often each licence is an entire unit of each document."""
    return license_hits(df, known, id_col, text_col).groupBy(id_col, "license_id", "unit").agg(
        F.count("*").alias("n_units"), F.concat_ws(",", F.sort_array(F.collect_set("digest"))).alias("digests")
    )


def report_sql(known=KNOWN, table: str = "documents") -> str:
    """The same for DuckDB."""
    def canon_text(x: str) -> str:
        x = f"array_to_string(list_filter(string_split(lower({x}), chr(10)), lambda l: NOT regexp_matches(l, '{COPYRIGHT_LINE}')), chr(10))"
        for plain, variant in SPELLINGS:
            x = f"regexp_replace({x}, '{variant}', '{plain}', 'g')"
        return f"trim(regexp_replace({x}, '[^a-z0-9]+', ' ', 'g'))"

    def canon(x: str) -> str:
        return f"md5({canon_text(x)})"

    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in known)
    several = "CASE WHEN len({p}) > 1 THEN list_transform({p}, lambda b: {{'unit': '{k}', 'body': b}}) ELSE [] END"
    paragraphs = "regexp_split_to_array(text, '\\n[ \\t]*\\n')"
    words = f"len(list_filter(string_split({canon_text('b')}, ' '), lambda w: w <> ''))"
    block = "CASE WHEN len(p) > {n} THEN list_transform(list_filter(range(1, len(p) - {n} + 2), lambda i: list_contains(l, list_sum(c[i:i + {n} - 1]))), lambda i: {{'unit': 'block', 'body': array_to_string(p[i:i + {n} - 1], chr(10) || chr(10))}}) ELSE [] END"
    parts = [several.format(p="p", k="paragraph"), *[block.format(n=n) for n in block_sizes(known)], several.format(p="string_split(text, chr(10))", k="line")]
    return f"""WITH known AS (SELECT DISTINCT license_id, {canon('body')} AS digest FROM (VALUES {rows}) k(license_id, body)),
kl AS (SELECT list(DISTINCT {words}) AS l FROM (VALUES {rows}) k(license_id, b)),
tp AS (SELECT doc_id, text, {paragraphs} AS p FROM {table} WHERE text IS NOT NULL), tc AS (SELECT *, list_transform(p, lambda b: {words}) AS c FROM tp, kl),
u AS (SELECT doc_id, unnest(list_concat([{{'unit': 'text', 'body': text}}], {', '.join(parts)})) AS x FROM tc),
h AS (SELECT doc_id, x.unit AS unit, {canon('x.body')} AS digest FROM u)
SELECT doc_id, license_id, unit, count(*) AS n_units, string_agg(DISTINCT digest, ',' ORDER BY digest) AS digests
FROM h JOIN known USING (digest) GROUP BY doc_id, license_id, unit"""
