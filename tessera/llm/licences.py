"""Licence scans by canonical digests, with DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, punctuation and
white space, equivalent spellings), hashed, and joined to the digests of known
licence texts and notices that went through the same form. The whole text of a
document is looked up, and so is each of its lines, since a notice is a line.
The dictionary is a fixed table of this module, so broadcasting it is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts and the spellings that licence guidelines treat as equal.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT_0 = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU_NOTICE = """This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.
This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
#: SPDX id, licence text or standard header, and the titles that files put above it.
TEXTS = (
    ("MIT", MIT, ("MIT License", "The MIT License", "The MIT License (MIT)")),
    ("MIT-0", MIT_0, ("MIT No Attribution",)),
    ("ISC", ISC, ("ISC License", "The ISC License")),
    ("0BSD", ZERO_BSD, ("BSD Zero Clause License", "Zero-Clause BSD")),
    ("BSD-2-Clause", BSD_CONDITIONS + BSD_DISCLAIMER, ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License")),
    ("BSD-3-Clause", BSD_CONDITIONS + BSD_THIRD + BSD_DISCLAIMER, ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("Zlib", ZLIB, ("zlib License", "The zlib/libpng License")),
    ("Unlicense", UNLICENSE, ("The Unlicense",)),
    ("Apache-2.0", APACHE_NOTICE, ()),
    ("MPL-2.0", MPL_NOTICE, ()),
    ("GPL-2.0", GNU_NOTICE.format(what="program", colon=";", name="General Public License", version="2"), ()),
    ("GPL-3.0", GNU_NOTICE.format(what="program", colon=":", name="General Public License", version="3"), ()),
    ("LGPL-3.0", GNU_NOTICE.format(what="library", colon=":", name="Lesser General Public License", version="3"), ()),
    ("AGPL-3.0", GNU_NOTICE.format(what="program", colon=":", name="Affero General Public License", version="3"), ()),
)
#: Names by which notices call a licence.
NAMES = (
    ("MIT", ("MIT License", "MIT")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPL-3.0")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "AGPL-3.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "BSD-3-Clause")),
    ("MPL-2.0", ("Mozilla Public License, Version 2.0", "MPL-2.0")),
    ("ISC", ("ISC License",)),
    ("CC0-1.0", ("CC0 1.0", "CC0")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-ND-4.0", ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License")),
)
FORMS = ("Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "This work is licensed under {}.", "This work is licensed under the {}.", "Distributed under the {}.", "SPDX-License-Identifier: {}")
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("cancelled", "canceled"), ("centre", "center"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("merchantibility", "merchantability"), ("organisation", "organization"),
    ("programme", "program"), ("recognised", "recognized"), ("whilst", "while"),
)
# End of fixed values.

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: With the marks of comments before it.
COPYRIGHT_LINE = r"(?m)^[ \t/*#;%<!-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
BREAKS = r"[\x00-\x09\x0B-/:-`{-\x7F‘’“”–—…©]+"


def known_texts() -> list[tuple[str, str]]:
    """(licence id, text) of the dictionary."""
    notices = [(code, form.format(name)) for code, names in NAMES for name in names for form in FORMS]
    whole = [(code, f"{title}\n{text}") for code, text, titles in TEXTS for title in ("", *titles)]
    return whole + [(code, title) for code, _, titles in TEXTS for title in titles] + notices


def canonical(text: Column) -> Column:
    """Canonical words, two spaces between words and a newline word where a line ends; '' for null."""
    s = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    s = F.regexp_replace(F.regexp_replace(s, COPYRIGHT_LINE, ""), BREAKS, " ")
    s = F.concat(F.lit(" "), F.replace(F.replace(s, F.lit("\n"), F.lit(" \n ")), F.lit(" "), F.lit("  ")), F.lit(" "))
    for one, other in SPELLINGS:
        s = F.replace(s, F.lit(f" {one} "), F.lit(f" {other} "))
    return s


def _digest(words: Column) -> Column:
    """Of the words without breaks; null where there are none."""
    flat = F.trim(F.regexp_replace(words, "[ \n]+", " "))
    return F.when(flat != "", F.sha2(flat, 256))


def known_digests(spark: SparkSession) -> DataFrame:
    """(digest, licence_id): one row for each digest of the dictionary."""
    known = spark.createDataFrame(known_texts(), "licence_id string, text string")
    return known.select(_digest(canonical(F.col("text"))).alias("digest"), "licence_id").groupBy("digest").agg(F.min("licence_id").alias("licence_id"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, licence_id, notice_ids, n_notices) for every row of ``docs``.

    ``digest`` is of the whole canonical text, ``licence_id`` what the
    dictionary knows it as; ``notice_ids`` are the licences of matching lines,
    distinct, sorted and comma-joined ('' for none), ``n_notices`` the number of
    such lines. A text without words has a null digest and matches nothing.
    Rows keep their number: repeated rows are each reported, null doc_ids too.
    Columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    known = F.broadcast(known_digests(docs.sparkSession))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical(F.col("text")).alias("words"))
    rows = words.select("doc_id", "words", _digest(F.col("words")).alias("digest"))
    whole = rows.join(known, "digest", "left").select("doc_id", "words", "digest", "licence_id")
    ids, begin = _line_ids(known.sparkSession)
    begun = F.filter(F.split("words", "\n"), lambda line: F.substring_index(F.ltrim(line), " ", 1).isin(begin))
    found = whole.withColumn("hits", F.filter(F.transform(begun, lambda line: ids[_digest(line)]), lambda x: x.isNotNull()))
    return found.select("doc_id", "digest", "licence_id", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notice_ids"), F.size("hits").cast("long").alias("n_notices"))


def _line_ids(spark: SparkSession) -> tuple[Column, list[str]]:
    """The dictionary as a literal map from digest to licence, and the words that its entries begin with: only a line
    that begins with one is digested and looked up, where it stands."""
    rows = known_digests(spark).orderBy("digest").collect()  # a fixed table of this module
    known = spark.createDataFrame(known_texts(), "licence_id string, text string")
    first = known.select(F.substring_index(F.trim(F.regexp_replace(canonical(F.col("text")), "[ \n]+", " ")), " ", 1).alias("w")).distinct()
    return F.create_map(*[F.lit(x) for r in rows for x in (r["digest"], r["licence_id"])]), sorted(r["w"] for r in first.collect())


def oracle_sql() -> str:
    """The same rows in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"
    form = f"regexp_replace(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{COPYRIGHT_LINE}', '', 'g'), '{BREAKS}', ' ', 'g')"
    form = f"' ' || replace(replace({form}, chr(10), ' ' || chr(10) || ' '), ' ', '  ') || ' '"
    for one, other in SPELLINGS:
        form = f"replace({form}, ' {one} ', ' {other} ')"
    flat = lambda s: f"trim(regexp_replace({s}, '[ \\n]+', ' ', 'g'))"
    digest = lambda s: f"CASE WHEN {flat(s)} <> '' THEN sha256({flat(s)}) END"
    values = ", ".join(f"({quoted(code)}, {quoted(text)})" for code, text in known_texts())
    return f"""
WITH known AS (SELECT {digest('words')} AS digest, min(licence_id) AS licence_id FROM (SELECT licence_id, {form} AS words FROM (VALUES {values}) v(licence_id, text)) GROUP BY 1),
rows_ AS (SELECT row_number() OVER () AS rid, doc_id, {form} AS words FROM documents),
lines AS (SELECT rid, unnest(string_split(words, chr(10))) AS line FROM rows_),
hits AS (SELECT rid, string_agg(DISTINCT licence_id, ',' ORDER BY licence_id) AS notice_ids, count(*) AS n_notices FROM (SELECT rid, {digest('line')} AS digest FROM lines) JOIN known USING (digest) GROUP BY rid)
SELECT doc_id, r.digest, k.licence_id, coalesce(notice_ids, '') AS notice_ids, coalesce(n_notices, 0) AS n_notices
FROM (SELECT rid, doc_id, {digest('words')} AS digest FROM rows_) r LEFT JOIN known k ON r.digest = k.digest LEFT JOIN hits USING (rid)"""
