"""Licence scans by canonical digests: whole texts, normalised, are hash-joined to known licences.

Normalising drops what does not change a licence: case, punctuation, white space, copyright lines and spelling
variants. A document is looked up as a whole, and each of its lines too, as many licences are granted by a line.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as equal (from, to), applied to lower-case text in this order.
SPELLINGS = (
    ("https:", "http:"), ("licence", "license"), ("licencing", "licensing"), ("organisation", "organization"), ("authorise", "authorize"),
    ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("honour", "honor"), ("whilst", "while"), ("per cent", "percent"),
    ("merchantability", "merchantibility"), ("noncommercial", "non commercial"), ("sublicense", "sub license"), ("v. ", "v "),
    ("copyright owner", "copyright holder"),
)

# Known licences and the notices by which they are granted, by SPDX identifier. Whole texts of the long ones
# (Apache-2.0, the GNU licences, MPL-2.0, the Creative Commons deeds) aren't here; ``license_scan`` takes a table of more.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
    "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We "
    "intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright "
    'law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>"
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be "
    "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
    "product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be "
    "misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
    "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright "
    "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
    "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
    "are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", "
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
    "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
    "a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
    "the License for the specific language governing permissions and limitations under the License."
)
_GPL_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {kind} Public License as published by the Free "
    "Software Foundation, either version {version} of the License, or (at your option) any later version.\n\nThis program is distributed in the hope "
    "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
    "{kind} Public License for more details.\n\nYou should have received a copy of the {kind} Public License along with this program. If not, see "
    "<https://www.gnu.org/licenses/>."
)
# Identifiers whose SPDX line is known.
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "Zlib", "Unlicense", "BSL-1.0", "MPL-2.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
KNOWN = (
    ("MIT", f"MIT License\n\nCopyright (c) <year> <holders>\n\n{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT", f"{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT-0", f"{_GRANT}.\n\n{_AS_IS}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_REST}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\nCopyright (c) <year>, <holders>\n\n{_BSD_GRANT}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_END}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n{_BSD_END}"),
    ("BSD-2-Clause", f"BSD 2-Clause License\n\n{_BSD_GRANT}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\nCopyright (c) <year>, <holders>\n\n{_BSD_GRANT}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n3. {_BSD_3}\n\n{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License\n\n{_BSD_GRANT}\n\n1. {_BSD_1}\n\n2. {_BSD_2}\n\n3. {_BSD_3}\n\n{_BSD_END}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_REST}"),
    ("0BSD", f"BSD Zero Clause License\n\n{_ISC_GRANT}.\n\n{_ISC_REST}"),
    ("MIT-0", f"MIT No Attribution\n\n{_GRANT}.\n\n{_AS_IS}"),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Zlib", f"zlib License\n\n{_ZLIB}"),
    ("BSL-1.0", f"Boost Software License - Version 1.0 - August 17th, 2003\n\n{_BOOST}"),
    ("BSL-1.0", _BOOST),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-2.0-or-later", _GPL_NOTICE.format(kind="GNU General", version=2)),
    ("GPL-3.0-or-later", _GPL_NOTICE.format(kind="GNU General", version=3)),
    ("AGPL-3.0-or-later", _GPL_NOTICE.format(kind="GNU Affero General", version=3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    *((name, f"SPDX-License-Identifier: {name}") for name in SPDX),
)

# A line that starts with a copyright mark and names a year or holder. Text about copyright holders isn't one, nor is a clause that
# is numbered (c): those letters need the word, a year or a placeholder beside them.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*\(c\)|(?:copyright[ \t]*)?©|\(c\)[ \t]*(?:copyright|<|\[|[0-9]{4})|copyright[ \t]*:?[ \t]*(?:by |<|\[|[0-9]{4}))[^\n]*$"
BETWEEN_WORDS = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The text in lower case, without copyright lines, with one space for what stands between words in a line."""
    text = F.lower(text)
    text = F.when(F.contains(text, F.lit("copyright")) | F.contains(text, F.lit("(c)")) | F.contains(text, F.lit("©")), F.regexp_replace(text, COPYRIGHT_LINE, "")).otherwise(text)
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(text, BETWEEN_WORDS, " ")


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def digest(words: Column) -> Column:
    return F.sha2(words, 256)


def known_digests(spark, more: DataFrame | None = None) -> DataFrame:
    """``digest, names`` of KNOWN and of a table of further texts (``license, text``): each digest once, with all its licences."""
    rows = spark.createDataFrame(list(KNOWN), "license string, text string")
    rows = rows if more is None else rows.unionByName(more.select("license", "text").where("text IS NOT NULL"))
    return rows.groupBy(digest(whole(canonical_lines(F.col("text")))).alias("digest")).agg(F.sort_array(F.collect_set("license")).alias("names"))


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: DataFrame | None = None) -> DataFrame:
    """``id_col, text_digest, license, n_notices long, notices`` for each row.

    ``license``: that of the whole text, or null. ``n_notices``: lines that are a known text by themselves;
    ``notices``: their licences, sorted, each once, joined by commas. A null text counts as empty and matches nothing.
    A text known under several names has them all, joined by commas. Rows that repeat id and text get the same result each; null ids stay; an empty table gives no rows.
    """
    known = known_digests(df.sparkSession, more)
    known = F.broadcast(known) if more is None else known  # the list above is bounded, a table needn't be
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), canonical_lines(text).alias("lines"))
    cut = lines.select("id", "th", F.posexplode(F.split("lines", "\n")).alias("n", "line")).select("id", "th", "n", F.trim("line").alias("line"))
    hits = cut.where("line <> ''").select("id", "th", "n", digest(F.col("line")).alias("digest")).join(known, "digest").distinct()
    notices = hits.groupBy("id", "th").agg(F.count("*").alias("n_notices"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("names")))), ",").alias("notices"))
    texts = lines.select("id", "th", digest(whole(F.col("lines"))).alias("digest")).join(known, "digest", "left")
    same = [F.col("t.th") == F.col("s.th"), F.col("t.id").eqNullSafe(F.col("s.id"))]
    both = texts.alias("t").join(notices.alias("s"), same, "left")
    return both.select(
        F.col("t.id").alias(id_col),
        F.col("t.digest").alias("text_digest"),
        F.array_join("t.names", ",").alias("license"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("notices", F.lit("")).alias("notices"),
    )


def oracle(table: str = "documents") -> str:
    """The same scan as DuckDB SQL."""

    def lines(text: str) -> str:
        x = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
        for old, new in SPELLINGS:
            x = f"replace({x}, '{old}', '{new}')"
        return f"regexp_replace({x}, '{BETWEEN_WORDS}', ' ', 'g')"

    def all_of(x: str) -> str:
        return f"sha256(trim(regexp_replace({x}, '[ \\n]+', ' ', 'g')))"

    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return f"""
WITH known AS (SELECT {all_of(lines('text'))} AS digest, string_agg(DISTINCT license, ',' ORDER BY license) AS license FROM (VALUES {values}) v(license, text) GROUP BY 1),
docs AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM {table}),
cut AS (SELECT doc_id, trim(unnest(string_split(lines, chr(10)))) AS line FROM docs),
hits AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM cut JOIN known ON sha256(line) = known.digest WHERE line <> '' GROUP BY doc_id)
SELECT docs.doc_id, {all_of('lines')} AS text_digest, known.license AS license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known ON {all_of('lines')} = known.digest LEFT JOIN hits ON hits.doc_id = docs.doc_id"""
