"""License scan by canonical digests: entire texts are normalised, hashed and hash-joined to known ones.

Normalising drops copyright lines, turns case and punctuation into plain words and folds equivalent spellings, and so
makes one digest of all printings of a licence, however its lines are wrapped. Every whole text is looked up, and every
line of it as a text of its own, for one-line notices. The table of known digests has the size of KNOWN and `more`.

A copyright line begins with the word or sign and has a year or a sign, or is the word and a name of up to six words;
"copyright notice", "copyright holders" and the like begin no such line.

Cases: a null or empty text, or one of copyright lines only, has the digest of nothing and no licence; repeated rows give
repeated results; ties don't arise, as a digest has one name, the first in the alphabet; an empty table gives no rows;
very long texts are read whole; a line is looked up without its list or comment marks; other columns are left out,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of equivalent spellings in plain words, applied in order.
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
    ("https", "http"),
]
#: Line starts that aren't copyright lines: the space is taken out of the way first.
NOT_COPYRIGHT = r"^([^a-z0-9\n]*copyright) (notice|holder|owner|and|law|license|licence|in|of|or|is|statement|information|protect)"
COPYRIGHT = r"^[^a-z0-9\n]*(copyright[ ,:;(©-][^\n]*([0-9][0-9][0-9][0-9]|\(c\)|©)[^\n]*|copyright( by)? [^ _\n]+( [^ _\n]+){0,5} *|(\(c\)|©) [^\n]*|all rights reserved[^\n]*)$"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE_FIRST = "This is free and unencumbered software released into the public domain."
_UNLICENSE = _UNLICENSE_FIRST + """
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_MPL_NOTICE = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
#: Known licence texts, notices of the long licences, and one-line notices.
KNOWN = [
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL-3.0-or-later", _GPL_NOTICE),
    ("LGPL-3.0-or-later", _GPL_NOTICE.replace("GNU General", "GNU Lesser General")),
    ("MPL-2.0", _MPL_NOTICE),
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _USE + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_TAIL),
    ("0BSD", _USE + ".\n" + _ISC_TAIL),
    ("BSD-2-Clause", "\n".join([_BSD, _BSD_1, _BSD_2, _BSD_TAIL])),
    ("BSD-3-Clause", "\n".join([_BSD, _BSD_1, _BSD_2, _BSD_3, _BSD_TAIL])),
    ("Zlib", _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
]


def plain_lines(text):
    """A text without copyright lines, in plain words; its lines are kept."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\r", " ")
    out = F.regexp_replace(out, "(?dm)" + NOT_COPYRIGHT, "$1_$2")
    out = F.regexp_replace(out, "(?dm)" + COPYRIGHT, " ")
    return F.regexp_replace(out, "[^a-z0-9\n]+", " ")


def folded(words):
    """Plain words with one spelling for each."""
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(a), F.lit(b))
    return F.trim(words)


def canonical(text):
    """The normal form of a text, as a column."""
    return folded(F.regexp_replace(plain_lines(text), "[ \n]+", " "))


def digest(text):
    return F.sha2(canonical(text), 256)


def known(spark, more: list[tuple[str, str]] = ()) -> DataFrame:
    """(digest, license): a fixed few rows; one name per digest."""
    rows = spark.createDataFrame([*KNOWN, *more], "license string, text string")
    return rows.select(digest(F.col("text")).alias("digest"), "license").groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[tuple[str, str]] = ()) -> DataFrame:
    """(id, digest, license, notices): the licence that the whole text is, and those that lines of it are, comma-joined."""
    table = F.broadcast(known(docs.sparkSession, more))
    rows = docs.select(F.col(id_col).alias("_id"), plain_lines(F.col(text_col)).alias("_lines"))
    rows = rows.select("_id", "_lines", F.sha2(folded(F.regexp_replace("_lines", "[ \n]+", " ")), 256).alias("digest"))
    rows = rows.join(table.withColumnRenamed("license", "_license"), "digest", "left")
    # the few known digests are a map, in which every line is looked up
    lookup = F.map_from_arrays(*(F.lit([x for x in col]) for col in _columns(docs.sparkSession, more)))
    names = F.transform(F.split("_lines", "\n"), lambda x: lookup[F.sha2(folded(x), 256)])
    names = F.array_sort(F.array_distinct(F.filter(names, lambda x: x.isNotNull())))
    return rows.select(F.col("_id").alias(id_col), "digest", F.col("_license").alias("license"), F.array_join(names, ",").alias("notices"))


def _columns(spark, more):
    rows = known(spark, more).orderBy("digest").collect()
    return [r.digest for r in rows], [r.license for r in rows]


def oracle() -> str:
    """The same scan in SQL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def lines(x: str) -> str:
        x = f"replace(lower(coalesce({x}, '')), chr(13), ' ')"
        x = f"regexp_replace({x}, {q('(?m)' + NOT_COPYRIGHT)}, '\\1_\\2', 'g')"
        x = f"regexp_replace({x}, {q('(?m)' + COPYRIGHT)}, ' ', 'g')"
        return f"regexp_replace({x}, '[^a-z0-9\\n]+', ' ', 'g')"

    def digest_of(x: str) -> str:
        for a, b in SPELLINGS:
            x = f"replace({x}, {q(a)}, {q(b)})"
        return f"sha256(trim({x}))"

    whole = lambda x: digest_of(f"regexp_replace({lines(x)}, '[ \\n]+', ' ', 'g')")
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in KNOWN)
    return f"""
with k as (
  select {whole('text')} as digest, min(license) as license from (values {values}) as t(license, text) group by 1
), d as (
  select row_number() over () as r, doc_id, {lines('text')} as text, {whole('text')} as digest from documents
), n as (
  select r, string_agg(distinct k.license, ',' order by k.license) as notices
  from d, unnest(string_split(text, chr(10))) as t(line) join k on k.digest = {digest_of('line')} group by r
)
select doc_id, d.digest, license, coalesce(notices, '') as notices from d left join k using (digest) left join n using (r)
"""
