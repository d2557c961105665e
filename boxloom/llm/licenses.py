"""License scans: canonical digests of entire texts, hash-joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_BSD_BINARY = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES '
    "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
    "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {it} is free software{then} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{that} "
    "either version {version} of the License, or (at your option) any later version. This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} "
    "along with this {it}{close}"
)
_WEB = ". If not, see <https://www.gnu.org/licenses/>."
_POST = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
#: Known licence texts and usual statements (fixed values of public licences).
KNOWN = (
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal '
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. " + _ISC_WARRANTY,
    ),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the '
        'License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is '
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing '
        "permissions and limitations under the License.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. " + _BSD_BINARY + _BSD_WARRANTY,
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. " + _BSD_BINARY + "3. Neither the name "
        "of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
        "permission. " + _BSD_WARRANTY,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        'future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to <https://unlicense.org>",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        'and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare '
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the "
        "Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, "
        "in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code "
        'generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE "
        "SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/.",
    ),
    *(
        (f"{short}-or-later", _GNU.format(it=it, then=then, that=that, name=f"GNU {kind}General Public License", version=version, close=close))
        for short, kind, version, it, then, that, close in (
            ("GPL-2.0", "", 2, "program", ";", ";", _POST),
            ("GPL-2.0", "", 2, "program", ":", ",", _WEB),
            ("GPL-3.0", "", 3, "program", ":", ",", _WEB),
            ("LGPL-2.1", "Lesser ", 2.1, "library", ";", ";", _POST),
            ("LGPL-2.1", "Lesser ", 2.1, "library", ";", ";", _WEB),
            ("LGPL-3.0", "Lesser ", 3, "program", ":", ",", _WEB),
            ("LGPL-3.0", "Lesser ", 3, "library", ":", ",", _WEB),
            ("AGPL-3.0", "Affero ", 3, "program", ":", ",", _WEB),
        )
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Digests of the canonical forms of long licences' full texts (fixed values; a test computes them from the files that Debian ships in /usr/share/common-licenses).
DIGESTS = (
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6"),
    ("GPL-2.0", "633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7"),
    ("GPL-3.0", "01bfee141afa6ba14551655b7834887593e299c066a6cd34132a745fe36d73cd"),
    ("LGPL-2.0", "1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614"),
    ("LGPL-2.1", "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
)
#: Beginnings of words that count as the same (fixed values), the last one over the border of a line too.
SPELLINGS = (("licenc", "licens"), ("sublicenc", "sublicens"), ("noninfring", "non infring"), ("organis", "organiz"), ("authoris", "authoriz"), ("favour", "favor"))
OWNER = ("copyright owner", "copyright holder")

#: What follows the word where it stands in the terms, not in a notice (fixed values).
TERMS = "notice notices holder holders owner owners law laws license licence interest interests act acts statement statements protection infringement and or in is".split()
_GAP, _END = r"[^\p{L}\p{N}\n]*", r"(?![\p{L}\p{N}])"
#: A line that begins with a notice: the word and no term after it, a sign and a year, the sign that says all, or the rights; portions may be named.
NOTICE = rf"(?:(?:portions )?copyright{_END}(?!{_GAP}(?:{'|'.join(TERMS)}){_END})|©|\(c\){_GAP}(?:copyright{_GAP})?[12]\d\d\d|all rights reserved{_END})"
#: Lines of notices at the start of a text or of a paragraph, after a line without letters and digits.
NOTICES = rf"(\n{_GAP})(?:\n{_GAP}{NOTICE}[^\n]*)+"
TITLE = r"\A\s*(the )?(mit|isc|bsd|zlib|bsd [23]-clause|[23]-clause bsd) licen[cs]e( \((mit|isc|bsd)\))?[ \t\r]*(?=\n|\z)"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lower case, line by line; without a title, notices at the start of paragraphs and punctuation; equal spellings; one space between words, one before each line.

    A line in the terms may begin with any word, wherever the text is wrapped: only a paragraph's first lines can be notices.
    """
    x = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), TITLE, "")
    x = F.regexp_replace(F.concat(F.lit("\n\n"), x), NOTICES, "$1")
    x = F.regexp_replace(F.replace(x, F.lit("\n"), F.lit(" \n ")), PUNCTUATION, " ")
    for other, same in SPELLINGS:
        x = F.replace(x, F.lit(f" {other}"), F.lit(f" {same}"))
    return x


def joined(lines: Column) -> Column:
    """Canonical lines as one text."""
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(lines, r"[ \n]+", " ")))
    return F.trim(F.replace(x, F.lit(f" {OWNER[0]}"), F.lit(f" {OWNER[1]}")))


def digest(text: Column) -> Column:
    return F.sha2(joined(canonical_lines(text)), 256)


def known_digests(spark: SparkSession, known: tuple = KNOWN, digests: tuple = DIGESTS) -> DataFrame:
    """(digest, license): a fixed table of len(known) + len(digests) rows at most, small enough to broadcast."""
    texts = spark.createDataFrame(list(known), "license string, body string").select(digest(F.col("body")).alias("digest"), "license")
    return texts.unionAll(spark.createDataFrame([(d, x) for x, d in digests], "digest string, license string")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, digest, license (null if the entire text is no known licence), line_licenses.

    line_licenses lists the licences that single lines or paragraphs (lines up to a blank one) are the entire text of. All
    go through one hash join to the fixed table of known digests, which is broadcast. Null and empty texts have the digest
    of the empty text and no licence; equal rows give equal results; an empty table gives none; other columns are not
    read, whatever their names. A text is held whole, with its lines. Texts are not shuffled: what is stated is gathered
    by doc_id and a digest of the text and joined to the rows' digests.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), canonical_lines(F.col("text")).alias("lines"))
    paragraphs = F.transform(F.split("lines", r"\n[ ]*(?=\n)"), joined)
    line = lambda x: F.trim(F.replace(x, F.lit(f" {OWNER[0]}"), F.lit(f" {OWNER[1]}")))
    parts = F.array_distinct(F.concat(F.transform(F.split("lines", "\n"), line), paragraphs))
    each = rows.select("doc_id", "key", F.explode(F.filter(parts, lambda x: x != "")).alias("part")).select("doc_id", "key", F.sha2("part", 256).alias("digest"))
    stated = each.join(F.broadcast(known), "digest").groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"))
    stated = stated.select(F.col("doc_id").alias("of"), "key", "line_licenses")
    whole = rows.select("doc_id", "key", F.sha2(joined(F.col("lines")), 256).alias("digest")).join(F.broadcast(known), "digest", "left")
    out = whole.join(stated, (whole["key"] == stated["key"]) & whole["doc_id"].eqNullSafe(stated["of"]), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("line_licenses", F.concat_ws(",", "line_licenses"))


def _sql(words: str) -> str:
    """The canonical form of a list of lower-case words in DuckDB's SQL."""
    word = "regexp_replace(w, '^(sub)?licenc', '\\1licens')"
    for other, same in SPELLINGS[2:]:
        word = f"regexp_replace({word}, '^{other}', '{same}')"
    return f"array_to_string(list_transform({words}, lambda w: {word}), ' ')"


#: Titles as word lists, and what a notice's second word is not, for the SQL alone.
_TITLES = [f"{the}{name} {licence}{short}" for the in ("", "the ") for name in ("mit", "isc", "bsd", "zlib", "bsd 2-clause", "bsd 3-clause", "2-clause bsd", "3-clause bsd") for licence in ("license", "licence") for short in ("", " (mit)", " (isc)", " (bsd)")]
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_SPLIT = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"
_PAIR = "regexp_replace({x}, '(^| )copyright owner', '\\1copyright holder', 'g')"
ORACLE = rf"""
with k as (select sha256({_PAIR.format(x=_sql(_SPLIT.format(x="body")))}) as digest, license from (values {", ".join("('%s', '%s')" % (a, b.replace("'", "''")) for a, b in KNOWN)}) as v(license, body)
           union all select * from (values {", ".join("('%s', '%s')" % (d, x) for x, d in DIGESTS)}) as v(digest, license)),
known as (select digest, min(license) as license from k group by digest),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
n as (select r, i, {_SPLIT.format(x="x")} as w, trim(lower(x), ' ' || chr(9) || chr(13)) as z, lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}©(]*', '')) as y
      from (select r, unnest(s) as x, generate_subscripts(s, 1) as i from (select r, string_split(text, chr(10)) as s from d))),
-- a title is all of the first line that isn't blank
f as (select r, min(i) filter (where z <> '') as top from n group by r),
t as (select n.r, i, case when i = top and z in {_IN(_TITLES)} then [] else w end as w, y from n left join f using (r)),
-- a notice by its first words; it counts while nothing but notices stands before it in its paragraph
c as (select *, len(w) > 0 as words, coalesce(case
        when w[1] = 'copyright' or (w[1] = 'portions' and w[2] = 'copyright' and y like 'portions copyright%') then coalesce(w[case when w[1] = 'copyright' then 2 else 3 end] not in {_IN(TERMS)}, true)
        when starts_with(y, '©') or contains(split_part(y, coalesce(w[1], chr(0)), 1), '©') then true
        when w[1] = 'c' and starts_with(regexp_replace(y, '^\(*', '('), '(c)') then regexp_matches(case when w[2] = 'copyright' then w[3] else w[2] end, '^[12][0-9]{{3}}')
        else w[1:3] = ['all', 'rights', 'reserved'] and y like 'all rights reserved%' end, false) as notice from t),
p as (select *, count(*) filter (where not words) over (partition by r order by i) as paragraph from c),
q as (select *, words and not (notice and sum(case when words and not notice then 1 else 0 end) over (partition by r, paragraph order by i) = 0) as stays from p),
l as (select r, i, case when stays then {_sql("w")} else '' end as x, stays from q),
g as (select *, count(*) filter (where x = '') over (partition by r order by i) as paragraph from l),
parts as (select r, {_PAIR.format(x="x")} as part from l union select r, {_PAIR.format(x="string_agg(x, ' ' order by i)")} from g where x <> '' group by r, paragraph),
s as (select r, string_agg(distinct license, ',' order by license) as line_licenses from parts join known on sha256(part) = digest where part <> '' group by r),
a as (select r, sha256({_PAIR.format(x="coalesce(string_agg(x, ' ' order by i) filter (where x <> ''), '')")}) as digest from l group by r)
select doc_id, a.digest, license, coalesce(line_licenses, '') as line_licenses
from d join a using (r) left join known on a.digest = known.digest left join s using (r)
"""
QUERIES, SQL = {"op4_license_digests": query}, {"op4_license_digests": ORACLE}
