"""License scans by canonical digest.

A text is made canonical: lower case, copyright lines gone, equivalent spellings made one, all but letters and digits to
single spaces.  Its SHA-256 digest is hash-joined to those of the known licences.  Lines that may be a one-line notice are
looked up in the same way.

DataFrame functions only: the texts are scanned once, digests are made where they are read, and the known digests, a table
of fixed size, are broadcast.  Only lines with a word that every known notice holds are exploded.

Edge cases: a null or empty text, or one of copyright lines alone, has a null digest and no licence; repeated rows get equal
results; a text of any length is read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.licence_texts import APACHE_2_0

# Spellings and words that count as equal, as the public licence-matching guidelines have them.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("authorised", "authorized"), ("authorisation", "authorization"), ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"), ("favour", "favor"), ("honour", "honor"), ("labour", "labor"), ("modelled", "modeled"),
    ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"),
    ("https", "http"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("judgement", "judgment"),
)
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"

# Public licence texts and their usual one-line notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
LICENCES = {
    "MIT": (_MIT, "MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT, "The MIT License\n" + _MIT), "MIT-0": (_MIT.split("\n")[0].replace(", subject to the following conditions:", ".") + "\n" + _MIT.split("\n")[2],),
    "ISC": (_ISC, "ISC License\n" + _ISC), "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL, "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), "Zlib": (_ZLIB, "zlib License\n" + _ZLIB), "Apache-2.0": (_APACHE,),
}


def _layouts(text: str) -> tuple[str, ...]:
    """The text as it is and with one line a paragraph: canonical() takes out whole lines, so line breaks count."""
    return text, "\n".join(" ".join(x.split()) for x in text.split("\n\n"))


#: Entire texts of long licences, with and without their appendix; the SQL beside op8 has LICENCES only.
LONG_LICENCES = {"Apache-2.0": (*_layouts(APACHE_2_0), *_layouts(APACHE_2_0[: APACHE_2_0.index("   APPENDIX:")]))}
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",), "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.",),
}
# Canonical digests of further public licences' entire texts, as their publishers have them; for the GPL family also
# those that end with, and before, the line END OF TERMS AND CONDITIONS.
DIGESTS = {
    "GPL-1.0": ("9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    "GPL-2.0": ("b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", "a1e7ba14d8d85807f384435b77f91e925decc43da128311c991c4f2337e44017"),
    "GPL-3.0": ("59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975", "f37d587507fc579524cb06d1130d5899891a978ee008cfc033b3b4d95da28bee"),
    "LGPL-2.0": ("b4114daa3dfa52e27e78b2c4e17acd58bf4381e812762f4ded0bcb8eabd1092c", "ff773d8d898dfc51ae2dbf3baa20700673e8ceb153b13d26c525af34a59adf0c", "e0de5033b5ad2a24c0a1a8b04f09e33038ffa62d2bef7178de2a3c6f5d56f499"),
    "LGPL-2.1": ("294fb9ec58649c7eb0cf90fc2900ac1b28b82fb6da9d40d7599d6b7d399d4d2e", "963f79d48038eed98d8341c84d8d3b765e99508a738d00654c0112f70a7c370c", "9bf9c99aeafbdbccd7456a00d574699e3deb41868375496cacbf170be719bebd"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("f77c59051c0127d677dcce7ba0d4733294974749a7b4155250912498d92767d6",),
    "MPL-2.0": ("95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("37db86be8f16e9b8dfb0d63e1698ad2e07d54f312494c1cb2dbdb4fa37487f0f",),
    "GFDL-1.3": ("7befa86e5ee53162018d597eee81db6c727f3e64fab4641af93e19deab1807b4",),
    "Artistic-1.0-Perl": ("93aa47d57763801ed6e6a6591d4d4049a2c46794df90838023ceade56b569da0",),
}
#: Every notice holds one of these in lower case.
NOTICE_WORDS = r"licen[cs]|released under"


def canonical_text(text: str) -> str:
    """What `canonical` makes, in plain Python; for the known texts."""
    text = re.sub(r"(^|\n)[^\w\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*", r"\1", text.lower())
    text = " " + re.sub(r"[\W_]+", " ", text).strip() + " "
    for a, b in SPELLINGS:
        text = text.replace(f" {a} ", f" {b} ")
    return text.strip()


def canonical(text: Column) -> Column:
    x = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "$1")
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, OTHER, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        x = F.replace(x, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(x)


def known(spark: SparkSession, texts: dict[str, tuple[str, ...]], digests: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(known, name): digests of known texts; of fixed size."""
    rows = {d: name for name, own in (digests or {}).items() for d in own}
    rows |= {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, variants in sorted(texts.items()) for t in variants}
    return spark.createDataFrame(sorted(rows.items()), "known string, name string")


def scan(docs: DataFrame, licences: dict[str, tuple[str, ...]] | None = None, notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, digest, licence (of the entire text), n_notices (lines) and notices (their distinct names, sorted) of every row."""
    spark = docs.sparkSession
    both = {**(notices or NOTICES)}
    for part in (licences,) if licences else (LICENCES, LONG_LICENCES):
        for name, variants in part.items():
            both[name] = (*both.get(name, ()), *variants)
    text = F.col("text").cast("string")
    whole = canonical(text)
    digest = F.when(whole != "", F.sha2(whole.cast("binary"), 256))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(F.lower(x), F.lit(NOTICE_WORDS)))
    lines = F.transform(F.coalesce(lines, F.array().cast("array<string>")), lambda x: F.sha2(canonical(x).cast("binary"), 256))
    # A row's notices are looked up in a literal map of the fixed table, without a shuffle of rows.
    table = F.create_map(*(F.lit(x) for r in known(spark, notices or NOTICES).collect() for x in (r.known, r.name)))  # fixed size
    found = F.filter(F.transform(lines, lambda d: F.try_element_at(table, d)), lambda x: x.isNotNull())
    rows = docs.select("doc_id", digest.alias("digest"), found.alias("found"))
    out = rows.join(F.broadcast(known(spark, both, None if licences else DIGESTS)), F.col("digest") == F.col("known"), "left")
    return out.select("doc_id", "digest", F.col("name").alias("licence"), F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))
