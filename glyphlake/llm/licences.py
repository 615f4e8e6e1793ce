"""Licence scan by canonical digests.

A whole text is brought to a canonical form: case, punctuation, white space,
copyright lines and equivalent spellings no longer matter. The digest of the form
is looked up among the digests of known licences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from importlib import resources
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal, as in the SPDX matching guidelines.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owner"),
    ("copyright owners", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("percent", "per cent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Texts of public licences and notices, by SPDX identifier.
KNOWN = (
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "0BSD",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "Zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ),
    (
        "Unlicense",
        """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
)

# Addresses that notices of the GNU licences have had.
ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301, USA.",
    "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA.",
    "675 Mass Ave, Cambridge, MA 02139, USA.",
)
_ADDRESS = re.compile(r"51 Franklin St(?:reet)?,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
#: Names of the GNU licences in their headers, their identifiers and versions.
GNU = (("GNU General Public License", "GPL", ("1", "2", "3")), ("GNU Library General Public License", "LGPL", ("2",)), ("GNU Lesser General Public License", "LGPL", ("2.1", "3")), ("GNU Affero General Public License", "AGPL", ("3",)))
SUBJECTS = ("program", "library", "software", "file")
MPL_HEADER = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at {}://mozilla.org/MPL/2.0/."
GFDL_HEADER = "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {} or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.{}"
_GFDL_END = ' A copy of the license is included in the section entitled "GNU Free Documentation License".'
#: Where a text ends and its advice on how to use it begins.
_APPENDIX = re.compile(r"(?m)^[ \t]*(?:How to Apply These Terms|How to use this License for your documents|ADDENDUM: How to use|APPENDIX: How to apply|Appendix: How to Apply|EXHIBIT A\b|Exhibit A - )")

MAX_KNOWN = 200_000
#: A text is looked up as a whole and, if a title stands above it, without it.
TITLES = "^(the )?(mit|isc|zlib|bsd|unlicense|(new|simplified|modified|revised) bsd|bsd [023] clause|0bsd|zero clause bsd)( zero clause)?( license)?( mit)? "


def canonical(text: Column) -> Column:
    """The form whose digest is looked up; null for null texts.

    Lower case; lines that begin with a copyright mark or word, and "all rights
    reserved", go; list marks go; all that is no letter or digit becomes one blank;
    spellings of the table become their equal.
    """
    x = F.lower(text)
    x = F.regexp_replace(x, "(?m)^[\\s/*#;%!-]*(?:©|\\(c\\)|copyright\\b(?=[^\\n]{0,40}(?:\\d{4}|©|\\(c\\)|<|\\[)))[^\\r\\n]*+$", " ")
    x = F.regexp_replace(x, "\\ball rights reserved\\b", " ")
    x = F.regexp_replace(x, "(?m)^\\s*(?:[*•-]|\\(?[a-z0-9]{1,2}[.)])\\s+", " ")
    x = F.regexp_replace(x, "&(?:amp;)?", " and ")
    x = F.concat(F.lit(" "), F.regexp_replace(x, "[^\\p{L}\\p{N}]+", " "), F.lit(" "))
    pairs = sorted(SPELLINGS, key=lambda p: -len(p[0]))
    one = "|".join(a for a, _ in pairs)
    equal = reduce(lambda y, p: F.regexp_replace(y, f" {p[0]}(?= )", f" {p[1]}"), pairs, x)
    # most texts hold none of the spellings: one scan instead of one for each
    return F.trim(F.regexp_replace(F.when(x.rlike(f" (?:{one}) "), equal).otherwise(x), " +", " "))


def headers() -> Iterator[tuple[str, str]]:
    """Standard headers of files, in the wordings that their licences advise."""
    ends = [f" if not, write to the Free Software Foundation, Inc., {a}" for a in ADDRESSES] + [f" if not, see <{scheme}://www.gnu.org/licenses/>." for scheme in ("http", "https")] + [None]
    for (name, short, versions), subject, end in product(GNU, SUBJECTS, ends):
        rest = f"This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
        if end is not None:
            rest += f"\n\nYou should have received a copy of the {name} along with this {subject};{end}"
        for version in versions:
            spdx = f"{short}-{version if '.' in version else version + '.0'}"
            says = f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
            for later in (f"either version {version} of the License, or (at your option) any later version", *(["either version 1, or (at your option) any later version"] if version == "1" else [])):
                yield f"{spdx}-or-later", f"{says}; {later}.\n\n{rest}"
            for only in (f"version {version} of the License", f"version {version}", f"version {version} only"):
                yield f"{spdx}-only", f"{says}; {only}.\n\n{rest}"
    for scheme in ("http", "https"):
        yield "MPL-2.0", MPL_HEADER.format(scheme)
    for version, end in product(("1.2", "1.3"), ("", _GFDL_END)):
        yield f"GFDL-{version}-or-later", GFDL_HEADER.format(version, end)


def full_texts() -> Iterator[tuple[str, str]]:
    """The texts of the folder: as they are, without title, without advice, in unbroken paragraphs, with other addresses."""
    for file in sorted(resources.files("glyphlake.llm").joinpath("licence_texts").iterdir(), key=lambda x: x.name):
        spdx, text = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8").strip()
        advice = _APPENDIX.search(text)
        for body in (text, text[: advice.start()].rstrip()) if advice else (text,):
            for one in (body, re.split(r"\n\s*\n", body, maxsplit=1)[1]):
                yield spdx, one
                yield spdx, re.sub(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)", " ", one)
                if _ADDRESS.search(one):
                    yield from ((spdx, _ADDRESS.sub(a.removesuffix("."), one)) for a in ADDRESSES)


def known_digests(spark: SparkSession) -> DataFrame:
    """``digest, license_id``: some hundreds of rows, whatever the input."""
    rows = spark.createDataFrame([*KNOWN, *headers(), *full_texts()], "license_id string, text string")
    return rows.select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license_id, digest, n_chars`` for each row of docs.

    ``license_id`` is that of the known licence whose canonical text the whole
    document has, else null. The lookup also tries the text without a licence
    title at its head. Null texts have a null digest and no licence; empty texts
    and those that are only copyright lines have the digest of the empty text,
    which no licence has. Rows with null ids and repeated rows are each answered;
    other columns are ignored. ``known`` (``digest, license_id``, one row a digest)
    replaces the built-in table. Up to ``MAX_KNOWN`` digests are broadcast, after
    they have been counted; more meet the documents in a shuffle.
    """
    if known is None or known.count() <= MAX_KNOWN:
        known = F.broadcast(known_digests(docs.sparkSession) if known is None else known)
    form = docs.select(F.col(doc_id).alias("doc_id"), F.length(F.col(text)).cast("long").alias("n_chars"), canonical(F.col(text)).alias("form"))
    hashed = form.select("doc_id", "n_chars", F.sha2("form", 256).alias("digest"), F.sha2(F.regexp_replace("form", TITLES, ""), 256).alias("untitled"))
    whole = known.select("digest", F.col("license_id").alias("whole_id"))
    body = known.select(F.col("digest").alias("untitled"), F.col("license_id").alias("body_id"))
    return hashed.join(whole, "digest", "left").join(body, "untitled", "left").select("doc_id", F.coalesce("whole_id", "body_id").alias("license_id"), "digest", "n_chars")
