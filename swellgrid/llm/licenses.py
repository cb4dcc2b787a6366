"""Licence scan by canonical digest lookup, in DataFrame functions only.

Texts are brought to a canonical form (case, punctuation, copyright lines, equivalent
spellings) and their digests looked up among those of known licences.  The texts compared are
each whole document, each of its paragraphs and lines, and each run of as many paragraphs as
a known licence has.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence texts and notices by identifier.
LICENSES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
]

_TEXTS = Path(__file__).parent / "license_texts"
#: Files of ``license_texts`` and the words their terms begin with and end before (to the end where empty).
#: What stands around the terms, titles and instructions for use, differs from copy to copy.
_TERMS = [
    ("Apache-2.0", "TERMS AND CONDITIONS FOR USE", "END OF TERMS AND CONDITIONS"), ("GPL-2.0", "Preamble", "END OF TERMS AND CONDITIONS"),
    ("GPL-3.0", "Preamble", "END OF TERMS AND CONDITIONS"), ("LGPL-2.1", "Preamble", "END OF TERMS AND CONDITIONS"), ("LGPL-3.0", "This version of", ""),
    ("MPL-2.0", "1. Definitions", "Exhibit A"), ("CC0-1.0", "Statement of Purpose", ""), ("BSD-2-Clause", "", ""), ("BSD-3-Clause", "", ""),
]


def full_texts() -> list[tuple[str, str]]:
    """(license, text): the terms of common licences; those of BSD with numbers or stars, and holder or owner."""
    out = []
    for name, begin, end in _TERMS:
        text = (_TEXTS / f"{name}.txt").read_text("utf-8")
        text = text[text.index(begin) :]
        text = text[: text.index(end)] if end else text
        texts = [text]
        if name.startswith("BSD"):
            texts = [x for t in texts for x in (t, t.replace("COPYRIGHT\nHOLDER OR", "COPYRIGHT OWNER OR"))]
            texts = [x for t in texts for x in (t, *(t.replace("1. ", f"{m} ").replace("2. ", f"{m} ").replace("3. ", f"{m} ") for m in "*"))]
        out += [(name, t) for t in texts]
    # The notice with its address in a paragraph of its own, as most files have it.
    return out + [(k, t.replace(" http", "\n\nhttp")) for k, t in LICENSES if k == "Apache-2.0" and " http" in t]


#: Spellings that count as equal (after lower case).
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"),
    ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("http://", "https://"), ("&", " and "),
]

#: A line that is a copyright statement, with its line break: the word and a mark, year or holder, or a mark and a year.
#: A wrapped line of a licence such as "copyright notice and this permission notice" and a clause "(c) you must" stay.
_COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright\b(?![^\p{L}\p{N}\n(©]*(?:$|(?:notices?|holders?|owners?|laws?|license|statements?|interests?|and|or|in|on|to|is|if|as|by law)\b))"
    r"|\(c\)(?=[^\p{L}\p{N}\n]*(?:[0-9]{4}|copyright\b))|©)[^\n]*\n?"
)
_PUNCTUATION = r"[^\p{L}\p{N}\n]+"


def canonical(text: Column) -> Column:
    """Lower case, equivalent spellings, no copyright lines, other signs as one space; line breaks stay."""
    text = F.lower(text)
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    mark = F.contains(text, F.lit("copyright")) | F.contains(text, F.lit("(c)")) | F.contains(text, F.lit("©"))
    text = F.when(mark, F.regexp_replace(text, _COPYRIGHT_LINE, "")).otherwise(text)
    return F.regexp_replace(text, _PUNCTUATION, " ")


def flat_digest(canonical_text: Column) -> Column:
    """Digest of a canonical text whatever its line breaks."""
    return F.md5(F.trim(F.regexp_replace(canonical_text, r"[\x20\n]+", " ")).cast("binary"))


def paragraphs(canonical_text: Column) -> Column:
    """What stands between empty lines and is not blank."""
    return F.filter(F.split(canonical_text, r"\n\x20*\n"), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" "))) != "")


def known_texts(spark: SparkSession) -> tuple[dict[str, str], dict[str, list[int]]]:
    """License of each digest, and the numbers of paragraphs of the known texts by the digest of their first one."""
    known = spark.createDataFrame(LICENSES + full_texts(), "license string, text string").select("license", canonical(F.col("text")).alias("t"))
    rows = known.select("license", flat_digest(F.col("t")).alias("digest"), paragraphs(F.col("t")).alias("p"))
    names: dict[str, str] = {}
    runs: dict[str, set[int]] = {}
    for r in rows.select("license", "digest", flat_digest(F.get("p", F.lit(0))).alias("first"), F.size("p").alias("n")).collect():
        names[r["digest"]] = min(r["license"], names.get(r["digest"], r["license"]))
        runs.setdefault(r["first"], set()).add(r["n"])
    return names, {first: sorted(n) for first, n in runs.items()}


def _literal_map(values: dict[str, object]) -> Column:
    def lit(v: object) -> Column:
        return F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)

    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), lit(v))])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_matches`` (long), ``licenses`` (distinct, sorted, comma-joined, or '').

    A document matches once for each different canonical text that is a known licence's among its units: itself, its
    paragraphs (between empty lines), its lines and its runs of paragraphs; one that stands twice, or is a unit in two ways, counts once.  Null and empty texts match nothing; rows that repeat
    an id or have a null one each give a row; an empty table gives no rows; other columns
    are left out.  Each row is settled where it stands: nothing is joined or shuffled.
    """
    names, runs = known_texts(docs.sparkSession)
    names_of, lengths_of = _literal_map(names), _literal_map(runs)
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    # Generators keep the optimiser from copying the pattern searches into the lambdas below.
    rows = rows.select("id", "t", F.inline(F.array(F.struct(paragraphs(F.col("t")).alias("p")))))
    rows = rows.select("id", "t", "p", F.inline(F.array(F.struct(F.transform("p", flat_digest).alias("d")))))

    def beginning(digest: Column, i: Column) -> Column:
        cut = F.transform(F.try_element_at(lengths_of, digest), lambda n: flat_digest(F.array_join(F.slice("p", i + 1, n), "\n")))
        return F.coalesce(cut, F.array().cast("array<string>"))

    longer = F.flatten(F.transform("d", beginning))
    lines = F.transform(F.split("t", r"\n"), flat_digest)
    units = F.array_distinct(F.concat(F.array(flat_digest(F.col("t"))), "d", lines, longer))
    found = F.filter(F.transform(units, lambda d: F.try_element_at(names_of, d)), lambda x: x.isNotNull())
    rows = rows.select("id", F.inline(F.array(F.struct(found.alias("found")))))
    return rows.select(
        F.col("id").alias(id_col), F.size("found").cast("bigint").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("licenses")
    )
