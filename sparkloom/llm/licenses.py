"""License scans by conditional compression.

Word windows around mentions of licensing, wide enough for the longest template, are
candidate blocks.  A block is compressed with each template whose words it holds as a
zstandard raw dictionary, and the templates are ranked by how much smaller it gets
than without.  In that order each is confirmed by the exact differences of its
wording: the words of the template that the text lacks or adds, aligned in order, and
the words that name the license, none of which may differ.  Of wordings that overlap
the one whose matched words its template saves most bytes of counts.  Text around a
wording has no part in it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

#: Share of a template's words that a wording has to contain in order.
COVERAGE = 0.8
LEVEL = 9


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    #: Words that must all be matched: those that tell this license from its neighbours.
    names: tuple[str, ...]


_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_BODY = _MIT + (
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
)
_APACHE_BODY = _APACHE + (
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_GPL_END = (
    " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = (
    " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_UNLICENSE = "This is free and unencumbered software released into the public domain."
_UNLICENSE_END = (
    " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
    "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
)
TEMPLATES = (
    Template("Apache-2.0", _APACHE, ("apache", "2.0")),
    Template("Apache-2.0", _APACHE_BODY, ("apache", "2.0", "governing")),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    Template("MIT", _MIT, ("permission", "hereby", "granted", "sublicense")),
    Template("MIT", _MIT_BODY, ("permission", "hereby", "granted", "sublicense", "warranty")),
    Template("MIT", "Released under the MIT License.", ("mit",)),
    Template("BSD-2-Clause", _BSD, ("redistribution", "redistributions", "disclaimer")),
    Template("BSD-3-Clause", _BSD + _BSD_THIRD, ("neither", "endorse", "promote")),
    Template("BSD-2-Clause", _BSD + _BSD_END, ("redistribution", "redistributions", "disclaimer", "merchantability")),
    Template("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END, ("neither", "endorse", "promote", "merchantability")),
    Template("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", ("bsd", "3", "clause")),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "public", "3")),
    Template("GPL-3.0", _GPL.format(3), ("gnu", "general", "public", "3")),
    Template("GPL-3.0", _GPL.format(3) + _GPL_END, ("gnu", "general", "public", "3", "merchantability")),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "public", "2")),
    Template("GPL-2.0", _GPL.format(2), ("gnu", "general", "public", "2")),
    Template("GPL-2.0", _GPL.format(2) + _GPL_END, ("gnu", "general", "public", "2", "merchantability")),
    Template("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu", "lesser", "3")),
    Template("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu", "affero", "3")),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla", "2.0")),
    Template("ISC", _ISC, ("permission", "fee", "granted")),
    Template("ISC", _ISC + _ISC_END, ("permission", "fee", "granted", "disclaims")),
    Template("Unlicense", _UNLICENSE, ("unencumbered", "public", "domain")),
    Template("Unlicense", _UNLICENSE + _UNLICENSE_END, ("unencumbered", "public", "domain", "relinquishment")),
    Template("Zlib", _ZLIB, ("misrepresented", "altered", "freely")),
    Template("BSL-1.0", _BOOST, ("machine", "executable", "transmit", "derivative")),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc", "by", "nc", "4.0")),
    Template("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative", "commons", "noncommercial", "4.0")),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative", "commons", "attribution", "4.0")),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc", "by", "sa", "4.0")),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative", "commons", "sharealike", "4.0")),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal", ("cc0", "1.0")),
    Template("all-rights-reserved", "All rights reserved.", ("all", "rights", "reserved")),
)

#: Parts of words of the lower-case text, one of which every window contains; single words, so that a line break cannot split them.
MARKS = ("licens", "licenc", "reserved", "hereby", "redistribut", "unencumbered", "copyright", "misrepresented")
_WORD = re.compile(r"\d+(?:\.\d+)+|\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def words_of_lines(text: str) -> tuple[list[str], list[int]]:
    """Words of a text and the line of each; a wording may go over blank lines, as between clauses."""
    out, at = [], []
    for i, line in enumerate(text.split("\n")):
        w = words(line)
        out.extend(w)
        at.extend([i] * len(w))
    return out, at


def windows(block_words: list[str], reach: int) -> list[tuple[int, int]]:
    """Ranges of at most ``2 * reach`` words; every run of up to ``reach`` words that has a mark lies whole in one of them."""
    near: list[list[int]] = []
    for k, w in enumerate(block_words):
        if any(m in w for m in MARKS):
            lo, hi = max(0, k - reach + 1), min(len(block_words), k + reach)
            if near and lo <= near[-1][1]:
                near[-1][1] = hi
            else:
                near.append([lo, hi])
    return [(s, min(s + 2 * reach, hi)) for lo, hi in near for s in range(lo, max(hi - reach, lo + 1), reach)]


class Matcher:
    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.words = [words(t.text) for t in templates]
        self.counts = [Counter(w) for w in self.words]
        #: Words that a confirmed wording spans at most.
        self.reach = math.ceil((2 - COVERAGE) * max(map(len, self.words)))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False) for w in self.words]

    def saved(self, span_words: list[str], i: int) -> tuple[int, int]:
        """(bytes that the template saves of the words' plain compressed size, that size)."""
        raw = " ".join(span_words).encode("utf-8", "surrogatepass")
        plain = len(self.plain.compress(raw))
        return plain - len(self.given[i].compress(raw)), plain

    def ranked(self, block_words: list[str]) -> list[int]:
        """Templates that can be confirmed in the block, by the bytes they save of it, most first."""
        some = self.possible(block_words)
        return sorted(some, key=lambda i: (-self.saved(block_words, i)[0], i)) if len(some) > 1 else some

    def possible(self, block_words: list[str]) -> list[int]:
        """Templates whose names are all there, and enough of whose words; no other can be confirmed."""
        have = set(block_words)
        named = [i for i, t in enumerate(self.templates) if have.issuperset(t.names)]
        count = Counter(block_words) if named else {}
        return [i for i in named if sum(min(n, count[w]) for w, n in self.counts[i].items()) >= COVERAGE * len(self.words[i])]

    def align(self, block_words: list[str], i: int) -> tuple[int, int, tuple[int, int] | None]:
        """(first word, end, (template words missing, block words added)) of the stretch with most matched over added words; None for the last if its wording differs too much."""
        want = self.words[i]
        match = [m for m in SequenceMatcher(None, want, block_words, autojunk=False).get_matching_blocks() if m.size]
        score, start, most, keep = 0, 0, 0, []
        for k, m in enumerate(match):
            score -= m.b - match[k - 1].b - match[k - 1].size if k else 0
            if score <= 0:
                score, start = 0, k
            score += m.size
            if score > most:
                most, keep = score, match[start : k + 1]
        if not keep:
            return 0, len(block_words), None
        first, end = keep[0].b, keep[-1].b + keep[-1].size
        got = sum(m.size for m in keep)
        have = {w for m in keep for w in want[m.a : m.a + m.size]}
        added = end - first - got
        fits = got >= COVERAGE * len(want) and have.issuperset(self.templates[i].names) and added <= len(want) * (1 - COVERAGE)
        return first, end, (len(want) - got, added) if fits else None

    def confirm(self, block_words: list[str], i: int) -> tuple[int, int] | None:
        """(template words missing, block words added among the matched ones); None if the wording differs too much."""
        return self.align(block_words, i)[2]

    def hits(self, block_words: list[str]) -> list[tuple[int, int, str, float, int, int]]:
        """(first word, end, license, share saved, words missing, words added) of every confirmed wording that no better one overlaps, best first.

        Better is the one of whose matched words the template saves more bytes, then the
        one with fewer differences, then the one ranked first for its block.
        """
        every = {}
        for lo, hi in windows(block_words, self.reach):
            for rank, i in enumerate(self.ranked(block_words[lo:hi])):
                rest = [(lo, hi)]
                while rest:  # what lies before and behind a stretch is searched again
                    a, b = rest.pop()
                    if i not in self.possible(block_words[a:b]):
                        continue
                    first, end, d = self.align(block_words[a:b], i)
                    if d:
                        every.setdefault((a + first, a + end, i), (d, rank))
                    rest += [(a, a + first), (a + end, b)]
        rows = []
        for (first, end, i), (d, rank) in every.items():
            less, plain = self.saved(block_words[first:end], i)
            rows.append((-less, sum(d), rank, first, i, end, d, less / plain))
        out, taken = [], set()
        for _, _, _, first, i, end, d, share in sorted(rows):
            if taken.isdisjoint(range(first, end)):
                taken.update(range(first, end))
                out.append((first, end, self.templates[i].license, round(share, 4), *d))
        return out

    def best(self, block: str) -> tuple[str, float, int, int] | None:
        """(license, share saved, words missing, words added) of the best confirmed wording."""
        return next((h[2:] for h in self.hits(words(block))), None)

    def scan(self, text: str) -> list[tuple]:
        """(line, license, share saved, words missing, words added) of a text; the line is that of the first matched word."""
        found: dict[tuple[int, str], tuple] = {}
        text_words, lines = words_of_lines(text)
        for first, _, *hit in self.hits(text_words):
            found.setdefault((lines[first], hit[0]), (lines[first], *hit))
        return [found[k] for k in sorted(found)]


_matcher: list[Matcher] = []


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if not _matcher:
        _matcher.append(Matcher())
    for pdf in batches:
        out = [(i, *hit) for i, t in zip(pdf["doc_id"].array, pdf["text"]) for hit in _matcher[0].scan(t)]
        yield pd.DataFrame(out, columns=["doc_id", "line", "license", "saved", "missing_words", "added_words"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line, license, saved, missing_words, added_words)``, one row a line and license.

    ``line`` is that of the wording's first word, from 0.  Null and empty texts have none; texts
    of any length are read whole.  Null ids stay null; repeated rows are scanned each.
    Which of two wordings counts: see Matcher.hits.  Extra columns are not read.
    """
    low = F.lower("text")
    any_mark = F.lit(False)
    for m in MARKS:
        any_mark = any_mark | F.contains(low, F.lit(m))
    rows = docs.select(col(id_col).cast("string").alias("doc_id"), col(text_col).cast("string").alias("text"))
    hits = rows.where(F.col("text").isNotNull() & any_mark)
    out = hits.mapInPandas(_scan, "doc_id string, line int, license string, saved double, missing_words int, added_words int")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op8_license_scans": op8_license_scans}
ORACLE: dict[str, str] = {}
