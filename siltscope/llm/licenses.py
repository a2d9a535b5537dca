"""Operator 1: license scan by conditional compression.

Candidate blocks are windows around words that license notices can't do without; they reach as far before and after such a word as
the longest template does, and half as far again. Each block is compressed as it is and then with each template as a raw zstandard
dictionary, and so is each of its lines or sentences with such a word. How much a dictionary shortens them at best ranks the templates: wording that the block shares with it is then a reference instead
of text. In that order, those that shorten the block at all are confirmed by their exact differences: both wordings are reduced to plain
words, the template's are aligned with the block's, and no more than a tenth of the template's words may be missing (of a short
notice, only filler words), the words that tell a license from its relatives must be there and no others of that kind, and no
negation may have come in or stand before. The place where a template is confirmed is its own: what ranks lower may not claim it. So
a text with all the clauses of BSD-3-Clause is not BSD-2-Clause as well, and the rank decides between relatives.

Defined cases: null and empty texts have no finds and give no row; equal texts give equal rows; a text may hold several licenses,
each reported once, with the number of blocks; ties in rank go to the longer template, then to the earlier in the list; doc_id may
be null; an empty table gives no rows; other columns are ignored, whatever their names; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltscope.llm.common import documents, id_and_text
from siltscope.llm.tokens import Memo
from siltscope.session import ship

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_GNU = """{what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{mark2} {version}"""
_GNU_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""
_GNU_HEAD = """GNU {kind}GENERAL PUBLIC LICENSE Version {version}"""
_CC = """This work is licensed under a Creative Commons {name} {version} International License."""


def _gnu(name: str, kind: str, version: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """The notices of one license of the GNU family: or any later version, this version only, the head of its text, and a grant by name."""
    tell = ("gnu", version, *([kind.strip().lower()] if kind else ["general"]))
    later, only = (_GNU.format(what="This program", mark=":", mark2=",", kind=kind, version=v) for v in (f"either version {version} of the License, or (at your option) any later version.", f"version {version} of the License."))
    return [
        (f"{name}-or-later", f"{later} {_GNU_END.format(kind=kind)}", (*tell, "later")), (f"{name}-or-later", later, (*tell, "later")),
        (name, f"{only} {_GNU_END.format(kind=kind)}", tell), (name, only, tell),
        (name, f"This work is licensed under the GNU {kind}General Public License, version {version}.", tell),
        (name, _GNU_HEAD.format(kind=kind.upper(), version=version), tell),
    ]


def _creative_commons() -> list[tuple[str, str, tuple[str, ...]]]:
    """Both ways of naming each Creative Commons license."""
    out = []
    words = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        parts = kind.split("-")
        out.append((f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.", ("cc", *map(str.lower, parts), "4.0")))
        out.append((f"CC-{kind}-4.0", _CC.format(name="-".join(words[p] for p in parts), version="4.0"), ("creative", *(words[p].lower() for p in parts), "4.0")))
    return out


#: The wordings by which licenses are given or declared, with the words that must be there.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("MIT", f"{_MIT} {_AS_IS}", ("sublicense",)),
    ("MIT", _MIT, ("sublicense",)),
    ("MIT", "Released under the MIT License.", ("mit",)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache", "2.0")),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", ("apache", "2.0", "reproduction")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    *_gnu("GPL-3.0", "", "3"), *_gnu("GPL-2.0", "", "2"), *_gnu("LGPL-3.0", "Lesser ", "3"), *_gnu("LGPL-2.1", "Lesser ", "2.1"), *_gnu("AGPL-3.0", "Affero ", "3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla", "2.0", "form")),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0.", ("mozilla", "2.0")),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", ("eclipse", "2.0", "materials")),
    ("EPL-2.0", "Licensed under the Eclipse Public License 2.0.", ("eclipse", "2.0")),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3} {_BSD_END}", ("redistribution", "endorse")),
    ("BSD-3-Clause", f"{_BSD_2} {_BSD_3}", ("redistribution", "endorse")),
    ("BSD-2-Clause", f"{_BSD_2} {_BSD_END}", ("redistribution", "reproduce")),
    ("BSD-2-Clause", _BSD_2, ("redistribution", "reproduce")),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", ("bsd", "2")),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", ("bsd", "3")),
    ("ISC", f"{_ISC} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", ("fee", "purpose")),
    ("ISC", _ISC, ("fee", "purpose")),
    ("ISC", "Licensed under the ISC License.", ("isc",)),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.", ("organization", "transmit")),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost", "1.0")),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", ("misrepresented",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered",)),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.", ("waived",)),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal.", ("cc", "0", "1.0")),
    *_creative_commons(),
    ("Proprietary", "All rights reserved.", ("rights", "reserved")),
]
#: Identifiers of SPDX-License-Identifier lines, in lower case, and the license listed.
SPDX: dict[str, str] = {
    **{n.lower(): n for n in ("MIT", "Apache-2.0", "GPL-3.0-or-later", "GPL-2.0-or-later", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "ISC", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0")},
    **{n.lower(): n for n in ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0")},
    **{f"{n}{end}".lower(): n for n in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0") for end in ("", "-only")}, **{f"{n}+".lower(): f"{n}-or-later" for n in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0")},
}
TEMPLATES += [(name, f"SPDX-License-Identifier: {key}", ("spdx", "identifier")) for key, name in SPDX.items()]
#: An identifier line's expression: identifiers, in brackets or not, joined by operators.
IDENTIFIERS = re.compile(r"(?i)spdx-license-identifier:[ \t]*(\(*[a-z0-9.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9.+-]+\)*)*)")
#: Words that make a relative's license another one.
TELLING = frozenset(("lesser", "affero", "nc", "nd", "sa", "noncommercial", "commercial", "sharealike", "share", "noderivatives", "noderivs", "derivatives", "nonderivative"))
#: Words that turn a grant into its opposite, where the template has them not.
NEGATIONS = frozenset(("not", "never", "no", "nor", "neither", "cannot", "without", "isn", "don", "doesn", "wasn", "aren", "won", "unless"))
#: Words of short templates that a notice may leave out or say otherwise.
FILLER = frozenset(("this", "work", "is", "released", "licensed", "license", "the", "a", "version", "clause", "universal", "international", "terms", "of", "distributed"))
#: Words of a short template, and the words that may come between two of its words.
SHORT, GAP = 13, 6
#: Every find of CUE holds one of these, in lower case.
HINTS = ("licen", "spdx", "permission", "redistribution", "reserved", "unencumbered", "commons", "general public", "cc by", "cc-by", "ccby", "cc0", "cc-0", "cc 0", "source code form", "waived all")
#: No notice is without one of these.
CUE = re.compile(r"(?i)licen[sc]e|spdx|permission is (?:hereby )?granted|permission to use|source code form|waived all|redistribution and use|rights reserved|unencumbered|creative commons|general public|\bcc[ -]?(?:by|0)\b")
WORDS = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


STOP = re.compile(r"[.!?;:]\s|\n\s*\n")


#: How far a block reaches from a cue: as the longest template, and half as far again, as any cue may be the only one that is left.
REACH = max(len(text) for _, text, _ in TEMPLATES) * 3 // 2


def plain_words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def blocks_of(text: str) -> list[str]:
    """Windows around the cues, across line ends, merged where they overlap."""
    out, last = [], -1
    for m in CUE.finditer(text):
        s, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and s <= last:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
        last = e
    return [text[s:e] for s, e in out]


class Words:
    """A block's plain words, and between which of them a sentence or line ends."""

    def __init__(self, block: str):
        low = block.lower()
        found = [(m.group(), m.start(), m.end()) for m in WORDS.finditer(low)]
        self.words = [w for w, _, _ in found]
        self.breaks = [bool(STOP.search(low, a[2], b[1])) for a, b in zip(found, found[1:])]

    def pieces(self) -> list[list[str]]:
        """Lines and sentences with a cue."""
        ends = [0, *(i + 1 for i, x in enumerate(self.breaks) if x), len(self.words)]
        each = [self.words[a:b] for a, b in zip(ends, ends[1:])]
        return [x for x in each if CUE.search(" ".join(x))] if len(each) > 1 else []

    def negated(self, first: int) -> bool:
        """Whether one of the three words before the place, in the same sentence, is a negation."""
        for i in range(first - 1, max(-1, first - 4), -1):
            if self.breaks[i]:
                return False
            if self.words[i] in NEGATIONS:
                return True
        return False


class Scanner:
    """scan(block) -> [(license, share of the template found, size reduction, words missing)]."""

    def __init__(self, templates=TEMPLATES, level: int = 3, least_share: float = 0.9, ranking: bool = True):
        import zstandard

        self.least, self.ranking = least_share, ranking
        self.templates = [(name, plain_words(text), frozenset(needed)) for name, text, needed in templates]
        self.bare = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        self.with_template = []
        for _, words, _ in self.templates:
            d = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.with_template.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.cached = Memo(self._scan, 2000, longest=4 * REACH)

    def scan(self, block: str) -> list[tuple[str, float, float, list[str]]]:
        return self.cached[block]

    def ranked(self, at: Words) -> list[tuple[int, int]]:
        """(bytes saved, the template's number) of the templates that save any, best first. A long block has much of a short notice's wording
        elsewhere in itself, so its lines and sentences with a cue are compressed by themselves as well, and the most that is saved counts. A
        template whose telling words are not there can't be confirmed and is not compressed."""
        best: dict[int, int] = {}
        for words in [at.words, *at.pieces()]:
            data, have, size = " ".join(words).encode(), frozenset(words), 0
            for k, c in enumerate(self.with_template):
                if self.templates[k][2] <= have:
                    size = size or len(self.bare.compress(data))
                    best[k] = max(best.get(k, 0), size - len(c.compress(data)))
        key = (lambda x: (-x[0], -len(self.templates[x[1]][1]), x[1])) if self.ranking else (lambda x: (len(self.templates[x[1]][1]), x[1]))
        return sorted(((n, k) for k, n in best.items() if n > 0), key=key)

    def _scan(self, block: str) -> list[tuple[str, float, float, list[str]]]:
        at = Words(block)
        if not at.words:
            return []
        whole = len(self.bare.compress(" ".join(at.words).encode()))
        best: dict[str, tuple] = {}
        identified, taken = self.identified(block), []
        for saved, k in self.ranked(at):
            name, template, needed = self.templates[k]
            if template[0] == "spdx":  # exact as a line, and words of other places must not complete it
                if name in identified and name not in best:
                    best[name] = (1.0, saved / whole, [])
                continue
            for share, missing, (first, last) in self.confirmed(template, needed, at):
                if any(first < e and s < last for s, e in taken):
                    continue  # what ranks higher has this place
                taken.append((first, last))
                if name not in best:
                    best[name] = (share, saved / whole, missing)
        return sorted((name, *x) for name, x in best.items())

    def confirmed(self, template: list[str], needed: frozenset[str], at: Words) -> Iterator[tuple[float, list[str], tuple[int, int]]]:
        """Share, words missing and span of each place where the template stands. Each place is taken out before the next is sought."""
        words = list(at.words)
        while True:
            share, missing, (first, last), run, extra = self.difference(template, words)
            if run < 2 and len(template) > 1 or not run:
                return
            near = frozenset(words[first:last])
            if (share >= self.least or self.filled(template, share, missing, near)) and needed <= near and not extra & (TELLING - {*template}) and not extra & NEGATIONS and not at.negated(first):
                yield share, missing, (first, last)
            words[first:last] = [""] * (last - first)

    @staticmethod
    def filled(template: list[str], share: float, missing: list[str], near: frozenset[str]) -> bool:
        """Whether a short template lacks only filler words, at most half of its words, and the place still speaks of licensing."""
        return len(template) <= SHORT and share >= 0.5 and FILLER.issuperset(w for w in missing if w not in near) and ("cc" in near or any(w.startswith("licen") for w in near))

    def identified(self, block: str) -> set[str]:
        """The licenses named in the block's identifier lines."""
        return {SPDX[x] for m in IDENTIFIERS.finditer(block) for x in re.split(r"[ \t()]+", m.group(1).lower()) for x in {x, x.rstrip(".")} if x in SPDX}

    @staticmethod
    def difference(template: list[str], words: list[str]) -> tuple[float, list[str], tuple[int, int], int, frozenset[str]]:
        """The share of the template's words that the block has in order, those it lacks, the aligned stretch, its longest run, and the
        words there that the template has not."""
        m = SequenceMatcher(None, template, words, autojunk=False)
        found = [b for b in m.get_matching_blocks() if b.size]
        if not found:
            return 0.0, template, (0, 0), 0, frozenset()
        anchor = max(found, key=lambda b: b.size)
        k = found.index(anchor)  # words that stand far apart are no notice
        gap = lambda i: found[i].b - found[i - 1].b - found[i - 1].size > GAP + found[i].a - found[i - 1].a - found[i - 1].size
        i = next((i for i in range(k, 0, -1) if gap(i)), 0)
        j = next((j for j in range(k + 1, len(found)) if gap(j)), len(found))
        found = found[i:j]
        hit = {i for b in found for i in range(b.a, b.a + b.size)}
        span = found[0].b, found[-1].b + found[-1].size
        kept = {i for b in found for i in range(b.b, b.b + b.size)}
        return len(hit) / len(template), [w for i, w in enumerate(template) if i not in hit], span, anchor.size, frozenset(words[i] for i in range(*span) if i not in kept)


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each document and license found: doc_id, license, n_blocks, share, reduction, missing (words)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in batches:
            out = []
            for who, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                got: dict[str, list] = {}
                for block in blocks_of(text.as_py()):
                    for name, share, reduction, missing in s.scan(block):
                        old = got.setdefault(name, [0, 0.0, 0.0, missing])
                        old[0] += 1
                        if share > old[1]:
                            old[1:] = [share, reduction, missing]
                out += [(who, name, n, share, reduction, missing) for name, (n, share, reduction, missing) in got.items()]
            cols, types = list(zip(*out)) or [()] * 6, (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "license", "n_blocks", "share", "reduction", "missing"])

    low = F.lower("text")
    hinted = reduce(lambda x, y: x | y, [low.contains(h) for h in HINTS])
    return id_and_text(docs).where(hinted).mapInArrow(run, "doc_id long, license string, n_blocks long, share double, reduction double, missing array<string>")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
