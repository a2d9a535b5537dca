"""Licenses: every template against every block without the memo or the order of work, wordings that are no templates, and the rank."""

import random
import re
import textwrap

import pytest

from siltscope.llm import licenses as L

WORDS = "river stone paper cloud engine violet market winter signal copper garden morning letter window harbor silver forest candle thunder marble".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def found(text, scanner=None):
    return {x[0] for b in L.blocks_of(text) for x in (scanner or L.scanner()).scan(b)}


FULL = {name: text for name, text, _ in reversed(L.TEMPLATES) if len(text) > 300}


@pytest.mark.parametrize("name", FULL)
def test_full_wordings_anywhere_in_long_texts(name):
    for width, prefix in ((60, ""), (72, "# "), (79, " * "), (200, "// ")):
        lines = "\n".join(prefix + x for x in textwrap.wrap(FULL[name], width))
        assert found(f"{prose(3000, 1)}\n\n{lines}\n\n{prose(3000, 2)}") == {name}, (width, prefix)


def test_the_rank_decides_between_relatives():
    text = FULL["BSD-3-Clause"]
    assert found(text) == {"BSD-3-Clause"}
    plain = L.Scanner(ranking=False)  # the shortest template first
    assert "BSD-2-Clause" in found(text, plain)
    notice = next(t for n, t, _ in L.TEMPLATES if n == "GPL-3.0-or-later")
    assert found(notice) == {"GPL-3.0-or-later"}


def test_all_templates_that_shorten_a_block_are_confirmed_in_order():
    """Brute force: every template is tried, by its own compressor, and the places are claimed in order of what was saved."""
    import zstandard

    r = random.Random(5)
    s = L.scanner()
    for k in range(60):
        parts = [prose(r.randint(5, 30), k)]
        for _ in range(r.randint(1, 3)):
            parts += [r.choice(L.TEMPLATES)[1], prose(r.randint(5, 30), k + 1)]
        for block in L.blocks_of("\n\n".join(parts)):
            at = L.Words(block)
            ranks = []
            for i, (_, text, needed) in enumerate(L.TEMPLATES):
                d = zstandard.ZstdCompressionDict(" ".join(L.plain_words(text)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=3)
                saved = 0
                for words in [at.words, *at.pieces()]:
                    data = " ".join(words).encode()
                    size = len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(data))
                    saved = max(saved, size - len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data)) if {*needed} <= {*words} else 0)
                if saved > 0:
                    ranks.append((-saved, -len(L.plain_words(text)), i))
            taken, want = [], set(s.identified(block))
            for _, _, i in sorted(ranks):
                name, text, needed = L.TEMPLATES[i]
                if text.startswith("SPDX"):
                    continue
                for _, _, (a, b) in s.confirmed(L.plain_words(text), frozenset(needed), at):
                    if all(b <= c or d <= a for c, d in taken):
                        taken.append((a, b))
                        want.add(name)
            assert {x[0] for x in s._scan(block)} == want


UNSEEN = [
    ("This project is released under the MIT license", {"MIT"}), ("The code is available under the MIT License.", {"MIT"}), ("Source code licensed under the terms of the Apache License 2.0", {"Apache-2.0"}),
    ("Distributed under Apache License, Version 2.0", {"Apache-2.0"}), ("licensed under the GNU General Public License version 3", {"GPL-3.0"}), ("Licensed under the GNU Affero General Public License v3", {"AGPL-3.0"}),
    ("Licensed under the 3-Clause BSD License", {"BSD-3-Clause"}), ("Distributed under the Boost Software License 1.0", {"BSL-1.0"}), ("published under the Mozilla Public License 2.0", {"MPL-2.0"}), ("Text under CC BY-SA 4.0 license", {"CC-BY-SA-4.0"}),
    ("SPDX-License-Identifier: MIT", {"MIT"}), ("SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}), ("SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0"}), ("Copyright 2001 Example. All rights reserved.", {"Proprietary"}),
    ("This software is not released under the MIT License.", set()), ("We do not want all rights reserved here", set()), ("It was never licensed under the Apache License, Version 2.0.", set()), ("This isn't licensed under CC BY 4.0.", set()),
    ("He renewed the license of the car", set()), ("a fishing license version 2.0 for the general public", set()), ("permission to use the garden was granted", set()), ("the BSD talk and the license plate number 3", set()),
    ("The MIT campus store sells a poetic license", set()), ("commons of a creative kind, attribution unknown, 4.0 grade", set()),
]


def test_precision_and_recall_on_wordings_that_are_no_templates():
    known = {" ".join(L.plain_words(t)) for _, t, _ in L.TEMPLATES}
    hits = misses = false = 0
    for text, names in UNSEEN:
        got = found(f"{prose(40, 1)}.\n{text}\n{prose(40, 2)}")
        hits, misses, false = hits + len(got & names), misses + len(names - got), false + len(got - names)
    assert sum(" ".join(L.plain_words(t)) in known for t, _ in UNSEEN) <= 3
    assert hits / (hits + misses) >= 0.9 and hits / (hits + false) >= 0.95, (hits, misses, false)


def test_differences_decide():
    bsd3 = FULL["BSD-3-Clause"]
    assert found(bsd3.replace("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "")) == set()
    assert found(FULL["MIT"].replace("Permission is hereby granted", "Permission is not hereby granted")) == set()
    assert found(re.sub("SOFTWARE", "PROGRAM", FULL["MIT"])) == {"MIT"}


def test_query(spark, tmp_path):
    rows = [(1, FULL["MIT"], "x", 1), (2, None, "x", 1), (3, "", "x", 1), (None, "SPDX-License-Identifier: MIT", "x", 1), (4, prose(50, 3), "x", 1), (5, FULL["ISC"], "x", 1), (5, FULL["ISC"], "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, license string, share int").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op1_licenses(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.license) for r in got), key=repr) == sorted([(1, "MIT"), (5, "ISC"), (5, "ISC"), (None, "MIT")], key=repr)
