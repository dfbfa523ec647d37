"""License scans by conditional compression.

A statement is looked for in the words around every license word, as far to either side as the
template with the longest gaps reaches, over line ends and blank lines. Every template of which
the words are there is confirmed by the exact differences in wording: words missing from the
template and words added within the matched stretch. The words of every confirmed statement are
compressed alone and with the template as a zstandard raw dictionary: the bytes saved rank all of
them, and of overlapping statements the one that saves most counts, then the one with more matched
words. The share saved of its text as written is reported.

Defined results: null, empty and wordless texts have no findings; repeated rows have the same
findings each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import collections
import difflib
import functools
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecsnap.llm.common import whole

# Names and wordings of public licenses and of the short notices that refer to them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "CC-BY-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA-4.0": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "All-Rights-Reserved": ["All rights reserved.", "No part may be reproduced without permission."],
}

CANDIDATE = r"(?i)licen[sc]e|SPDX|copyright|©|redistribution|permission is hereby|permission to use|public domain|all rights reserved|creative commons"
# A statement is confirmed from this share of template words in order.
COVERAGE = 0.8
# Templates of up to so many words stand on one line.
SHORT = 12
# Words that may stand between two matched runs of one statement; runs farther off are chance.
LONGEST_GAP = 12
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
FIELDS = (
    "doc_id long, first_line int, last_line int, license string, template int, saved double, "
    "coverage double, missing string, added string, exact boolean"
)


class Templates:
    def __init__(self, templates: dict[str, list[str]]):
        import zstandard

        self.rows = [(name, i, text) for name, texts in templates.items() for i, text in enumerate(texts)]
        self.words = [WORDS.findall(text.lower()) for _, _, text in self.rows]
        self.counts = [collections.Counter(words) for words in self.words]
        self.vocabulary = set().union(*self.counts)
        self.plain = zstandard.ZstdCompressor(level=3)
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self.with_dict = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=raw))
            for _, _, text in self.rows
        ]
        # Words alone, as case, line ends and punctuation are no part of the wording.
        self.with_words = [
            zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=raw))
            for words in self.words
        ]

    def gain(self, words: list[str], k: int) -> int:
        """Bytes of the compressed words that a template saves."""
        data = " ".join(words).encode()
        return len(self.plain.compress(data)) - len(self.with_words[k].compress(data))

    def saved(self, block: str, k: int) -> float:
        """Share of the compressed size of a text that a template saves."""
        data = block.encode()
        return 1 - len(self.with_dict[k].compress(data)) / len(self.plain.compress(data))

    def differences(self, k: int, words: list[str]) -> tuple[int, int, int, int, int, str, str] | None:
        """Words matched, span of the statement and of its longest run, template words missing, words added between."""
        want = self.words[k]
        blocks = difflib.SequenceMatcher(None, want, words, autojunk=False).get_matching_blocks()[:-1]
        if not blocks:
            return None
        # The statement is the longest run and what follows or precedes it without a long gap.
        far = [i for i in range(1, len(blocks)) if blocks[i].b - blocks[i - 1].b - blocks[i - 1].size > LONGEST_GAP]
        main = max(range(len(blocks)), key=lambda i: blocks[i].size)
        run = blocks[main]
        blocks = blocks[max([i for i in far if i <= main], default=0) : min([i for i in far if i > main], default=len(blocks))]
        matched = sum(b.size for b in blocks)
        hit = {i for b in blocks for i in range(b.a, b.a + b.size)}
        missing = " ".join(w for i, w in enumerate(want) if i not in hit)
        inside = {j for b in blocks for j in range(b.b, b.b + b.size)}
        first, last = min(inside), max(inside) + 1
        added = " ".join(words[j] for j in range(first, last) if j not in inside)
        return matched, first, last, run.b, run.b + run.size, missing, added

    def statements(self, k: int, words: list[str], places: dict[str, list[int]], first: int, last: int) -> Iterator[tuple]:
        """Confirmed statements of one template in a stretch of words: matched, start, end, missing, added."""
        want = self.words[k]
        reach = len(want) + LONGEST_GAP * (len(want) - 1)
        # A statement is no longer than one reach, so it lies whole in one of these pieces.
        pieces = [(p, min(last, p + 2 * reach)) for p in range(first, max(first + 1, last - reach), reach)]
        while pieces:
            lo, hi = pieces.pop()
            there = 0
            for word, n in self.counts[k].items():
                at = places.get(word, [])
                there += min(n, bisect.bisect_left(at, hi) - bisect.bisect_left(at, lo))
            if there < COVERAGE * len(want):
                continue
            matched, start, end, run_start, run_end, missing, added = self.differences(k, words[lo:hi])
            if matched >= COVERAGE * len(want):
                yield matched, lo + start, lo + end, missing, added
            else:
                # The longest run belongs to no statement; others lie on its sides.
                start, end = run_start, run_end
            pieces += [(lo, lo + start), (lo + end, hi)]

    def scan(self, text: str, candidate: re.Pattern) -> list[tuple]:
        """Confirmed statements of a text that do not overlap; those that their template compresses most go first."""
        spans = [m.span() for m in WORDS.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        places: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            if word in self.vocabulary:
                places.setdefault(word, []).append(i)
        starts = [a for a, _ in spans]
        ends = [m.start() for m in re.finditer("\n", text)]
        hits = [m.start() for m in candidate.finditer(text)]
        hit_lines = sorted({bisect.bisect_left(ends, h) for h in hits})
        near = sorted({max(0, bisect.bisect_right(starts, h) - 1) for h in hits})
        options = []
        for k, want in enumerate(self.words):
            if sum(min(n, len(places.get(w, []))) for w, n in self.counts[k].items()) < COVERAGE * len(want):
                continue
            reach = len(want) + LONGEST_GAP * (len(want) - 1)
            stretches: list[list[int]] = []
            for i in near:
                lo, hi = max(0, i - reach), min(len(words), i + reach + 1)
                if stretches and lo <= stretches[-1][1]:
                    stretches[-1][1] = hi
                else:
                    stretches.append([lo, hi])
            for lo, hi in stretches:
                for matched, start, end, missing, added in self.statements(k, words, places, lo, hi):
                    first, last = (bisect.bisect_left(ends, spans[i][0]) for i in (start, end - 1))
                    at = bisect.bisect_left(hit_lines, first)
                    if (first == last or len(want) > SHORT) and at < len(hit_lines) and hit_lines[at] <= last:
                        options.append((-self.gain(words[start:end], k), -matched, -matched / len(want), start, k, end, first, last, missing, added))
        found, taken = [], []
        for _, _, coverage, start, k, end, first, last, missing, added in sorted(options):
            # Taken spans are apart and in order.
            at = bisect.bisect_left(taken, (start, start))
            if (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > start):
                continue
            taken.insert(at, (start, end))
            name, i, _ = self.rows[k]
            saved = self.saved(text[spans[start][0] : spans[end - 1][1]], k)
            found.append((start, (first, last, name, i, round(saved, 6), round(-coverage, 6), missing, added, not missing and not added)))
        return [row for _, row in sorted(found)]


@functools.lru_cache(maxsize=2)
def _templates(rows: tuple) -> Templates:
    return Templates({name: list(texts) for name, texts in rows})


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """One row per confirmed statement. Only texts with a license word leave the JVM."""
    rows = tuple((name, tuple(texts)) for name, texts in templates.items())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, candidate = _templates(rows), re.compile(CANDIDATE)
        names = [f.strip().split(" ")[0] for f in FIELDS.split(",")]
        for batch in batches:
            out = [(doc, *f) for doc, text in zip(batch["doc_id"], batch["text"]) for f in tool.scan(text, candidate)]
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return picked.where(F.col("text").rlike(CANDIDATE)).mapInPandas(run, FIELDS)
