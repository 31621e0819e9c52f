"""License notices by conditional compression with zstandard.

Candidate blocks begin at a sentence that speaks of licensing or names a license, and run on over lines
that templates cover. A block is compressed alone and with each template as a raw-content dictionary;
the fall in size says how much of its wording the template holds. Templates are taken by that fall and
confirmed by exact wording: the words that a best alignment leaves unmatched on either side. The longest
part of a run that some template fits wins, then the fewest differences; too many, or a difference in a
version number, refuse the match. In sentences that no template fits, a license named after "under"
counts if it is worded exactly as one of NAMES.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that may differ, as a share of the block's; sentences a block may bridge.
MOST_DIFFERENT, GAP = 0.3, 1
#: Least fall in size, as a share of the block's own compressed size.
LEAST_FALL = 0.15
#: Shorter blocks must be a whole phrase without a difference. Share of a line's word pairs that templates must have to cover it.
LEAST_WORDS, COVERED = 5, 0.6
LEVEL = 3
WORD = re.compile(r"\w+(?:[.\-]\w+)*", re.UNICODE)
#: Every phrase of TEMPLATES holds one of these. Names that are ordinary words in some language count as written only.
KEYWORDS = (
    r"(?i:\blicen[sc]|copyright|\(c\) *(?:19|20)[0-9][0-9]|all rights reserved|permission is hereby|redistribution and use|without warrant|public domain|spdx-"
    r"|\bgnu\b|\b[al]?gpl|\bmpl\b|\bcc0\b|\bcc[ -]by\b|creative commons|free software|unlicense)|\b(?:MIT|BSD|ISC|Apache)\b|Permission to use"
    r"|(?i:distributed on an \W*as is)"
)
_KEYWORD = re.compile(KEYWORDS)
#: Numbers of a list's items, which are no wording.
ITEM = re.compile(r"\d{1,2}(?=[.)]\s+(?:Redistribution|Neither|All advertising))")
NUMBER = re.compile(r"v?\d{1,2}(\.\d+)*|\d-clause|by|nc|nd|sa|by-\w+|lesser|affero")
SENTENCE = re.compile(r"\S.*?(?:(?<!\bv)(?<!\bver)[.!?](?=\s|$)|$)", re.I)  # "v. 2.0" goes on

#: Wordings of public licenses. Terms, then notices.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT) Copyright (c) " + _MIT,
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Released under the GNU GPL v2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD 2-Clause License Copyright (c) All rights reserved. " + _BSD + " " + _BSD_END,
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "BSD 3-Clause License Copyright (c) All rights reserved. " + _BSD + " " + _BSD_NAMES + " " + _BSD_END,
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "ISC License Copyright (c) " + _ISC,
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "CC0-1.0": (
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, which is dedicated to the public domain under CC0 1.0.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "MIT OR Apache-2.0": (
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
        "SPDX-License-Identifier: MIT OR Apache-2.0",
    ),
    "all-rights-reserved": ("Copyright (c) The Authors. All rights reserved.", "All rights reserved."),
}


#: What licenses are called in prose and headings.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT", "MIT License", "MIT/X11 License"),
    "Apache-2.0": ("Apache-2.0", "Apache 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache License 2.0", "Apache License, Version 2.0"),
    "GPL-3.0": ("GPLv3", "GPL v3", "GPL 3", "GPL-3.0", "GPL 3.0", "GNU GPLv3", "GNU GPL v3", "GNU General Public License v3", "GNU General Public License v3.0", "GNU General Public License version 3"),
    "GPL-2.0": ("GPLv2", "GPL v2", "GPL 2", "GPL-2.0", "GPL 2.0", "GNU GPLv2", "GNU GPL v2", "GNU General Public License v2", "GNU General Public License v2.0", "GNU General Public License version 2"),
    "LGPL-2.1": ("LGPLv2.1", "LGPL v2.1", "LGPL-2.1", "LGPL 2.1", "GNU LGPL v2.1", "GNU Lesser General Public License v2.1", "GNU Lesser General Public License version 2.1"),
    "AGPL-3.0": ("AGPLv3", "AGPL v3", "AGPL-3.0", "AGPL 3.0", "GNU AGPLv3", "GNU AGPL v3", "GNU Affero General Public License v3", "GNU Affero General Public License v3.0", "GNU Affero General Public License version 3"),
    "BSD-2-Clause": ("BSD-2-Clause", "BSD-2-Clause License", "BSD 2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD-3-Clause", "BSD-3-Clause License", "BSD 3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "MPL-2.0": ("MPL-2.0", "MPL 2.0", "MPL v2.0", "MPLv2", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "Mozilla Public License, version 2.0"),
    "ISC": ("ISC", "ISC License"),
    "Unlicense": ("Unlicense", "Unlicense License"),
    "CC0-1.0": ("CC0", "CC0-1.0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "CC-BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "MIT OR Apache-2.0": ("MIT or Apache-2.0", "MIT or Apache 2.0", "MIT/Apache-2.0", "MIT and Apache-2.0", "Apache-2.0 or MIT", "Apache 2.0 or MIT", "MIT or the Apache License 2.0"),
}
BEFORE = ("under", "under the", "under a", "under an", "under either", "under the terms of the", "under the terms of")


def _words(text: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    """Words of a part of the text in lower case, with their places, without the numbers of list items."""
    end = len(text) if end is None else end
    items = {m.start() for m in ITEM.finditer(text, start, end)}
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text, start, end) if m.start() not in items]


_PHRASES = {name: [[w for w, _, _ in _words(p)] for p in (*phrases, *NAMES.get(name, ()))] for name, phrases in TEMPLATES.items()}
_IDS = {w: i for i, w in enumerate(sorted({w for phrases in _PHRASES.values() for p in phrases for w in p}))}
_PAIRS = {pair for phrases in _PHRASES.values() for p in phrases for pair in zip(p, p[1:])}
_NAMED = {" ".join(w for w, _, _ in _words(f"{before} {n}")): name for name, own in NAMES.items() for n in own for before in BEFORE}
_NAMED_PATTERN = re.compile(r"(?<!\S)(?:" + "|".join(re.escape(x) for x in sorted(_NAMED, key=len, reverse=True)) + r")(?!\S)")


def _covered(sentence: str) -> bool:
    """Templates have most of the sentence's word pairs. One of a single word, as a list's number, is covered."""
    words = [w for w, _, _ in _words(sentence)]
    return sum(pair in _PAIRS for pair in zip(words, words[1:])) >= COVERED * (len(words) - 1)


def candidate_runs(text: str | None) -> Iterator[list[tuple[int, int]]]:
    """(start, end) of sentences with a licensing word, and of those beside them that templates cover; at most GAP other ones lie between two of a list.

    A line's end ends a sentence.
    """
    text, units, at, n = text or "", [], 0, 0
    for line in text.split("\n"):
        for m in SENTENCE.finditer(line):
            units.append((n, at + m.start(), at + m.end(), bool(_KEYWORD.search(m.group()))))
            n += 1
        n += not line.strip()  # an empty line counts
        at += len(line) + 1
    taken = {k for k, unit in enumerate(units) if unit[3]}
    for step in (1, -1):
        for k in sorted(taken)[::step]:
            k += step
            while 0 <= k < len(units) and k not in taken and abs(units[k][0] - units[k - step][0]) <= GAP + 1 and _covered(text[units[k][1] : units[k][2]]):
                taken.add(k)
                k += step
    run: list[tuple[int, int]] = []
    last = 0
    for k in sorted(taken):
        n, start, end, _ = units[k]
        if run and n - last > GAP + 1:
            yield run
            run = []
        run.append((start, end))
        last = n
    if run:
        yield run


def alignments(block: list[int], phrase: np.ndarray) -> list[np.ndarray]:
    """Least differing words between the first i words of the block and any span of the phrase that ends before its word j, for all i and j."""
    at, row = np.arange(len(phrase) + 1), np.zeros(len(phrase) + 1, np.int64)
    rows = [row]
    for a in block:
        new = row + 1
        new[1:] = np.where(phrase == a, row[:-1], new[1:])
        row = np.minimum.accumulate(new - at) + at
        rows.append(row)
    return rows


def left_over(rows: list[np.ndarray], block: list[str], phrase: list[str]) -> list[str]:
    """Words of the block and of the phrase's matched span that a best alignment of the whole block leaves over."""
    i, lone = len(block), []
    j = int(rows[i].argmin())
    while i:
        if j and block[i - 1] == phrase[j - 1]:
            i, j = i - 1, j - 1
        elif j and rows[i][j] == rows[i][j - 1] + 1:
            j -= 1
            lone.append(phrase[j])
        else:
            i -= 1
            lone.append(block[i])
    return lone


class Scanner:
    def __init__(self):
        import zstandard

        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        raw = {k: "\n".join([*v, *(f"{before} {n}" for n in NAMES.get(k, ()) for before in BEFORE[:2])]).lower().encode() for k, v in TEMPLATES.items()}
        self.with_template = {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in raw.items()}
        self.phrases = {k: [(w, np.array([_IDS[x] for x in w]), frozenset(w)) for w in v] for k, v in _PHRASES.items()}
        #: A block of more words than this differs too much from every phrase.
        self.most_words = int(max(len(w) for v in self.phrases.values() for w, _, _ in v) / (1 - MOST_DIFFERENT))
        self.known: dict[tuple[str, tuple[int, ...]], tuple[int, str, int, int, int] | None] = {}

    def sizes(self, block: str) -> tuple[int, dict[str, int]]:
        """Compressed size alone, in lower case, and the fall in size with each template."""
        data = block.lower().encode("utf-8", "replace")
        size = len(self.alone.compress(data))
        return size, {name: size - len(c.compress(data)) for name, c in self.with_template.items()}

    def longest(self, text: str, words: list[tuple[str, int, int]], ends: tuple[int, ...]) -> tuple[int, str, int, int, int] | None:
        """The longest of the parts of text, its first ends[k] words, that a license fits: k, license, compressed size alone and with its template, words that differ."""
        plain = [w for w, _, _ in words]
        ids = [_IDS.get(w, -1) for w in plain]
        _, falls = self.sizes(text)
        fits: dict[int, list] = {}
        for name in sorted(falls, key=lambda x: (-falls[x], x)):
            if falls[name] <= 0:
                continue
            for phrase, numbers, vocabulary in self.phrases[name]:
                unknown, most = 0, 0
                for i in range(min(len(plain), int(len(phrase) / (1 - MOST_DIFFERENT)))):
                    unknown += plain[i] not in vocabulary  # each such word differs, whatever the alignment
                    if unknown <= MOST_DIFFERENT * (i + 1):
                        most = i + 1
                if most < ends[0]:
                    continue
                rows = alignments(ids[: max(e for e in ends if e <= most)], numbers)
                for k, e in enumerate(ends):
                    if e <= most and rows[e].min() <= MOST_DIFFERENT * e and (e >= LEAST_WORDS or plain[:e] == phrase):
                        fits.setdefault(k, []).append((int(rows[e].min()), name, rows, phrase))
        for k in sorted(fits, reverse=True):
            e, best = ends[k], None
            size, falls = self.sizes(text[: words[e - 1][2]])
            for differ, name, rows, phrase in fits[k]:
                if falls[name] >= LEAST_FALL * size and (best is None or (differ, -falls[name], name) < best):
                    if not any(NUMBER.fullmatch(w) for w in left_over(rows[: e + 1], plain[:e], phrase)):
                        best = differ, -falls[name], name
            if best:
                return k, best[2], size, size + best[1], best[0]
        return None

    def named(self, text: str, words: list[tuple[str, int, int]]) -> Iterator[tuple]:
        """start, n_chars and match of the licenses that are named after "under" in a sentence, exactly."""
        joined, n, before = " ".join(w for w, _, _ in words), 0, 0
        for m in _NAMED_PATTERN.finditer(joined):
            n += joined.count(" ", before, m.start())
            before = m.start()
            start, end = words[n][1], words[n + m.group().count(" ")][2]
            size, falls = self.sizes(text[start:end])
            name = _NAMED[m.group()]
            if falls[name] > 0 or falls[name] >= max(falls.values()):  # a few bytes may not shrink with any template
                yield start, end - start, name, size, size - falls[name], 0

    def notices(self, text: str | None) -> Iterator[tuple]:
        """start, n_chars and match of the notices in a text: of each run the longest parts that match, from its start on."""
        for run in candidate_runs(text):
            words = _words(text, run[0][0], run[-1][1])
            places = [start for _, start, _ in words]
            first, last = ([bisect_left(places, place) for place in x] for x in zip(*run))
            i = 0
            while i < len(run):
                a, j = first[i], i
                while j < len(run) and last[j] - a <= self.most_words:
                    j += 1
                ends = tuple(e - a for e in last[i:j])
                found = None
                if ends and ends[0]:
                    window = text[run[i][0] : run[j - 1][1]]
                    if (window, ends) not in self.known:
                        if len(self.known) > 2_000:
                            self.known.clear()
                        own = [(w, s - run[i][0], e - run[i][0]) for w, s, e in words[a : a + ends[-1]]]
                        self.known[window, ends] = self.longest(window, own, ends)
                    found = self.known[window, ends]
                if found:
                    k, *match = found
                    yield run[i][0], run[i + k][1] - run[i][0], *match
                    i += k
                else:
                    yield from self.named(text, words[a : last[i]])
                i += 1


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per license notice found: doc_id, start and n_chars of its block, license, plain_bytes, with_template_bytes, differing_words.

    Whole texts are searched. Null and empty texts, and blocks whose wording fits no template, give
    no row. Repeated rows each give their rows; an empty table gives an empty result; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc_id, *notice) for notice in scanner.notices(text)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "n_chars", "license", "plain_bytes", "with_template_bytes", "differing_words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(KEYWORDS))
    return rows.mapInArrow(run, "doc_id long, start long, n_chars long, license string, plain_bytes long, with_template_bytes long, differing_words long")
