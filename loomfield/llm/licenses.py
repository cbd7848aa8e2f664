"""License scan: winnowed fingerprints find candidate templates, banded alignment confirms them.

A template is a sequence of lower-case words. Hashes of ``K`` consecutive words are winnowed (the
smallest of every two, rightmost on ties) and kept in an inverted index from fingerprint to
(template, place). A document's words are mapped to the templates' vocabulary; runs of known words
are fingerprinted the same way, and fingerprints found in the index vote for a template and a
diagonal. Each candidate is aligned with the document around its diagonal in a band of ``BAND``
words; a match reports the share of the template's words that are aligned, and the span in the text.

The index is as large as the templates, not as the corpus, and travels with the code; documents are
scanned where they are read, without a shuffle. A match of four fifths of a template has three words in
a row unchanged, which winnowing by two cannot miss; templates of fewer than ``SHORT`` words may have but two
in a row and are indexed by all their fingerprints.

Templates are the texts of MIT, BSD-2-Clause, BSD-3-Clause, ISC, 0BSD, Zlib, BSL-1.0 and Unlicense in full,
and for these and Apache-2.0, GPL, LGPL, AGPL, MPL, EPL, CC BY, BY-SA, BY-NC and CC0 the notices that
name them; a caller may give others.

Definitions: null and empty texts match nothing and have no row; very long texts are scanned whole;
a document has one row per matched template and place; of overlapping matches the one with more
matched words is reported, of those the one that covers its template better, then the earlier;
spans count characters of the given text; repeated rows are reported alike; columns besides doc_id
and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

K, BAND = 2, 6
SHORT = 10  # templates of fewer words are indexed by all their fingerprints
WINDOWS = (1, 2)
SCHEMA = "doc_id long, license string, template string, coverage double, matched_words long, start long, end long"
_WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")

# Clauses that several licences share.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."

# Names of licences and the wording of their notices, characteristic paragraphs and, where short, full texts.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        _MIT_GRANT,
        f"{_MIT_GRANT} {_AS_IS}",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        _BSD_NAMES,
        f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_AS_IS}",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", _BSD_TERMS, f"{_BSD_TERMS} {_BSD_AS_IS}"],
    "ISC": [
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.",
        f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_AS_IS}",
    ],
    "0BSD": ["SPDX-License-Identifier: 0BSD", f"{_ISC_GRANT}. {_ISC_AS_IS}"],
    "Zlib": [
        "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS} For more information, please refer to <https://unlicense.org>",
    ],
}


def lowered(text: str) -> str:
    """The text in lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def fingerprints(ids: np.ndarray, window: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``K``-word runs without unknown words (id 0), winnowed by ``window``, and their places."""
    n = len(ids) - K + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = ids.astype(np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for i in range(K):
        h = (h ^ x[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= x[i : i + n] > 0
    top = np.iinfo(np.uint64).max
    h = np.where(known, h, top)
    if n >= window:
        wide = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
        at = np.unique(np.arange(n - window + 1) + window - 1 - wide.argmin(1))
    else:
        at = np.array([int(h.argmin())])
    at = at[h[at] != top]
    return h[at], at


class Scanner:
    """The inverted index over templates."""

    def __init__(self, templates: dict[str, list[str]] | None = None, least: float = 0.8):
        self.least = least
        self.names: list[tuple[str, str]] = []
        self.texts: list[list[str]] = []
        self.vocabulary: dict[str, int] = {}
        index: dict[int, dict[int, list[tuple[int, int]]]] = {w: defaultdict(list) for w in WINDOWS}
        for name, wordings in (templates or TEMPLATES).items():
            for i, wording in enumerate(wordings):
                words = words_of(wording)
                ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
                window = WINDOWS[len(words) >= SHORT]
                for h, at in zip(*fingerprints(ids, window)):
                    index[window][int(h)].append((len(self.texts), int(at)))
                self.names.append((name, f"{name}/{i}"))
                self.texts.append(words)
        self.index = {w: dict(places) for w, places in index.items()}
        self.keys = {w: np.array(sorted(places), dtype=np.uint64) for w, places in index.items()}
        self.ids = [np.array([self.vocabulary[w] for w in t]) for t in self.texts]

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, place of its first word) by votes of shared fingerprints; one per band of diagonals."""
        votes: set[tuple[int, int]] = set()
        for window, places in self.index.items():
            h, at = fingerprints(ids, window)
            found = np.isin(h, self.keys[window])
            for x, i in zip(h[found].tolist(), at[found].tolist()):
                votes.update((t, i - p) for t, p in places[x])
        out: list[tuple[int, int]] = []
        for t, d in sorted(votes):
            if not (out and out[-1][0] == t and d - out[-1][1] <= BAND // 2):
                out.append((t, d))
        return out

    def align(self, ids: np.ndarray, template: int, at: int) -> tuple[int, int, int]:
        """Most template words in order within the band, and the first and last aligned document words."""
        t = self.ids[template]
        best: dict[int, tuple[int, int, int]] = {}  # diagonal -> matched, first, -last (more, then closer together)
        width = range(-BAND, BAND + 1)
        for i in range(len(t)):
            new: dict[int, tuple[int, int, int]] = {}
            for d in width:
                j = at + i + d
                # skip a template word: one diagonal lower; skip a document word: one higher
                options = [best[x] for x in (d, d + 1) if x in best]
                if d - 1 in new:
                    options.append(new[d - 1])
                if 0 <= j < len(ids) and ids[j] == t[i]:
                    m = best.get(d, (0, j, -j))
                    options.append((m[0] + 1, m[1] if m[0] else j, -j))
                if options:
                    new[d] = max(options)
            best = new
        matched, first, last = max(best.values(), default=(0, 0, 0))
        return matched, first, -last

    def scan(self, text: str) -> list[tuple[str, str, float, int, int, int]]:
        """Matches as (license, template, coverage, matched words, start, end) in order of place."""
        lower = lowered(text)
        ids = np.fromiter(map(self.vocabulary.get, _WORD.findall(lower), repeat(0)), dtype=np.int64)
        found = []
        for template, at in self.candidates(ids):
            t = self.ids[template]
            near = ids[max(0, at - BAND) : max(0, at + len(t) + BAND)]
            if np.isin(t, near).sum() < self.least * len(t):  # too few of its words are there at all
                continue
            matched, first, last = self.align(ids, template, at)
            if matched and matched / len(self.ids[template]) >= self.least:
                found.append((-matched, -matched / len(self.ids[template]), first, last, template))
        if not found:
            return []
        places = [m.span() for m in _WORD.finditer(lower)]
        taken: list[tuple[int, int]] = []
        out = []
        for matched, share, first, last, template in sorted(found):
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append((*self.names[template], -share, -matched, places[first][0], places[last][1]))
        return sorted(out, key=lambda x: x[4])


def scan_documents(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """One row per match; spans count characters of the text."""

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(templates, least)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        for b in batches:
            rows = [(i, *m) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) if t for m in scanner.scan(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
