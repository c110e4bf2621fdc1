"""Licence scan: passages against licence templates by the Dice coefficient over word bigrams.

Text is normalised to lower-case words without signs, with the spelling `licence` folded into `license`. A passage is a
line, a run of words whose bigrams occur in templates with no more than GAP other words between, or within such a run the
part that a single template spans in the same way, so that neighbouring notices are told apart. A passage with n distinct
bigrams can reach THRESHOLD = t only with templates of t/(2-t)*n to (2-t)/t*n bigrams, so templates, sorted by size, are cut
to that range first, and a run is held against a single template only if it has t/(2-t) of its bigrams; the rest are scored
exactly. Of passages that overlap by half or more only the best counts. Every line and run of every text is looked at.

Defined results: null or empty texts, and texts of one word, hold no licence; equal scores go to the larger template, then
to the first licence in order of name; a very long text is looked at whole, with memory of a small multiple of its bytes;
repeated rows get the same answer each; an empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rankloom.llm.common import Words, pieces, ready, utf8

THRESHOLD, GAP = 0.8, 4

# Names of licences, and the standard notices of all but the CC licences.
NAMES = {
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "Apache-2.0": ["the Apache License, Version 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0-1.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "EPL-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "GPL-3.0"],
    "ISC": ["the ISC License"],
    "LGPL-2.1": ["the GNU Lesser General Public License, version 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "MIT": ["the MIT License"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "MPL-2.0"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License"],
}
NOTICES = {
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
        OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
        OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at https://www.eclipse.org/legal/epl-2.0/""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
        This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors
        of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication
        for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to
        be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
        but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
        the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
        "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}
PHRASES = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This software is licensed under {}", "SPDX-License-Identifier: {}"]
CC_TERMS, CC_VERSIONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"], ["2.0", "3.0", "4.0"]


@functools.cache
def templates() -> tuple[tuple[str, str], ...]:
    """(licence, text) of every template; the short notices follow from names and phrases."""
    names = NAMES | {f"CC-{t}-{v}": [f"CC {t} {v}", f"CC-{t}-{v}"] for t in CC_TERMS for v in CC_VERSIONS}
    short = {(lic, p.format(n)) for lic, ns in names.items() for n in ns for p in PHRASES}
    return tuple(sorted(short | set(NOTICES.items())))


def _column(column: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.utf8_lower(column), "licence", "license")


class Index:
    """Bigram sets of the templates in order of size."""

    def __init__(self, rows: tuple[tuple[str, str], ...]):
        text = Words(_column(pa.array([r[1] for r in rows], pa.large_string())), plain=True)
        grams, at = text.grams(2)
        sets = [frozenset(grams[text.doc[at] == i].tolist()) for i in range(len(rows))]
        order = sorted(range(len(rows)), key=lambda i: (len(sets[i]), rows[i]))
        self.names, self.sets = [rows[i][0] for i in order], [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.all = np.unique(np.array([g for s in self.sets for g in s], np.uint64))
        self.holders: dict[int, list[int]] = {}
        for k, own in enumerate(self.sets):
            for g in own:
                self.holders.setdefault(g, []).append(k)

    def spans(self, at: np.ndarray, grams: list[int], threshold: float, gap: int) -> set[tuple[int, int]]:
        """(first, end) bigram places that a single template spans within a run of hits at the places `at`."""
        kinds = set(grams)
        least = threshold / (2 - threshold)
        if len(kinds) < least * self.sizes[0]:
            return set()
        count = Counter(k for g in kinds for k in self.holders[g])
        out = set()
        for k, n in count.items():
            if n >= least * self.sizes[k] - 1e-9:
                own = at[[g in self.sets[k] for g in grams]]
                cut = np.flatnonzero(np.r_[True, own[1:] - own[:-1] > gap, True])
                out |= {(int(own[a]), int(own[b - 1]) + 1) for a, b in zip(cut[:-1], cut[1:], strict=True)}
        return out

    def best(self, grams: frozenset[int], threshold: float) -> tuple[float, int, str] | None:
        """(score, template size, licence) of the nearest template within the size bounds, if it reaches the threshold."""
        n = len(grams)
        low = np.searchsorted(self.sizes, threshold / (2 - threshold) * n - 1e-9)
        high = np.searchsorted(self.sizes, (2 - threshold) / threshold * n + 1e-9, "right")
        found = None
        for k in range(int(low), int(high)):
            own = self.sets[k]
            score = 2 * len(grams & own) / (n + len(own))
            if score >= threshold and (found is None or (score, len(own)) > found[:2] or ((score, len(own)) == found[:2] and self.names[k] < found[2])):
                found = (score, len(own), self.names[k])
        return found


@functools.lru_cache(2)
def index_of(rows: tuple[tuple[str, str], ...]) -> Index:
    return Index(rows)


def passages(hit: np.ndarray, line: np.ndarray, gap: int = GAP) -> set[tuple[int, int]]:
    """(first, end) bigram places: runs of hits no more than `gap` words apart, and whole lines that hold a hit."""
    if not len(hit):
        return set()
    cut = np.flatnonzero(np.r_[True, hit[1:] - hit[:-1] > gap])
    out = {(int(hit[a]), int(hit[b - 1]) + 1) for a, b in zip(cut, np.r_[cut[1:], len(hit)], strict=True)}
    starts = np.r_[np.flatnonzero(np.r_[True, line[1:] != line[:-1]]), len(line)]
    own = np.unique(np.searchsorted(starts, hit, "right") - 1)
    return out | {(int(starts[i]), int(starts[i + 1]) - 1) for i in own if starts[i + 1] - 1 > starts[i]}


def scan(docs: DataFrame, rows: tuple[tuple[str, str], ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice (of the best passage; null if there is none) and licences (all found, sorted)."""
    rows = rows or templates()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(rows)
        for batch in pieces(batches, "text"):
            text = Words(_column(batch.column("text")), plain=True)
            raw = np.flatnonzero(utf8(_column(batch.column("text")))[0] == 10)
            line_of = np.searchsorted(raw, text.start)
            grams, at = text.grams(2)
            near = np.minimum(np.searchsorted(index.all, grams), len(index.all) - 1)
            hits = at[index.all[near] == grams]
            by_word = np.zeros(len(text) + 1, np.uint64)
            by_word[at] = grams
            licence, dice, every = [None] * batch.num_rows, [None] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            doc = text.doc[hits]
            for d in np.unique(doc).tolist():
                first, last = int(text.first[d]), int(text.first[d + 1])
                own = hits[doc == d] - first
                spans = passages(own, line_of[first:last])
                cut = np.flatnonzero(np.r_[True, own[1:] - own[:-1] > GAP, True])
                for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    spans |= index.spans(own[x:y], by_word[first + own[x:y]].tolist(), threshold, GAP)
                found = []
                for a, b in spans:
                    got = index.best(frozenset(by_word[first + a : first + b].tolist()), threshold)
                    if got:
                        found.append((-got[0], -got[1], got[2], a, b))
                taken: list[tuple[int, int]] = []
                for score, _, name, a, b in sorted(found):
                    if all(2 * (min(b, y) - max(a, x)) < min(b - a, y - x) for x, y in taken):
                        taken.append((a, b))
                        every[d] = sorted({*every[d], name})
                        if licence[d] is None:
                            licence[d], dice[d] = name, -score
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(licence, pa.string()), pa.array(dice, pa.float64()), pa.array(every, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "licence", "dice", "licences"])

    ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, licence string, dice double, licences array<string>")
