"""License notices in whole texts by conditional compression.

Candidate blocks are the words around each cue, on either side as many as the
longest notice may span, across line ends; those that overlap are one block. In
a block every template is looked for at every word: where a window holds enough
of its words, the longest common subsequence decides, and at least COVER of the
template's words must be there in order. The words that differ must not be
those that tell licenses apart (names, versions, BY, SA, NC, ND). What is found
is compressed alone and with its template as a raw zstandard dictionary. Of
those that overlap the one with most common words less differing ones stays,
then that with most bytes saved: ranks order the work and exclude no template.
A notice without differing words is exact.

Null and empty texts have no notice. Rows that repeat give the same rows again.
Positions count code points, ends are exclusive. An empty table gives an empty
one. Texts are read whole; work grows in proportion to a block's length.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVER = 0.8
_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_WARRANTY_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GRANT_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_CLAUSES_BSD = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_CLAUSE_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_GRANT_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_WARRANTY_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_HEADER_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} Public License for more details."""
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_SPDX = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0
CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later
MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA ODbL-1.0 OFL-1.1 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL Zlib""".split()
#: (SPDX identifier, notice): identifier lines, sentences, headers and whole short licenses; an identifier may have several.
TEMPLATES = (
    *((x, f"SPDX-License-Identifier: {x}") for x in _SPDX),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
    See the License for the specific language governing permissions and limitations under the License."""),
    *((x, f"{how} under the {name} License.") for how in ("Released", "Licensed") for x, name in (("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"))),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", f"{_GRANT_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY_MIT}"),
    ("MIT-0", f"{_GRANT_MIT}. {_WARRANTY_MIT}"),
    ("BSD-2-Clause", _GRANT_BSD),
    ("BSD-2-Clause", f"{_GRANT_BSD} 1. {_CLAUSES_BSD} {_WARRANTY_BSD}"),
    ("BSD-3-Clause", f"{_GRANT_BSD} 1. {_CLAUSES_BSD} {_CLAUSE_3} {_WARRANTY_BSD}"),
    ("ISC", f"{_GRANT_ISC}."),
    ("ISC", f"{_GRANT_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_WARRANTY_ISC}"),
    ("0BSD", f"{_GRANT_ISC}. {_WARRANTY_ISC}"),
    *((f"{x}-{n}", f"{how} licensed under the GNU {kind} Public License, version {n.removesuffix('.0')}.") for how in ("This work is", "This program is") for x, kind, n in (("GPL", "General", "2.0"), ("GPL", "General", "3.0"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3.0"), ("AGPL", "Affero General", "3.0"))),
    *((f"{x}-{n}-or-later", _HEADER_GPL.format(kind, n.removesuffix(".0"))) for x, kind, n in (("GPL", "General", "2.0"), ("GPL", "General", "3.0"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3.0"), ("AGPL", "Affero General", "3.0"))),
    *((f"GPL-{n}.0", f"This program is free software under the terms of the GNU General Public License, version {n}.") for n in (2, 3)),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    *((f"{x}-3.0", f"Licensed under the GNU {kind} General Public License, version 3.") for x, kind in (("LGPL", "Lesser"), ("AGPL", "Affero"))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    *((f"CC-{x}-{v}", f"Licensed under CC {x} {v}.") for x in _CC for v in ("2.0", "2.5", "3.0", "4.0")),
    *((f"CC-{x}-{v}", f"This work is licensed under a Creative Commons {name} {v} {kind} License.") for x, name in _CC.items() for v, kind in (("3.0", "Unported"), ("4.0", "International"))),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright, under CC0 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
    for any purpose, commercial or non-commercial, and by any means."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
    software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
    wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
    misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE, Version 2, December 2004"),
    ("proprietary", "All rights reserved."),
)
#: Words that tell licenses apart: where a notice has another one, or lacks one, it isn't the template's license.
KEYS = frozenset(
    """mit mit-0 isc bsd 2-clause 3-clause 4-clause apache gnu lesser library affero mozilla mpl eclipse epl boost zlib cc cc0 by by-sa by-nc by-nd by-nc-sa by-nc-nd unported international attribution attribution-sharealike
    attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike attribution-noncommercial-noderivatives gpl lgpl agpl artistic python postgresql later no not""".split()
)
#: Up to so many words, numbers tell versions apart too; longer notices number their clauses.
SHORT = 110
#: The words of a cue may stand apart by anything but ASCII letters and digits: line ends, comment marks.
CUES = r"(?i)licen[sc]e|copyright|all_rights_reserved|redistribution|permission_(is|to_use)|public_domain|creative_commons|\bCC0?_(BY|1)|SPDX-".replace("_", "[^A-Za-z0-9]+")
_CUE = re.compile(CUES)
_WORD = re.compile(r"[^\s]+")


def _plain(word: str) -> str:
    return word.lower().strip(".,;:!?()\"'") or word


def _tells(word: str, short: bool) -> bool:
    return word in KEYS or short and any(c.isdigit() for c in word)


class Scanner:
    """Templates ready to compress with; made once in each worker."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.templates = []
        self.code: dict[str, int] = {}
        for name, text in templates:
            d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            want = [_plain(w) for w in text.split()]
            mask: dict[int, int] = {}  # bit p: the template's word p
            for p, w in enumerate(want):
                c = self.code.setdefault(w, len(self.code))
                mask[c] = mask.get(c, 0) | 1 << p
            self.templates.append((name, want, mask, zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)))
        #: Words a notice may span, and words of the template it must hold.
        self.width = [len(t[1]) + 2 * (len(t[1]) // 4) for t in self.templates]
        self.need = [math.ceil(COVER * len(t[1])) for t in self.templates]
        #: The codes that must occur as often as in the template, and how often.
        self.must = [[(self.code[w], n) for w, n in Counter(t[1]).items() if _tells(w, len(t[1]) <= SHORT)] for t in self.templates]
        self.member = np.zeros((len(self.code) + 1, len(self.templates)), np.int32)  # the last row: no template's word
        for k, t in enumerate(self.templates):
            self.member[list(t[2]), k] = 1
        self.align = functools.lru_cache(100_000)(self._align)

    def _align(self, k: int, own: tuple[str, ...]) -> tuple[int, str, bool]:
        """(differing words, differences, whether they leave the license the template's)."""
        want, differ, how, same = self.templates[k][1], 0, [], True
        for t, p, q, u, v in difflib.SequenceMatcher(None, want, own, autojunk=False).get_opcodes():
            if t == "equal":
                continue
            x, y = want[p:q], own[u:v]
            differ += max(len(x), len(y))
            how.append(f"{' '.join(x)} -> {' '.join(y)}")
            short = len(want) <= SHORT
            same &= not any(_tells(w, short) for w in x) and not any(_tells(w, short and t == "replace") for w in y)
        return differ, "; ".join(how), same

    def saved(self, k: int, own: str) -> int:
        """Bytes that template k saves as a dictionary."""
        b = own.encode("utf-8", "replace")
        return len(self.alone.compress(b)) - len(self.templates[k][3].compress(b))

    def places(self, words: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(template, start, end, words in order) of each stretch that holds enough of a template.

        For each start and number of words, the least end.
        """
        n = len(words)
        code = np.array([self.code.get(w, -1) for w in words], np.int64)
        run = np.zeros((n + 1, len(self.templates)), np.int32)
        np.cumsum(self.member[code], axis=0, out=run[1:])
        at = np.arange(n)
        many = {c: np.concatenate([[0], np.cumsum(code == c)]) for must in self.must for c, _ in must} if n else {}
        for k, (_, want, mask, _) in enumerate(self.templates):
            width, need, full = self.width[k], self.need[k], (1 << len(want)) - 1
            stop = np.minimum(at + width, n)
            ok = (run[stop, k] - run[:-1, k] >= need) & (self.member[code, k] > 0)
            if not ok.any():
                continue
            for c, times in self.must[k]:
                ok &= many[c][stop] - many[c][:-1] >= times
            for s in np.flatnonzero(ok).tolist():
                v, most = full, need - 1  # the zeros of v count the longest common subsequence so far
                for e in range(s, min(s + width, n)):
                    m = mask.get(int(code[e]))
                    if m:
                        u = v & m
                        v = ((v + u) | (v - u)) & full
                        same = len(want) - v.bit_count()
                        if same > most:
                            most = same
                            yield k, s, e + 1, same

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, str]]:
        """(license, start, end, bytes saved, words that differ, differences) of each notice."""
        out = []
        if not text or not _CUE.search(text):
            return out
        spans = [m.span() for m in _WORD.finditer(text)]
        starts, ends = [s for s, _ in spans], [e for _, e in spans]
        blocks: list[list[int]] = []
        for m in _CUE.finditer(text):
            i = max(0, bisect.bisect_right(ends, m.start()) - max(self.width))
            j = min(len(spans), bisect.bisect_left(starts, m.end()) + max(self.width))
            if blocks and i <= blocks[-1][1]:
                blocks[-1][1] = j
            else:
                blocks.append([i, j])
        for i, j in blocks:
            out += self._notices(text, spans[i:j])
        return out

    def _notices(self, text: str, spans: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int, str]]:
        words = [_plain(text[s:e]) for s, e in spans]
        # at first with the least number of words that can differ; what comes up is aligned and goes back with its rank
        queue = []
        for k, s, e, same in self.places(words):
            name, want = self.templates[k][:2]
            queue.append((max(len(want), e - s) - 2 * same, -math.inf, name, s, e, k, same, ()))
        heapq.heapify(queue)
        free, found = np.ones(len(words), bool), []
        while queue:
            _, saved, name, s, e, k, same, aligned = heapq.heappop(queue)
            if not free[s:e].all():
                continue
            if aligned:
                free[s:e] = False
                found.append((name, spans[s][0], spans[e - 1][1], -saved, *aligned))
                continue
            differ, how, ok = self.align(k, tuple(words[s:e]))
            if ok:
                heapq.heappush(queue, (differ - same, -self.saved(k, text[spans[s][0] : spans[e - 1][1]]), name, s, e, k, same, (differ, how)))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, license, start, end, saved_bytes, differing_words, differences, exact of each notice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            row, rows = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for r in scanner.scan(text):
                    row.append(i)
                    rows.append(r)
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(cols[0], pa.string()), *(pa.array(cols[k], pa.int64()) for k in (1, 2, 3, 4)), pa.array(cols[5], pa.string()), pa.array([x == 0 for x in cols[4]], pa.bool_())],
                ["doc_id", "license", "start", "end", "saved_bytes", "differing_words", "differences", "exact"],
            )

    # the same cues decide here which texts go to Python at all
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CUES)).mapInArrow(run, "doc_id long, license string, start long, `end` long, saved_bytes long, differing_words long, differences string, exact boolean")
