"""Licence scan: Dice coefficient over word bigrams between text and licence templates.

Text and templates are lower-cased runs of letters and digits. A template is compared with
every line of a text and with every window of the template's own length (a shorter text is
one window), both as multisets of word bigrams; a Dice coefficient of ``LEAST`` or more is a match, the best place of each
licence is reported. Two sets of sizes n and m have a Dice coefficient of at most
``2 min(n, m) / (n + m)``, so a line is compared only with templates of fitting size, and a
window only where enough of the template's bigrams lie close together. Templates are a
small fixed table sent to the executors; nothing is shuffled. They are whole texts of licences
of up to a page, and of longer ones the notices by which works point to them.

Defined results: a null or empty text matches nothing; repeated rows give repeated results;
ties go to the first place; ids may be of any type; a very long text is compared whole; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .op3_decontaminate import WORD
from .shared import map_arrow, read_table

LEAST = 0.8

#: Conditions and disclaimers that several licences share word for word.
_NOTICE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

#: Whole texts of licences of up to a page.
TEXTS = (
    ("MIT", f"{_MIT} {_MIT_END}"),
    ("BSD-2-Clause", f"{_BSD} 1. {_NOTICE} 2. {_BINARY} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} 1. {_NOTICE} 2. {_BINARY} 3. {_NAMES} {_BSD_END}"),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"{_ISC}. {_ISC_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
     "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
     "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
)

#: Opening passages and the notices by which works point to a licence; of longer licences these alone.
NOTICES = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", _BSD),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("all-rights-reserved", "All rights reserved."),
)
#: Names of licences as files state them in one line.
SPDX = ("MIT", "Apache-2.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-2.0-only", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "Unlicense", "Zlib", "BSL-1.0")
TEMPLATES = TEXTS + NOTICES + tuple((name.removesuffix("-or-later").removesuffix("-only"), f"SPDX-License-Identifier: {name}") for name in SPDX)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the first word of each text, and each word's line within the piece."""
    low = tk.LOWER[data]
    start, end, first = tk.word_spans(low, offsets, WORD)
    return tk.span_hash(low, start, end), first, np.searchsorted(np.flatnonzero(data == 10), start)


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least, self.names = least, [n for n, _ in templates]
        self.pairs = []
        for _, text in templates:
            data = np.frombuffer(text.encode(), np.uint8)
            words, _, _ = words_of(data, np.array([0, len(data)]))
            self.pairs.append(Counter(tk.ngram_hash(words, 2).tolist()))
        self.size = [sum(p.values()) for p in self.pairs]
        self.known = np.unique(np.array([h for p in self.pairs for h in p], np.uint64))
        self.with_pair: dict[int, list[int]] = {}
        for i, p in enumerate(self.pairs):
            for h in p:
                self.with_pair.setdefault(h, []).append(i)

    def dice(self, pairs: np.ndarray, template: int) -> float:
        total = len(pairs) + self.size[template]
        return 2 * sum((Counter(pairs.tolist()) & self.pairs[template]).values()) / total if total else 0.0

    def sliding(self, pairs: np.ndarray, template: int, starts: list[int], window: int) -> Iterator[tuple[int, float]]:
        """Each start with its window's coefficient; a window that overlaps the one before changes its counts by what leaves and what comes."""
        wanted, total = self.pairs[template], window + self.size[template]
        have: Counter[int] = Counter()
        common, low, high = 0, 0, 0
        for a in starts:
            if a >= high:
                have.clear()
                common, low, high = 0, a, a
            for h in pairs[low:a].tolist():
                if h in wanted:
                    have[h] -= 1
                    common -= have[h] < wanted[h]
            for h in pairs[high : a + window].tolist():
                if h in wanted:
                    have[h] += 1
                    common += have[h] <= wanted[h]
            low, high = a, a + window
            yield a, 2 * common / total if total else 0.0

    def match(self, words: np.ndarray, line: np.ndarray) -> list[tuple[str, float, int, int]]:
        """Licence, Dice coefficient, first word and words of the best place of each licence in one text."""
        best: dict[str, tuple[float, int, int]] = {}
        pairs = tk.ngram_hash(words, 2)
        hits: dict[int, list[int]] = {}
        at = np.minimum(np.searchsorted(self.known, pairs), len(self.known) - 1)
        for p in np.flatnonzero(self.known[at] == pairs):
            for t in self.with_pair[int(pairs[p])]:
                hits.setdefault(t, []).append(int(p))

        def found(t: int, a: int, b: int, d: float) -> None:
            old = best.get(self.names[t])
            if d >= self.least and (old is None or (d, -a) > (old[0], -old[1])):
                best[self.names[t]] = (d, a, b - a)

        for t, places in sorted(hits.items()):
            size = self.size[t]
            # Of a text shorter than the template all is one window.
            window = min(size, len(pairs))
            need = int(np.ceil(self.least * (window + size) / 2 - 1e-9))
            at = np.array(places)
            # Lines with enough of the template's bigrams for their length.
            row, hit = np.unique(line[at], return_counts=True)
            begin, end = np.searchsorted(line, row), np.searchsorted(line, row, "right")
            fit = 2 * np.minimum(np.minimum(hit, end - begin - 1), size) >= self.least * (end - begin - 1 + size) - 1e-9
            for a, b in zip(begin[fit].tolist(), end[fit].tolist(), strict=True):
                found(t, a, b, self.dice(pairs[a : b - 1], t))
            starts: set[int] = set()
            for j in np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < window).tolist() if len(at) >= need else []:
                low = max(0, places[j + need - 1] - window + 1)
                starts.update(range(low, min(places[j], len(pairs) - window) + 1))
            for a, d in self.sliding(pairs, t, sorted(starts), window):
                found(t, a, a + window + 1, d)
        return [(name, *x) for name, x in sorted(best.items())]


def scan_licenses(docs: DataFrame, text: str = "text", id_: str = "doc_id", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``doc_id, license, dice, first_word, n_words``: the best place of each licence found in a document."""
    table = Templates(templates, least)
    narrow = docs.select(F.col(id_).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = f"doc_id {narrow.schema[0].dataType.simpleString()}, license string, dice double, first_word bigint, n_words bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, _, data, offsets in tk.chunks(batch.column(1)):
                words, first, line = words_of(data, offsets)
                pairs = tk.ngram_hash(words, 2)
                at = np.minimum(np.searchsorted(table.known, pairs), len(table.known) - 1)
                hit = np.flatnonzero(table.known[at] == pairs)
                for r in np.unique(np.searchsorted(first, hit, "right") - 1):
                    a, b = first[r], first[r + 1]
                    found.extend((int(lo + r), *m) for m in table.match(words[a:b], line[a:b]))
            if found:
                rows, name, dice, start, size = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(name), pa.array(dice, pa.float64()), pa.array(start, pa.int64()), pa.array(size, pa.int64())],
                    names=["doc_id", "license", "dice", "first_word", "n_words"],
                )

    return map_arrow(narrow, run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
