"""Licence scans: Dice coefficient of word bigrams against licence templates, pruned by size."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrad.llm.common import id_and_text, read_table
from loomgrad.llm.wordhash import NOT_ALPHANUMERIC, mix, pieces, run_hashes, word_hashes, word_spans

#: Least Dice coefficient of a match.
LEAST_DICE = 0.8

# Notices and short texts of public licences.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ],
    "MIT-0": [
        "SPDX-License-Identifier: MIT-0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY "
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "Apache-2.0": [
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
        "REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License v2.0.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details. You should have received a copy of the GNU General Public License along with this "
        "program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
        "02110-1301 USA.",
    ],
    "LGPL-2.1": [
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Lesser General Public License for more details.",
    ],
    "LGPL-3.0": [
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    ],
    "AGPL-3.0": [
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero "
        "General Public License for more details.",
    ],
    "GPL-3.0": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
        "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used "
        "to endorse or promote products derived from this software without specific prior written permission. THIS "
        "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING "
        "IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "0BSD": [
        "SPDX-License-Identifier: 0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "Zlib": [
        "SPDX-License-Identifier: Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any "
        "person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "(the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
        "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all "
        "subject to the following:",
    ],
    "EPL-2.0": [
        "SPDX-License-Identifier: EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "MPL-2.0": [
        "SPDX-License-Identifier: MPL-2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "all-rights-reserved": ["All rights reserved."],
}


def normalised(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; bytes above ASCII count as letters."""
    return re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode("utf-8", "replace"))


def _hashes(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), dtype=np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), NOT_ALPHANUMERIC)
    return word_hashes(raw, starts, ends, NOT_ALPHANUMERIC)


@dataclass(frozen=True)
class Template:
    licence: str
    number: int
    n_words: int
    bigrams: Counter

    @property
    def size(self) -> int:
        return self.n_words - 1


def load_templates(notices: dict[str, list[str]]) -> list[Template]:
    """Templates of at least two words, smallest first."""
    out = []
    for licence, texts in notices.items():
        for number, text in enumerate(texts):
            words = _hashes(normalised(text))
            if len(words) >= 2:
                out.append(Template(licence, number, len(words), Counter(mix(run_hashes(words, 2)).tolist())))
    return sorted(out, key=lambda t: t.size)


def dice(a: Counter, b: Counter) -> float:
    """2 |A and B| / (|A| + |B|) of two bags of bigrams."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


def size_bounds(size: int, least: float) -> tuple[int, int]:
    """Only texts of so many bigrams can reach the coefficient with a template of ``size``: at best all
    bigrams of the smaller are in the larger, and 2 min / (min + max) has to be at least ``least``."""
    return int(np.ceil(size * least / (2 - least) - 1e-9)), int(np.floor(size * (2 - least) / least + 1e-9))


class Matcher:
    """Compares every window of words of a text with all templates."""

    def __init__(self, templates: list[Template], least: float) -> None:
        self.templates, self.least = templates, least
        self.known = np.unique(np.array([g for t in templates for g in t.bigrams], dtype=np.uint64))
        self.times = np.zeros((len(templates), len(self.known)), dtype=np.int64)  # of a bigram in a template
        for row, t in enumerate(templates):
            self.times[row, np.searchsorted(self.known, np.array(list(t.bigrams), dtype=np.uint64))] = list(t.bigrams.values())
        self.within = (self.times > 0).T.astype(np.float32)
        # Shared bigrams of the smallest window that can match.
        self.need = np.array([int(np.ceil(least * (size_bounds(t.size, least)[0] + t.size) / 2 - 1e-9)) for t in templates])

    def hits(self, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number) of the bigrams that some template has."""
        number = np.minimum(np.searchsorted(self.known, bigrams), len(self.known) - 1)
        at = np.flatnonzero(self.known[number] == bigrams)
        return at, number[at]

    def best(self, at: np.ndarray, number: np.ndarray) -> dict[str, tuple[float, int, int, int]]:
        """Licence -> (coefficient, template, first word, end word) of its best match, from the hits of a text.

        Matches are chosen among all windows of words, the most similar first, so that none overlaps one chosen
        before: a notice belongs to the licence that it is most like, and another beside it is still found. A
        window begins and ends with a shared bigram. Ties: the earliest, then the shortest window, then the
        first template. The heap holds the best window of each start; one that meets a chosen match is
        searched again for what ends before that.
        """
        if len(at) < self.need.min():
            return {}
        starts: list[tuple] = []
        for row in np.flatnonzero(self.within[number].sum(axis=0) >= self.need).tolist():
            mine = self.times[row, number] > 0
            windows = _Windows(self, at[mine], number[mine], row)
            starts += [(*key, row, i, windows) for i in windows.starts if (key := windows.best(i))]
        heapify(starts)
        begins, ends, out = [], [], {}
        while starts:
            score, start, size, template, row, i, windows = heappop(starts)
            end, place = start + size + 1, bisect_right(begins, start)
            if place and ends[place - 1] > start:
                continue
            if place < len(begins) and begins[place] < end:
                if key := windows.best(i, begins[place]):
                    heappush(starts, (*key, row, i, windows))
                continue
            begins.insert(place, start)
            ends.insert(place, end)
            out.setdefault(self.templates[row].licence, (-score, template, start, end))
        return out


class _Windows:
    """The windows of a text that can match one template, by the hit that they start with."""

    def __init__(self, matcher: Matcher, at: np.ndarray, number: np.ndarray, row: int) -> None:
        self.at, self.template, self.least = at, matcher.templates[row], matcher.least
        self.low, high = size_bounds(self.template.size, self.least)
        index = np.arange(len(at))
        self.last = np.searchsorted(at, at + high, side="left") - 1  # of the windows within the size bound
        self.starts = np.flatnonzero(self.last - index + 1 >= matcher.need[row]).tolist()
        # A hit counts in a window if fewer than the template's times of its bigram come before it there:
        # ``before`` is the hit that has to lie outside.
        order = np.lexsort((index, number))
        group = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]]))
        first = np.repeat(group, np.diff(np.concatenate([group, [len(at)]])))
        back = index - matcher.times[row, number[order]]
        self.before = np.empty(len(at), dtype=np.int64)
        self.before[order] = np.where(back >= first, order[np.maximum(back, 0)], -1)

    def __lt__(self, other: _Windows) -> bool:
        return False  # keys, templates and starts tell entries of a heap apart

    def best(self, i: int, before_word: int | None = None) -> tuple[float, int, int, int] | None:
        """(-coefficient, first word, bigrams, template) of the best window from hit ``i``, that ends before a word if given."""
        j = int(self.last[i]) + 1
        if before_word is not None:
            j = min(j, int(np.searchsorted(self.at, before_word - 1)))
        if j <= i:
            return None
        size = self.at[i:j] - self.at[i] + 1
        score = 2 * np.cumsum(self.before[i:j] < i) / (size + self.template.size)
        score[size < self.low] = 0.0
        k = int(np.argmax(score))
        if score[k] < self.least - 1e-9:
            return None
        return -float(score[k]), int(self.at[i]), int(size[k]), self.template.number


def best_matches(text: str, templates: list[Template], least: float) -> dict[str, tuple[float, int, int, int]]:
    """:meth:`Matcher.best` of one text."""
    matcher, words = Matcher(templates, least), _hashes(normalised(text))
    return matcher.best(*matcher.hits(mix(run_hashes(words, 2)))) if len(words) > 1 else {}


def _scan(notices: dict[str, list[str]], least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(load_templates(notices), least)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for row, end, raw, bounds in pieces(pc.utf8_lower(batch.column(1))):
                starts, ends, doc = word_spans(raw, bounds, NOT_ALPHANUMERIC)
                if len(doc) < 2:
                    continue
                at, number = matcher.hits(mix(run_hashes(word_hashes(raw, starts, ends, NOT_ALPHANUMERIC), 2)))
                inside = doc[at] == doc[at + 1]
                at, number = at[inside], number[inside]
                text_start = np.searchsorted(doc, np.arange(end - row))
                edges = np.searchsorted(doc[at], np.arange(end - row + 1)).tolist()
                for d in range(end - row):
                    a, b = edges[d], edges[d + 1]
                    if b > a:
                        for licence, found in matcher.best(at[a:b] - text_start[d], number[a:b]).items():
                            out.append((ids[row + d], licence, *found))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "licence", "dice", "template", "start_word", "end_word"],
            )

    return scan


def scan_licences(
    docs: DataFrame,
    notices: dict[str, list[str]] | None = None,
    least_dice: float = LEAST_DICE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, licence, dice, template, start_word, end_word: the best match of each licence in each row.

    Words are lower-cased runs of letters and digits of the whole text. All windows of words within the
    size bounds are compared with the templates of ``notices`` (licence -> texts; the driver's argument,
    shipped with the tasks) as bags of word bigrams. Matches are chosen among all windows, the best first, without
    overlap. A row of ``docs`` without enough known bigrams is
    passed over after one vectorised test; nothing is shuffled.

    Null or empty texts match nothing. Repeated rows are matched alike; null ids stay null. Templates
    under two words are left out; with none, nothing matches. Other columns are ignored. No rows in,
    no rows out.
    """
    if not 0 < least_dice <= 1:
        raise ValueError("least_dice must be in (0, 1]")
    chosen = NOTICES if notices is None else notices
    schema = "doc_id long, licence string, dice double, template int, start_word long, end_word long"
    if not load_templates(chosen):
        return docs.sparkSession.createDataFrame([], schema)
    return id_and_text(docs, id_col, text_col).mapInArrow(_scan(chosen, least_dice), schema)


def op4_dice_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(read_table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))
