"""Licence scans: normalised text compared to licence templates by Dice coefficient over word bigrams.

A candidate is a window of consecutive words, whatever lines they lie in, or on request of whole lines. Both sides are
lower-cased and cut into words of letters, digits and dots inside numbers; word bigrams count with repeats, those
across a line end too. Dice d of sizes a and b is at most 2 min(a, b) / (a + b), so a window of a bigrams is compared
only to templates with b between a * t / (2 - t) and a * (2 - t) / t. Windows of words start and end at a bigram of the
template, windows of lines at lines that a bigram of some template touches, which loses nothing: what shares none only
lowers Dice. A window that reaches t holds at least b * t / (2 - t) places of the template's bigrams, so other starts
are passed over. Texts are read once, whole, without a shuffle; templates are a fixed table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, tuned

THRESHOLD = 0.9
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# Public licence texts and notices.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "GPL-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program; if not, write to the
Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "LGPL-3.0-header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General
Public License for more details. You should have received a copy of the GNU Lesser General Public License along with
this library. If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General
Public License for more details. You should have received a copy of the GNU Affero General Public License along with
this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works
of the Software, unless such copies or derivative works are solely in the form of machine-executable object code
generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "CC0-1.0-notice": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this
work.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
}


def bigrams(text: str) -> Counter:
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.t = threshold
        self.templates = [(name, grams, grams.total()) for name, text in sorted(templates.items()) if (grams := bigrams(text))]
        self.most = max((n for *_, n in self.templates), default=0) * (2 - threshold) / threshold
        self.follow: dict[str, dict[str, list[int]]] = {}  # first word, second word: numbers of the templates
        for at, (_, grams, _) in enumerate(self.templates):
            for a, b in grams:
                self.follow.setdefault(a, {}).setdefault(b, []).append(at)

    def known(self, words: list[str]) -> list[int]:
        """Places of the bigrams that some template has."""
        follow = self.follow
        return [i for i, w in enumerate(words[:-1]) if w in follow and words[i + 1] in follow[w]]

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, best dice, first line, last line) of every template that a window of words matches."""
        text = text.lower()
        words = _WORD.findall(text)
        places: dict[int, list[int]] = {}
        for i in self.known(words):
            for at in self.follow[words[i]][words[i + 1]]:
                places.setdefault(at, []).append(i)
        found = []
        for at, on in sorted(places.items()):
            name, want, n = self.templates[at]
            least, most = max(1, math.ceil(n * self.t / (2 - self.t) - 1e-9)), n * (2 - self.t) / self.t
            best = (0.0, 0, 0)
            for i in range(len(on) - least + 1):
                if on[i + least - 1] - on[i] >= most:
                    continue
                left, shared = dict(want), 0
                for j in range(i, len(on)):
                    size = on[j] - on[i] + 1
                    if size > most:
                        break
                    gram = words[on[j]], words[on[j] + 1]
                    if left[gram]:
                        left[gram] -= 1
                        shared += 1
                        d = 2 * shared / (size + n)
                        if d >= self.t and d > best[0]:
                            best = d, on[i], on[j] + 1
                if best[0] == 1:
                    break
            if best[0]:
                found.append((name, *best))
        if not found:
            return []
        spots = [m.start() for m in _WORD.finditer(text)]
        return [(name, d, text.count("\n", 0, spots[a]), text.count("\n", 0, spots[b])) for name, d, a, b in found]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, best dice, first line, last line) of every template that a window of whole lines matches."""
        lines = text.lower().split("\n")
        stream = [(w, i) for i, line in enumerate(lines) for w in _WORD.findall(line)]
        marked = {stream[k][1] for i in self.known([w for w, _ in stream]) for k in (i, i + 1)}
        hits = sorted(marked)
        best: dict[str, tuple[float, int, int]] = {}
        for i in hits:
            words: list[str] = []
            for j in range(i, len(lines)):
                words += _WORD.findall(lines[j])
                size = len(words) - 1
                if size > self.most:
                    break
                if j not in marked:
                    continue
                grams = None
                for name, want, n in self.templates:
                    if not n * self.t / (2 - self.t) <= size <= n * (2 - self.t) / self.t:
                        continue
                    grams = grams or Counter(zip(words, words[1:], strict=False))
                    d = dice(grams, want)
                    if d >= self.t and (name not in best or d > best[name][0]):
                        best[name] = (d, i, j)
        return [(name, *found) for name, found in sorted(best.items())]


def scan_licences(docs: DataFrame, key: str = "doc_id", text: str = "text", *, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, whole_lines: bool = True) -> DataFrame:
    """(key, licence, dice, first_line, last_line): the best window, first on ties, of every template matched.

    Windows are of whole lines, or with ``whole_lines=False`` of words: then a statement that shares its lines with
    other words is found as well, and the lines are those it lies in. Lines count from 0. Null and empty texts match
    nothing; long texts are scanned whole; repeated rows each report; an empty table gives no rows. Other columns,
    whatever their names, are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    shared = docs.sparkSession.sparkContext.broadcast((TEMPLATES if templates is None else templates, threshold))
    schema = T.StructType([
        T.StructField(key, rows.schema["key"].dataType), T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()),
        T.StructField("first_line", T.IntegerType()), T.StructField("last_line", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        search = scanner.scan if whole_lines else scanner.find
        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for row in search(value):
                    at.append(i)
                    found.append(row)
            if found:
                columns = [pa.array(c, f) for c, f in zip(zip(*found, strict=True), (pa.string(), pa.float64(), pa.int32(), pa.int32()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], [key, "licence", "dice", "first_line", "last_line"])

    return rows.mapInArrow(run, schema)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, licence, dice, first_line, last_line of every document and licence template matched by a window of words.

    Edge cases as :func:`scan_licences` states.
    """
    return scan_licences(table(tuned(spark), sf_dir, "documents"), whole_lines=False)
