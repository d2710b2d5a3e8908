"""License scan by patience alignment of texts with license templates.

Words that occur once in the text and once in the template anchor the alignment; the longest
increasing subsequence of the anchors is kept, and the gaps between them are aligned again, down to
gaps without anchors, whose common ends are matched. Coverage is the share of the template's words that are
aligned in a stretch of at most twice its length. A text is aligned in overlapping windows of about one and of three template lengths, so that a license that it
holds twice is found, and only where a window holds enough of the template's words, each counted as often as
the template has it at most: an alignment matches no word more often, so that fewer can't reach the threshold.

Coverage alone doesn't tell a license from its neighbour, which may differ in one word: the words that do (versions, names, NC, ND, SA, Lesser, Affero) have to agree both
ways, and a notice of a few words needs all but its fillers, in a stretch of its own length.

All licenses of a document are returned: of the stretches found, those with the most matched words first, then by coverage and the order of the templates, as long as they
don't overlap one taken before. A user's own templates, whole license texts too, take the place of those given here.

Defined results: a null or empty text, or one without words, has no license; ``license`` is the one with the most matched words, ties go to the higher coverage and
the first template; ``first_word`` and ``last_word`` are word places of its stretch, from 0, null without a license. Very long texts are scanned whole, window by window.
Rows may repeat, each has its own result; an empty table gives an empty one; other columns are ignored; doc_id is passed through, null included.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from larder.llm.common import bound_batches

#: Coverage from which a template counts as found.
LEAST_COVERAGE = 0.8

# License notices, standard headers and short licenses, as their licensors word them.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "Released under the MIT License",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

# Words that tell licenses of one family or wording apart.
MODIFIERS = frozenset("nc nd sa noncommercial noderivatives noderivs sharealike lesser affero".split())
TELLING = MODIFIERS | frozenset("mit bsd apache mozilla isc zlib boost x11 epl eupl cddl unlicense wtfpl zero".split())
#: Words before a number that make it a version; a number with a point is one anyway.
_BEFORE_VERSION = frozenset("version v by sa nc nd attribution sharealike noncommercial noderivatives gpl lgpl agpl gplv mpl apache".split())
#: Words of a notice that may be left out or put in; templates of at most so many words are notices.
_FILLERS, NOTICE = frozenset("a an the this that is are was be work file files code project software document under terms of and or its our my".split()), 16
#: Words that a notice may be longer than its template.
LOOSE = 2

_find = re.compile(r"[^\W_]+(?:\.\d+)*").findall


def words(text: str) -> list[str]:
    return _find(text.lower())


def telling(ws: list[str]) -> list[bool]:
    """For each word whether it tells licenses apart: by itself, or as the number of a version."""
    return [w in TELLING or (w[0].isdigit() and ("." in w or (i > 0 and ws[i - 1] in _BEFORE_VERSION))) for i, w in enumerate(ws)]


def confirmed(text: list[str], template: list[str], pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The matches of a stretch that is the template's license and not its neighbour; none where it isn't.

    All telling words of the template have to be matched, and the stretch may hold no other one, nor a modifier behind it; a notice needs all its words but
    fillers, in a stretch of about its own length, without fillers that are matched far off.
    """
    if len(template) <= NOTICE:
        while len(pairs) > 1 and template[pairs[0][1]] in _FILLERS and pairs[1][0] - pairs[0][0] > LOOSE:
            pairs = pairs[1:]
        while len(pairs) > 1 and template[pairs[-1][1]] in _FILLERS and pairs[-1][0] - pairs[-2][0] > LOOSE:
            pairs = pairs[:-1]
    first, last = pairs[0][0], pairs[-1][0]
    ours, theirs = {i for i, _ in pairs}, {j for _, j in pairs}
    if any(t and j not in theirs for j, t in enumerate(telling(template))):
        return []
    if any(t and i + first not in ours for i, t in enumerate(telling(text[first : last + 1]))) or text[last + 1 : last + 2] and text[last + 1] in MODIFIERS:
        return []
    if len(template) <= NOTICE and (last - first + 1 > len(template) + LOOSE or any(j not in theirs and w not in _FILLERS for j, w in enumerate(template))):
        return []
    return pairs


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of ``pairs``, sorted by their first places, that increases in the second."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        tops[at : at + 1], piles[at : at + 1] = [j], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo >= hi or low >= high:
            continue
        there = {w: j for w, j in zip(b[low:high], range(low, high), strict=True)}
        twice = {w for w, n in Counter(b[low:high]).items() if n > 1}
        seen = Counter(w for w in a[lo:hi] if w in there)
        anchors = increasing([(i, there[w]) for i, w in zip(range(lo, hi), a[lo:hi], strict=True) if seen.get(w) == 1 and w not in twice])
        before = (lo, low)
        for i, j in [*anchors, (hi, high)] if anchors else []:
            todo.append((before[0], i, before[1], j))
            if (i, j) != (hi, high):
                out.append((i, j))
            before = (i + 1, j + 1)
    return sorted(out)


@functools.cache
def _read(templates: tuple[tuple[str, str], ...]) -> tuple[list[tuple[str, list[str], Counter[str]]], frozenset[str]]:
    read = [(name, words(text)) for name, text in templates]
    return [(name, ws, Counter(ws)) for name, ws in read if ws], frozenset(w for _, ws in read for w in ws)


def enough(here: Counter[str], counts: Counter[str], need: float) -> bool:
    """Whether the words hold as many of the template's as an alignment has to match; what fails this can't reach the threshold."""
    return sum((here & counts).values()) >= need


def _windows(places: list[int], text: list[str], counts: Counter[str], size: int, need: float) -> Iterator[tuple[int, int]]:
    """Overlapping stretches of the text that hold enough of the template's words, each as often as the template at most."""
    # Within any of the lengths, a stretch shorter by a step lies whole in one window.
    for length, step in ((size + size // 4, max(1, size // 4)), (3 * size, size)):
        last = None
        for place in places:
            lo = place // step * step
            if lo == last:
                continue
            last = lo
            inside = places[bisect.bisect_left(places, lo) : bisect.bisect_left(places, lo + length)]
            if enough(Counter(text[i] for i in inside), counts, need):
                yield inside[0], inside[-1] + 1


def _stretches(pairs: list[tuple[int, int]], size: int, need: float) -> Iterator[tuple[int, int, int]]:
    """(matched words, first place, last place) of the best runs of matches no longer than twice the template, none over another."""
    runs, end = [], 0
    for start in range(len(pairs)):
        while end < len(pairs) and pairs[end][0] - pairs[start][0] < 2 * size:
            end += 1
        if end - start >= need:
            runs.append((end - start, pairs[start][0], pairs[end - 1][0]))
    taken: list[tuple[int, int, int]] = []
    for run in sorted(runs, key=lambda r: (-r[0], r[2] - r[1], r[1])):
        if all(run[2] < t[1] or run[1] > t[2] for t in taken):
            taken.append(run)
    yield from taken


Found = tuple[str, float, int, int]


def all_licenses(text: str | None, least: float = LEAST_COVERAGE, templates: dict[str, str] = TEMPLATES) -> list[Found]:
    """(name, coverage, first word, last word) of each license of a text, in the order of their places."""
    read, every = _read(tuple(templates.items()))
    ws = words(text or "")
    known = Counter(w for w in ws if w in every)
    runs: set[tuple[int, float, int, int, int]] = set()
    for order, (_, template, counts) in enumerate(read):
        need = least * len(template) - 1e-9
        if not enough(known, counts, need):
            continue
        for lo, hi in _windows([i for i, w in enumerate(ws) if w in counts], ws, counts, len(template), need):
            pairs = [(lo + i, j) for i, j in aligned(ws[lo:hi], template)]
            for _, first, last in _stretches(pairs, len(template), need):
                if kept := confirmed(ws, template, [x for x in pairs if first <= x[0] <= last]):
                    runs.add((-len(kept), -len(kept) / len(template), order, kept[0][0], kept[-1][0]))
    taken: list[Found] = []
    for _, cover, order, first, last in sorted(runs):
        if all(last < t[2] or first > t[3] for t in taken):
            taken.append((read[order][0], -cover, first, last))
    return sorted(taken, key=lambda t: t[2])


def best_license(text: str | None, least: float = LEAST_COVERAGE, templates: dict[str, str] = TEMPLATES) -> tuple[str | None, float, int | None, int | None]:
    """(name, coverage, first word, last word) of the license with the most matched words."""
    return _best(all_licenses(text, least, templates), templates)


def _best(found: list[Found], templates: dict[str, str]) -> tuple[str | None, float, int | None, int | None]:
    sizes = {name: len(ws) for name, ws, _ in _read(tuple(templates.items()))[0]}
    return min(found, key=lambda t: (-round(t[1] * sizes[t[0]]), -t[1], list(sizes).index(t[0]), t[2]), default=(None, 0.0, None, None))


_LICENSE = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def _scanned(least: float, templates: dict[str, str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_licenses(t, least, templates) for t in batch.column(1).to_pylist()]
            best = [_best(f, templates) for f in found]
            columns = list(zip(*best, strict=True)) if best else [()] * 4
            listed = pa.array([[dict(zip(_LICENSE.names, x, strict=True)) for x in f] for f in found], pa.list_(_LICENSE))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t.type) for c, t in zip(columns, _LICENSE, strict=True)), listed], ["doc_id", *_LICENSE.names, "licenses"])

    return run


def license_scan(docs: DataFrame, least: float = LEAST_COVERAGE, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word, and licenses with these four of each, for every row of ``docs`` (doc_id, text)."""
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    one = "license string, coverage double, first_word long, last_word long"
    each = one.replace(" string", ":string").replace(" double", ":double").replace(" long", ":long")
    return docs.mapInArrow(_scanned(least, templates or TEMPLATES), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {one}, licenses array<struct<{each}>>")
