"""License scans: matching statistics against a generalised suffix automaton of license words.

All templates go into one automaton, through which a text streams once. Where it
meets a run of template words, the templates that hold the run are looked at one
by one: their own matching statistics give their longest matches, each with all
places where it stands in the template, and matches that go on in the template
are chained into spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from geospan.llm.common import map_texts

# Phrases of the base rule, and published license notices; of long licenses the notice that files carry.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details. You should have received a copy of the GNU {} along with this program. If not, see <https://www.gnu.org/licenses/>."""
TEMPLATES = {
    "mit": (
        "Released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """
        + _AS_IS
        + """, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", _GNU.format(*["General Public License"] * 3)),
    "lgpl": (
        _GNU.replace("program", "library").format(*["Lesser General Public License"] * 3),
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "agpl": (_GNU.format(*["Affero General Public License"] * 3),),
    "bsd": (_BSD_TWO + _BSD_END, _BSD_TWO + _BSD_THREE + _BSD_END, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "cc": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
}
#: Least words of a match, most template words that a chain may skip between two matches, and the least covered share of a template for a label.
LONG, SKIP, SHARE = 4, 12, 0.6

_CLEAN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_CLEAN).split()


class SuffixAutomaton:
    """A generalised suffix automaton over word sequences; each state knows where its strings end in each sequence (exclusive): the first place, and all."""

    def __init__(self, sequences: Iterable[list[bytes]]):
        self.sequences = [list(s) for s in sequences]
        self.to: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        self.places: list[dict[int, list[int]]] = [{}]
        for number, sequence in enumerate(self.sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                state = last
                while state > 0:
                    self.ends[state].setdefault(number, at + 1)
                    self.places[state].setdefault(number, []).append(at + 1)
                    state = self.link[state]
        self.words = {word for sequence in self.sequences for word in sequence}

    def _add(self, size: int, to: dict[bytes, int], link: int, ends: dict[int, int], places: dict[int, list[int]]) -> int:
        self.size.append(size)
        self.to.append(to)
        self.link.append(link)
        self.ends.append(ends)
        self.places.append(places)
        return len(self.size) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state for the strings of q that p reaches."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._add(self.size[p] + 1, dict(self.to[q]), self.link[q], dict(self.ends[q]), {n: list(at) for n, at in self.places[q].items()})
        self.link[q] = copy
        while p >= 0 and self.to[p].get(word) == q:
            self.to[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.to[last]:
            return self._split(last, word, self.to[last][word])
        new = self._add(self.size[last] + 1, {}, 0, {}, {})
        p = last
        while p >= 0 and word not in self.to[p]:
            self.to[p][word] = new
            p = self.link[p]
        self.link[new] = self._split(p, word, self.to[p][word]) if p >= 0 else 0
        return new

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """The matching statistics: after each word the length of the longest run that ends there and is in a sequence, and its state."""
        state, length, to, link, size, known = 0, 0, self.to, self.link, self.size, self.words
        for word in words:
            if word not in known:
                state = length = 0
            else:
                while word not in to[state]:
                    state = link[state]
                    length = size[state]
                state = to[state][word]
                length += 1
            yield length, state

    def matches(self, words: list[bytes], long: int = LONG) -> list[tuple[int, int, int]]:
        """``(end, length, state)`` of each longest match of ``long`` words or more that cannot be continued."""
        found, before, held = [], 0, 0
        for at, (length, state) in enumerate(self.statistics(words)):
            if before >= long and length <= before:
                found.append((at, before, held))
            before, held = length, state
        if before >= long:
            found.append((len(words), before, held))
        return found


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] | None = None, phrases: dict[str, str] | None = None):
        self.templates = TEMPLATES if templates is None else templates
        self.phrases = [(tuple(p.encode().split()), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        pairs = [(label, words_of(text)) for label, texts in sorted(self.templates.items()) for text in texts]
        self.labels = [label for label, _ in pairs]
        self.automaton = SuffixAutomaton(words for _, words in pairs)
        self.alone = [SuffixAutomaton([words]) for _, words in pairs]
        self.lasts = {words[-1] for words, _ in self.phrases}

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        """``(start, label)`` of each place of a base phrase."""
        if not any(last in words for last in self.lasts):
            return []
        found = []
        for phrase, label in self.phrases:
            at = -1
            try:
                while True:
                    at = words.index(phrase[-1], at + 1)
                    start = at + 1 - len(phrase)
                    if start >= 0 and tuple(words[start : at + 1]) == phrase:
                        found.append((start, label))
            except ValueError:
                pass
        return found

    def met(self, words: list[bytes]) -> set[int]:
        """The templates that hold ``LONG`` words of the text in a row."""
        found, seen, automaton = set(), set(), self.automaton
        for length, state in automaton.statistics(words):
            while length >= LONG and state not in seen and automaton.size[state] >= LONG:
                seen.add(state)
                found.update(automaton.ends[state])
                state = automaton.link[state]
        return found

    def _chained(self, number: int, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Spans of one template: its longest matches in order; a chain goes on while the next match stands further on in the
        template, at most ``SKIP`` words past the last one both there and in the text; of its places there the first such counts."""
        automaton, out, chain = self.alone[number], [], None  # chain: first word, end, end in the template, covered
        label, whole = self.labels[number], len(self.alone[number].sequences[0])
        for end, length, state in automaton.matches(words):
            places, start = automaton.places[state][0], end - length
            if chain and start - chain[1] <= SKIP:
                at = next((at for at in places if at > chain[2] and chain[2] - length < at - length <= chain[2] + SKIP), None)
                if at is not None:
                    chain = (chain[0], end, at, chain[3] + at - max(at - length, chain[2]))
                    continue
            if chain:
                out.append((label, chain[0], chain[1], chain[3] / whole))
            chain = (start, end, places[0], length)
        if chain:
            out.append((label, chain[0], chain[1], chain[3] / whole))
        return out

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """Chained matches of all templates: ``(label, first word, end, covered share of the template)``."""
        return sorted((span for number in self.met(words) for span in self._chained(number, words)), key=lambda x: (x[1], x[2], x[0], x[3]))

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        base = self.base(words)
        starts = [at for at, _ in base]
        labels = {label for _, label in base}
        spans = self.spans(words)
        added = {label for label, _, _, share in spans if share >= SHARE}
        score = max([0.0, *(share for *_, share in spans)])
        return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | added)), min(1.0, score)


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, label, first_word, end_word, share`` of every chained template span; null text has none."""

    def make():
        scanner = Scanner()
        return lambda key, text: [(key, *span) for span in scanner.spans(words_of(text))]

    return map_texts(df, make, "doc_id long, label string, first_word long, end_word long, share double", id_col, text_col)


def license_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, places of the base phrases, labels and the best covered share.

    Null or empty text has no words, no labels and score 0; a null id is kept;
    repeated rows stay repeated. One narrow stage.
    """

    def make():
        scanner = Scanner()
        return lambda key, text: [(key, *scanner.scan(text))]

    return map_texts(df, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", id_col, text_col)
