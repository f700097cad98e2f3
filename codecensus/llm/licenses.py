"""License scans: templates with optional and replaceable regions as token automata over the words of whole texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Batches, batch, pick, prepare, table

#: Words of UTF-8 bytes after A-Z became a-z: digits, letters, and all bytes of characters beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARKUP = re.compile(r"<<(optional|end|var)(?: (\d+) (\d+))?>>|([^<]+|<)")
#: Bytes of a text whose words are held at once; a cut falls between words.
SEGMENT = 1 << 20
#: Determinised states that an automaton keeps; beyond that it forgets and starts over.
STATES = 50_000

#: Phrases that give a label by themselves.
PHRASES = {(b"mit", b"license"): "mit", (b"apache", b"license"): "apache", (b"general", b"public", b"license"): "gpl"}

#: Wording of public licenses and notices. <<optional>> ... <<end>> may be missing; <<var a b>> stands for a to b words.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files<<optional>> (the "Software")<<end>>, to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice
        <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.
        <<optional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var 1 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<end>>"""),
    ("isc", """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        <<optional>>THE SOFTWARE IS PROVIDED "AS IS" AND <<var 1 8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 1 8>> BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
        THIS SOFTWARE.<<end>>"""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<optional>><<var 1 1>> <<end>>Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. <<optional>><<var 1 1>> <<end>>Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. <<optional>><<optional>><<var 1 1>> <<end>>Neither the name<<optional>>s<<end>> of <<var 1 20>> nor the names of
        <<optional>>its <<end>><<optional>>their <<end>>contributors may be used to endorse or promote products derived from this software without
        specific prior written permission. <<end>><<optional>>THIS SOFTWARE IS PROVIDED BY <<var 1 12>> "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
        ARE DISCLAIMED.<<end>>"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at <<var 1 12>> Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. <<optional>>See the License for the specific language governing permissions and limitations under the
        License.<<end>>"""),
    ("gpl", """This <<var 1 4>> is free software<<optional>>:<<end>> you can redistribute it and/or modify it under the terms of the GNU
        <<optional>>Lesser <<end>><<optional>>Library <<end>><<optional>>Affero <<end>>General Public License as published by the Free Software
        Foundation<<optional>>; either version <<var 1 2>> of the License, or <<optional>>(at your option) <<end>>any later version<<end>>."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the author<<optional>>s<<end>> be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: <<optional>><<var 1 1>> <<end>>The origin of this software must not be misrepresented; you must not claim that you wrote the
        original software."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means."""),
    ("boost", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software."""),
    ("creative-commons", """Licensed under <<optional>>the <<end>><<optional>>a <<end>><<optional>>terms of the <<end>>Creative Commons
        <<optional>>Attribution <<end>><<optional>>NonCommercial <<end>><<optional>>ShareAlike <<end>><<optional>>NoDerivatives <<end>><<optional>>License<<end>>"""),
    ("creative-commons", "Licensed under <<optional>>the <<end>><<optional>>a <<end>>CC BY<<optional>> NC<<end>><<optional>> SA<<end>><<optional>> ND<<end>> <<var 1 1>> 0"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl", "SPDX-License-Identifier: <<optional>>L<<end>><<optional>>A<<end>>GPL-<<var 1 1>>.<<var 1 1>>"),
    ("bsd", "SPDX-License-Identifier: BSD-<<var 1 1>>-Clause"),
    ("isc", "SPDX-License-Identifier: ISC"),
]


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z as a-z, segment by segment."""
    at = 0
    while at < len(text):
        to = len(text)
        if to - at > SEGMENT:  # up to the end of the word that the segment's limit falls into
            m = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]").search(text, at + SEGMENT)
            to = m.start() if m else to
        yield _WORD.findall(text[at:to].lower())
        at = to


class Automaton:
    """A template as positions that read one word each (any word where ``word`` is None) and the positions that may follow."""

    def __init__(self, label: str, markup: str):
        self.label = label
        self.word: list[bytes | None] = []
        self.follow: list[set[int]] = []
        stack: list[tuple[set[int], set[int], bool]] = []
        # what the regions read so far can begin and end with, and whether they can be empty
        first, last, empty = set(), set(), True

        def then(f: set[int], z: set[int], e: bool) -> None:
            nonlocal first, last, empty
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = z | last if e else z
            empty = empty and e

        def one(word: bytes | None, optional: bool = False) -> None:
            self.word.append(word)
            self.follow.append(set())
            p = {len(self.word) - 1}
            then(p, p, optional)

        for kind, least, most, text in _MARKUP.findall(markup):
            if kind == "optional":
                stack.append((first, last, empty))
                first, last, empty = set(), set(), True
            elif kind == "end":
                inner, (first, last, empty) = (first, last), stack.pop()
                then(*inner, True)
            elif kind == "var":
                for k in range(int(most)):
                    one(None, k >= int(least))
            else:
                for w in _WORD.findall(text.encode().lower()):
                    one(w)
        if stack or empty:
            raise ValueError(f"template {label!r}: open region or no mandatory word")
        self.first, self.accept = frozenset(first), frozenset(last)
        if any(self.word[p] is None for p in first):
            raise ValueError(f"template {label!r} begins with a replaceable region")
        self.known = {w for w in self.word if w}
        self.starts = {self.word[p] for p in first}
        self.steps: dict[tuple[frozenset[int], bytes | None], frozenset[int]] = {}

    def begin(self, word: bytes) -> frozenset[int]:
        return frozenset(p for p in self.first if self.word[p] == word)

    def step(self, state: frozenset[int], word: bytes) -> frozenset[int]:
        """The positions that can have read the next word; determinised as texts ask for it."""
        key = (state, word if word in self.known else None)
        if key not in self.steps:
            if len(self.steps) >= STATES:
                self.steps.clear()
            self.steps[key] = frozenset(q for p in state for q in self.follow[p] if self.word[q] is None or self.word[q] == key[1])
        return self.steps[key]


class Scanner:
    """All templates over the words of a text, one word at a time; attempts are bounded by the templates' lengths."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        self.automata = [Automaton(*t) for t in templates]
        self.starts: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.starts:
                self.starts.setdefault(w, []).append(a)
        self.watched = set(self.starts) | {p[-1] for p in PHRASES}

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Words of the text, base places (start, end, label), and the passages (start, end, label) that templates accept."""
        base, found, active = [], [], []
        n, before = 0, (b"", b"")
        for words in words_of(text):
            for i, w in enumerate(words):
                if active:
                    going = []
                    for a, start, state, end in active:
                        state = a.step(state, w)
                        if state:
                            going.append((a, start, state, n + i + 1 if state & a.accept else end))
                        elif end:
                            found.append((a, start, end))
                    active = going
                if w not in self.watched:
                    continue
                for phrase, label in PHRASES.items():
                    if w == phrase[-1] and (before + tuple(words[max(0, i - 2):i]))[-len(phrase) + 1:] == phrase[:-1]:
                        base.append((n + i - len(phrase) + 1, n + i + 1, label))
                for a in self.starts.get(w, ()):
                    state = a.begin(w)
                    active.append((a, n + i, state, n + i + 1 if state & a.accept else 0))
            n += len(words)
            before = (before + tuple(words[-2:]))[-2:]
        found += [(a, start, end) for a, start, _, end in active if end]
        return n, base, _leftmost(found)


def _leftmost(found: list[tuple[Automaton, int, int]]) -> list[tuple[int, int, str]]:
    """Of each template's passages, in order of their start, those that don't overlap an earlier one."""
    out, upto = [], {}
    for a, start, end in sorted(found, key=lambda x: (x[1], x[0].label)):
        if start >= upto.get(a, 0):
            upto[a] = end
            out.append((start, end, a.label))
    return out


def covered(spans: list[tuple[int, int, str]]) -> int:
    """Words in the union of the spans."""
    total = upto = 0
    for start, end, _ in sorted(spans):
        total += max(0, end - max(start, upto))
        upto = max(upto, end)
    return total


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, passages.

    ``passages`` lists start:end:label (words, end exclusive) of what templates accept: every mandatory word, in order, with
    nothing between but the template's own regions; per template leftmost first, the longest of a start, without overlaps.
    ``score`` is the share of the text's words in passages and base places. One narrow pass, without a shuffle.

    Null and empty texts have no words, no labels (empty strings) and score 0; repeated rows give a row each; a null doc_id
    stays null; an empty table gives no rows; other columns are not read.
    """
    def run(batches: Batches) -> Batches:
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            for t in b.column("text"):
                n, base, found = scanner.scan((t.as_py() or "").encode())
                starts = [s for s, _, _ in base]
                names, more = {x for _, _, x in base}, {x for _, _, x in found}
                rows.append((n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)), ",".join(sorted(names | more)),
                             covered(base + found) / n if n else 0.0, ",".join(f"{s}:{e}:{x}" for s, e, x in found)))
            n, k, first, last, own, all_, score, passages = zip(*rows, strict=True) if rows else [()] * 8
            long, text = pa.int64(), pa.string()
            yield batch(doc_id=b.column("doc_id"), n_words=pa.array(n, long), n_base=pa.array(k, long), first_word=pa.array(first, long), last_word=pa.array(last, long),
                        base_labels=pa.array(own, text), labels=pa.array(all_, text), score=pa.array(score, pa.float64()), passages=pa.array(passages, text))

    src = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) as doc_id", "text")
    return src.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, passages string")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and accepted license wording of every whole document."""
    prepare(spark)
    return license_scan(table(spark, sf_dir, "documents"))
