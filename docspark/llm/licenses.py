"""License scans: license templates compiled into token automata.

A template is a text with markup. `<<optional>> ... <<end>>` encloses words that may be missing; `<<var name 0-12>>` stands for
0 to 12 words of any kind, such as a holder's name. Everything else is mandatory: a place matches only if these words stand there
exactly, compared as words (letters, digits and non-ASCII characters, A-Z in lower case), so that layout and punctuation don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from docspark.llm.common import WORD_TABLE, as_bytes, map_batches

#: Phrases and the label of each, without markup.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label -> (weight, template). A weight of 1 is a whole license, less is a notice or an identifier.
TEMPLATES: dict[str, tuple[float, str]] = {
    "gpl-3.0": (0.9, "licensed under the GNU General Public License <<optional>>as published by the Free Software Foundation either<<end>> <<optional>>version<<end>> 3 <<optional>>0<<end>>"),
    "gpl-2.0": (0.9, "licensed under the GNU General Public License <<optional>>as published by the Free Software Foundation either<<end>> <<optional>>version<<end>> 2 <<optional>>0<<end>>"),
    "gpl-notice": (0.9, "<<optional>>This program is<<end>> free software <<optional>>you can redistribute it and or modify it<<end>> under the terms of the GNU General Public License <<var version 0-12>> Free Software Foundation"),
    "apache-2.0": (0.9, "Licensed under the Apache License <<optional>>Version<<end>> 2 0 <<optional>>the License you may not use this file except in compliance with the License<<end>>"),
    "cc-by-4.0": (0.9, "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY <<optional>>SA<<end>> 4 0"),
    "cc-by-nc-4.0": (0.9, "licensed under <<optional>>a<<end>> <<optional>>the<<end>> CC BY NC <<optional>>SA<<end>> <<optional>>ND<<end>> 4 0"),
    "mit-notice": (0.9, "<<optional>>Released<<end>> <<optional>>Licensed<<end>> <<optional>>Distributed<<end>> under the <<optional>>terms of the<<end>> MIT License"),
    "spdx": (0.8, "SPDX License Identifier <<var identifier 1-4>>"),
    "mit": (
        1.0,
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var holder 1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "isc": (
        1.0,
        """Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND <<var author 1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS.""",
    ),
    "bsd-2-clause": (
        1.0,
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.
        THIS SOFTWARE IS PROVIDED BY <<var holder 1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var holder 1-12>>
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
        THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "bsd-3-clause": (
        1.0,
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: <<optional>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<optional>>2.<<end>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.
        <<optional>>3.<<end>> Neither the name of <<var holder 1-12>> nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.
        THIS SOFTWARE IS PROVIDED BY <<var holder 1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var holder 1-12>>
        BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF
        THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "apache-2.0-header": (
        1.0,
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at <<var place 1-12>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "mpl-2.0": (
        0.9,
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. <<optional>>If a copy of the MPL was not
        distributed with this file, You can obtain one at<<end>>""",
    ),
    "unlicense": (0.9, "This is free and unencumbered software released into the public domain"),
}

MARK = re.compile(r"<<(optional|end|var\s+\w+\s+(\d+)-(\d+))>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..n-1 with n the accepting one. A state has a word to read (or None for any word) and the states to go on at without
    reading. `first`: words that a match can begin with; `anchor`: the longest mandatory run, which every match contains."""

    label: str
    weight: float
    word: tuple
    skip: tuple
    first: frozenset
    anchor: bytes

    def closure(self, state: int) -> list[int]:
        seen, todo = set(), [state]
        while todo:
            if (s := todo.pop()) not in seen:
                seen.add(s)
                todo.extend(self.skip[s] if s < len(self.skip) else ())
        return sorted(seen)

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that begins at word `at`, or -1."""
        last, states, end = len(self.word), self.closure(0), -1
        while states:
            if states[-1] == last:
                end = at
            if at >= len(words):
                break
            into = set()
            for s in states:
                if s < last and (self.word[s] is None or self.word[s] == words[at]):
                    into.update(self.closure(s + 1))
            states, at = sorted(into), at + 1
        return end


def compile_template(label: str, text: str, weight: float = 1.0) -> Automaton:
    """A token automaton. A template has to begin, after optional parts, with a mandatory word; parts don't nest."""
    word: list = []
    skip: list[list[int]] = []
    runs, open_at, at = [[]], None, 0

    def read(part: str) -> None:
        for w in words_of(part.encode()):
            word.append(w)
            skip.append([])
            if open_at is None:
                runs[-1].append(w)

    for m in MARK.finditer(text):
        read(text[at : m.start()])
        at = m.end()
        if m[1] == "optional":
            if open_at is not None:
                raise ValueError(f"{label}: optional parts don't nest")
            open_at = len(word)
            runs.append([])
        elif m[1] == "end":
            if open_at is None:
                raise ValueError(f"{label}: an end without a beginning")
            if open_at < len(word):
                skip[open_at].append(len(word))
            open_at = None
        else:
            least, most = int(m[2]), int(m[3])
            begin = len(word)
            for k in range(most):
                word.append(None)
                skip.append([begin + most] if k >= least else [])
            runs.append([])
    read(text[at:])
    if open_at is not None or not any(runs):
        raise ValueError(f"{label}: an optional part stays open, or nothing is mandatory")
    made = Automaton(label, weight, tuple(word), tuple(map(tuple, skip)), frozenset(), b" ".join(max(runs, key=lambda r: sum(map(len, r)))))
    begins = [made.word[s] if s < len(word) else None for s in made.closure(0)]
    if None in begins:
        raise ValueError(f"{label}: it has to begin with a word")
    return Automaton(label, weight, made.word, made.skip, frozenset(begins), made.anchor)


def find_licenses(words: list[bytes], joined: bytes, automata: list[Automaton]) -> Iterator[tuple[str, float, int, int]]:
    """(label, weight, first word, end) of each leftmost-longest match. `joined`: the words with a space before, between and after."""
    for a in automata:
        if b" " + a.anchor + b" " not in joined:
            continue
        at = 0
        while at < len(words):
            if words[at] in a.first and (end := a.match(words, at)) > at:
                yield a.label, a.weight, at, end
                at = end
            else:
                at += 1


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which the phrase's words stand consecutively; places may overlap."""
    out, at = [], joined.find(b" " + phrase + b" ")
    seen = passed = 0
    while at >= 0:
        seen += joined.count(b" ", passed, at)
        passed = at
        out.append(seen)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


SPANS = "array<struct<label:string,weight:double,first_word:bigint,end_word:bigint>>"


def scan_licenses(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = BASE_PHRASES,
    templates: dict[str, tuple[float, str]] = TEMPLATES,
) -> DataFrame:
    """doc_id, n_words, base (phrase places), spans (template matches), one row for each input row; nothing is shuffled.

    A null or empty text has no words and no spans; a repeated row is scanned again; other columns are ignored; an empty table gives
    no rows. Texts are read whole: time is linear in their length but for the few words around a place that may begin a match.
    """
    ids = df.schema[id_col].dataType.simpleString()

    def scan(batches):
        automata = [compile_template(label, text, weight) for label, (weight, text) in templates.items()]
        known = [(b" ".join(words_of(p.encode())), label) for p, label in phrases.items()]
        rare = sorted({max(p.split(), key=len) for p in [*(p for p, _ in known), *(a.anchor for a in automata)]})
        base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("weight", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
        for batch in batches:
            counts, base, spans = [], [], []
            for text in as_bytes(batch.column(1)):
                plain = text.translate(WORD_TABLE)
                words = plain.split()
                counts.append(len(words))
                places, found = [], []
                if any(r in plain for r in rare):
                    joined = b" " + b" ".join(words) + b" "
                    places = [{"label": label, "word": k} for p, label in known for k in phrase_places(joined, p)]
                    found = [dict(zip(("label", "weight", "first_word", "end_word"), m)) for m in find_licenses(words, joined, automata)]
                base.append(places)
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(base, base_type), pa.array(spans, span_type)],
                ["doc_id", "n_words", "base", "spans"],
            )

    return map_batches(
        df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")),
        scan,
        f"doc_id {ids}, n_words bigint, base array<struct<label:string,word:bigint>>, spans {SPANS}",
    )
