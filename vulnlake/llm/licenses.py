"""License scans: phrases, and templates with optional and replaceable regions."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: Phrases and the labels that they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Templates by label. [[...]] is optional, {{n}} stands for up to n words, {{a|b}} for one of the
#: listed wordings; the rest is mandatory word for word. Marks count for nothing. The wordings of the licenses, in
#: full, and of the notices that refer to one.
_AS_IS = (
    'this software is provided {{by {{10}}|}} [["]]as is[["]] and {{any|all}} express or implied warranties, including, but not limited to, the implied warranties of merchantability '
    "and fitness for a particular purpose are disclaimed. in no event shall {{12}} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
    "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, "
    "whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"
)
_BSD = (
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "[[1|a]] {{redistributions|redistribution}} of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "[[2|b]] {{redistributions|redistribution}} in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_ENDORSE = "[[3|c]] neither the {{name|names}} of {{12}} nor the names of {{its|any|their}} contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


def _gnu(name: str, version: str) -> str:
    """The notice that the license asks for in every file."""
    return (
        f"this {{{{program|library|file|software|package}}}} is free software [[;|:]] you can redistribute it and/or modify it under the terms of the gnu {name} [[(gpl)]] as published by the free software foundation [[,|;]] "
        f"{{{{either|}}}} version {version} of the license [[, or (at your option) any later version]]. "
        "this {{program|library|file|software|package}} is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or "
        f"fitness for a particular purpose. see the gnu {name} for more details"
    )


TEMPLATES = {
    "mit": (
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is "
        "furnished to do so, subject to the following conditions: the above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or "
        "substantial portions of the software. the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of "
        "merchantability, fitness for a particular purpose and {{noninfringement|non infringement}}. in no event shall [[the]] {{8}} be liable for any claim, damages or other liability, "
        "whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"
    ),
    "bsd-2-clause": _BSD + _AS_IS,
    "bsd-3-clause": _BSD + _ENDORSE + _AS_IS,
    "isc": (
        "permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. the software is provided \"as is\" and {{8}} {{disclaims|disclaim}} all warranties with regard to this software including all implied warranties of merchantability and fitness. "
        "in no event shall {{8}} be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of "
        "contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license, version 2.0 (the \"license\"); you may not use this {{file|work|software|project}} except in compliance with the license. you may obtain a copy of the license at "
        "{{http|https}}://www.apache.org/licenses/license-2.0[[.txt|.html]] unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, "
        "without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-2.0-notice": _gnu("general public license", "2"),
    "gpl-3.0-notice": _gnu("general public license", "3"),
    "lgpl-2.1-notice": _gnu("lesser general public license", "2.1"),
    "lgpl-3.0-notice": _gnu("lesser general public license", "3"),
    "agpl-3.0-notice": _gnu("affero general public license", "3"),
    "mpl-2.0-notice": (
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at {{http|https}}://[[www]] mozilla.org/mpl/2.0"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means"
    ),
    "apache-2.0": "licensed under the apache license [[,]] version 2.0",
    "gpl-2.0": "[[this {{work|program|file|software}} is]] licensed under the gnu general public license [[,]] {{version|v}} 2 [[.0]] [[or later|only]]",
    "gpl-3.0": "[[this {{work|program|file|software}} is]] licensed under the gnu general public license [[,]] {{version|v}} 3 [[.0]] [[or later|only]]",
    "mit-notice": "{{released|licensed|distributed|available}} under the {{terms of the mit|mit}} license",
    "cc-by-4.0": "{{licensed|released|available}} under [[a|the]] [[creative commons]] {{cc by|attribution|cc by license}} [[license]] 4.0 [[international]] [[license]]",
    "copyright-notice": "copyright [[c]] {{1}} [[by]] {{4}} all rights reserved",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_UPPER))


class Template:
    """A nondeterministic automaton over words, compiled from template markup.

    States are numbered; ``steps[s]`` lists (word or None for any, next state) and ``free[s]`` the
    states reachable without a word.
    """

    def __init__(self, markup: str):
        self.steps: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        end = self._sequence(markup, 0)
        self.start, self.accept = self._closed({0}), end
        self.closed = [frozenset(self._closed({s})) for s in range(len(self.steps))]
        self.left = self._distances()
        self.mandatory = self.left[0]

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _words(self, text: str, at: int) -> int:
        for w in words(text):
            to = self._state()
            self.steps[at].append((w, to))
            at = to
        return at

    def _either(self, options: list[str], at: int) -> int:
        out = self._state()
        for option in options:
            self.free[self._sequence(option, at)].append(out)
        return out

    def _sequence(self, markup: str, at: int) -> int:
        for kind, body in _regions(markup):
            if kind == "text":
                at = self._words(body, at)
            elif kind == "optional":
                out = self._either(_options(body), at)
                self.free[at].append(out)
                at = out
            elif body.strip().isdigit():
                out = self._state()
                self.free[at].append(out)
                for _ in range(int(body)):
                    to = self._state()
                    self.steps[at].append((None, to))
                    self.free[to].append(out)
                    at = to
                at = out
            else:
                at = self._either(_options(body), at)
        return at

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def first_words(self) -> set[str | None]:
        return {w for s in self.start for w, _ in self.steps[s]}

    def _distances(self) -> list[int]:
        """Fewest words from each state to acceptance: what is mandatory from there."""
        into: list[list[tuple[int, int]]] = [[] for _ in self.steps]
        for s in range(len(self.steps)):
            for _, to in self.steps[s]:
                into[to].append((s, 1))
            for to in self.free[s]:
                into[to].append((s, 0))
        far = len(self.steps) + 1
        out, todo = [far] * len(self.steps), deque([self.accept])
        out[self.accept] = 0
        while todo:
            at = todo.popleft()
            for s, cost in into[at]:
                if out[at] + cost < out[s]:
                    out[s] = out[at] + cost
                    (todo.append if cost else todo.appendleft)(s)
        return out

    def longest(self, tokens: list[str], at: int) -> int:
        """Words of the longest match that starts at ``at``; 0 if none."""
        return self.run(tokens, at)[0]

    def run(self, tokens: list[str], at: int) -> tuple[int, int, int]:
        """(words of the longest match that starts at ``at``, words read before no state was left, mandatory words missing at best)."""
        states, best, i, missing = self.start, 0, at, self.mandatory
        while i < len(tokens):
            after: set[int] = set()
            for s in states:
                for w, to in self.steps[s]:
                    if w is None or w == tokens[i]:
                        after |= self.closed[to]
            if not after:
                break
            states, i = after, i + 1
            missing = min(missing, min(self.left[s] for s in states))
            if self.accept in states:
                best = i - at
        return best, i - at, missing


def _regions(markup: str) -> list[tuple[str, str]]:
    """(text | optional | replaceable, body) in order; regions may be nested."""
    out, depth, begun, i = [], 0, 0, 0
    opened = ""
    while i < len(markup):
        two = markup[i : i + 2]
        if two in ("[[", "{{"):
            if not depth:
                out.append(("text", markup[begun:i]))
                begun, opened = i + 2, two
            depth += 1
            i += 2
        elif two in ("]]", "}}"):
            depth -= 1
            if depth < 0:
                raise ValueError(f"unbalanced markup: {markup}")
            if not depth:
                out.append(("optional" if opened == "[[" else "replaceable", markup[begun:i]))
                begun = i + 2
            i += 2
        else:
            i += 1
    if depth:
        raise ValueError(f"unbalanced markup: {markup}")
    return [*out, ("text", markup[begun:])]


def _options(body: str) -> list[str]:
    """Split at | outside nested regions."""
    out, depth, part = [], 0, ""
    for piece in re.split(r"(\[\[|\{\{|\]\]|\}\}|\|)", body):
        depth += (piece in ("[[", "{{")) - (piece in ("]]", "}}"))
        if piece == "|" and not depth:
            out.append(part)
            part = ""
        else:
            part += piece
    return [*out, part]


class Scanner:
    """Finds phrases and templates in one text."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str], partial: int = 8):
        self.partial = partial
        self.phrases: dict[str, list[tuple[list[str], str]]] = {}
        for phrase, label in phrases.items():
            tokens = words(phrase)
            self.phrases.setdefault(tokens[0], []).append((tokens, label))
        self.templates: dict[str, list[tuple[str, Template]]] = {}
        for label, markup in templates.items():
            automaton = Template(markup)
            starts = automaton.first_words()
            if None in starts or automaton.accept in automaton.start:
                raise ValueError(f"template {label} must begin with a mandatory word")
            for w in starts:
                self.templates.setdefault(w, []).append((label, automaton))
        self.triggers = {*self.phrases, *self.templates}

    def scan(self, text: str | None) -> tuple:
        tokens = words(text or "")
        places, base, labels, matched, share = [], set(), set(), [], 0.0
        for i in [i for i, w in enumerate(tokens) if w in self.triggers] if not self.triggers.isdisjoint(tokens) else ():
            for phrase, label in self.phrases.get(tokens[i], ()):
                if tokens[i : i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
            for label, automaton in self.templates.get(tokens[i], ()):
                n, read, missing = automaton.run(tokens, i)
                if n:
                    labels.add(label)
                    matched.append((i, i + n))
                if n or read >= self.partial:
                    share = max(share, 1.0 if n else 1.0 - missing / automaton.mandatory)
        covered = {k for a, b in matched for k in range(a, b)}
        return (
            len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)),
            max(share, 0.5 if places else 0.0), len(covered),
        )


_RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_template_words long"


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` plus what the scanner finds in every whole text; one pass without a shuffle.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. n_base counts the places
    of ``phrases``, all of them, overlaps included. A template adds its label where all its mandatory wording is there, word
    for word. score: 1 if a template is matched; else the largest share of a template's mandatory words that a passage
    of 8 words or more goes through before it departs, and 0.5 at least where there is a phrase; else 0. n_template_words counts
    words inside template matches.

    Null and empty texts have no words, null places, empty labels and score 0. Long texts are read to their end. Repeated
    rows each get a result; an empty table gives an empty one; columns named like a result are replaced.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES

    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        names = [c.split()[0] for c in _RESULT.split(", ")]
        for batch in batches:
            out = pd.DataFrame([scanner.scan(t) for t in batch], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    rest = [c for c in docs.columns if c not in {c.split()[0] for c in _RESULT.split(", ")}]
    (found,) = free_names(docs, "found")
    return docs.withColumn(found, scan(F.col(text))).select(*rest, f"{found}.*")
