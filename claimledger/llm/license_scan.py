"""License scans: templates with optional and replaceable regions, compiled into one token automaton.

A template is a license text or notice in the public template markup:

* ``<<beginOptional>> ... <<endOptional>>`` may be left out as a whole;
* ``<<var;name="...";original="...";match="...">>`` may be replaced: ``.+`` by 1 to ``most_words`` words, ``.*`` by none as
  well, ``.{a,b}`` by a to b words, and words separated by ``|`` by one of these wordings.

All other wording is mandatory and has to stand there word by word.  Words are runs of ASCII letters, digits and
characters beyond ASCII, with A-Z lower-cased; case, punctuation, comment marks and line breaks count for nothing.
A place of a *phrase* (wording without regions) and a match of a template both give a label.

The templates become one automaton over words.  Its states are made as texts need them and kept, up to a bound, by each
worker.  A text is read from word to word only where a first word of some template stands and as long as some template
is still possible; all first words found on the way are followed at once, so a text is read in one pass
whatever it repeats.  Texts are read whole and stay where they are: no shuffle.

Null and wordless texts have no match, score 0 and empty labels.  Repeated rows are judged one by one, extra columns pass
through, an empty table stays empty.  Overlapping matches all count; of the places at which a template ends,
the nearest start in front counts, once for each start.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimledger.llm.common import read_table

#: The phrases whose places are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_AS_IS = 'this software is provided <<var;name="by";original="by the copyright holders and contributors";match=".{0,12}">> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;name="holder";original="the copyright holder or contributors";match=".{1,15}">> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage'
_BSD_2 = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_GPL_NOTICE = 'free software you can redistribute it and or modify it under the terms of the gnu {kind} license as published by the free software foundation either version {v} of the license or <<beginOptional>>at your option<<endOptional>> any later version'
_GPL_ONLY = 'free software you can redistribute it and or modify it under the terms of the gnu {kind} license <<beginOptional>>as published by the free software foundation<<endOptional>> version {v} <<var;name="only";original="only";match="only|as published by the free software foundation">>'

#: Wordings of licenses and of the notices that refer to them, by label.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<beginOptional>>the software<<endOptional>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;name="holder";original="the authors or copyright holders";match=".{1,15}">> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software'),
    ("isc", 'permission to use copy modify <<var;name="and";original="and or";match="and or|and">> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;name="author";original="the author";match=".{1,15}">> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;name="author2";original="the author";match=".{1,15}">> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software'),
    ("bsd-2-clause", f"{_BSD_2} {_AS_IS}"),
    ("bsd-3-clause", f'{_BSD_2} <<beginOptional>>3<<endOptional>> neither the name of <<var;name="organization";original="the copyright holder";match=".{{1,15}}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}'),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>>2<<endOptional>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be removed or altered from any source distribution"),
    ("unlicense", "free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 0"),
    ("apache-2.0", "apache license version 2 0 january 2004"),
    ("mit", 'released under the <<beginOptional>>terms of the<<endOptional>> mit license'),
    ("mit", 'licensed under the <<beginOptional>>terms of the<<endOptional>> mit license'),
    *((f"{short}-{v}.0-or-later", _GPL_NOTICE.format(kind=kind, v=v)) for short, kind, versions in (("gpl", "general public", (2, 3)), ("lgpl", "lesser general public", (3,)), ("agpl", "affero general public", (3,))) for v in versions),
    *((f"{short}-{v}.0-only", _GPL_ONLY.format(kind=kind, v=v)) for short, kind, versions in (("gpl", "general public", (2, 3)), ("lgpl", "lesser general public", (3,)), ("agpl", "affero general public", (3,))) for v in versions),
    *((f"gpl-{v}.0", f'licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>version<<endOptional>> <<var;name="version";original="{v}";match="{v}|v{v}">>') for v in (2, 3)),
    ("lgpl-2.1-or-later", _GPL_NOTICE.format(kind="lesser general public", v="2 1")),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("bsl-1.0", "distributed under the boost software license version 1 0"),
    *((f"cc-{kind.replace(' ', '-')}-{v}.0", f"cc {kind} {v} 0") for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in (3, 4)),
    *((f"cc-{short}-{v}.0", f"creative commons attribution {name}<<beginOptional>>international<<endOptional>> <<beginOptional>>unported<<endOptional>> {v} 0") for short, name in (("by", ""), ("by-sa", "sharealike "), ("by-nc", "noncommercial "), ("by-nd", "noderivatives ")) for v in (3, 4)),
    ("cc0-1.0", "cc0 1 0 universal"),
)

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FOUND = "struct<n_words: long, matches: array<struct<label: string, phrase: boolean, wording: int, start_word: long, end_word: long>>>"

#: A template's parts: a word; (parts,) that may be left out; (fewest, most) words; [wordings] of which one stands there.
Part = str | tuple | list


def parse(template: str, most_words: int = 40) -> list[Part]:
    """The parts of a template; refuses markup that it does not know and templates that do not start and end with a word."""
    open_: list[list[Part]] = [[]]
    for k, piece in enumerate(MARK.split(template)):
        if k % 2 == 0:
            open_[-1] += WORD.findall(piece.translate(LOWER))
        elif piece == "beginOptional":
            open_.append([])
        elif piece == "endOptional":
            if len(open_) < 2:
                raise ValueError(f"endOptional without beginOptional: {template[:60]}")
            inner = open_.pop()
            open_[-1].append(("optional", inner))
        else:
            match = re.search(r'match="([^"]*)"', piece)
            if match is None:
                raise ValueError(f"no match: {piece}")
            if match[1] in (".+", ".*") or (m := re.fullmatch(r"\.\{(\d+),(\d+)\}", match[1])):
                lo, hi = (int(match[1] == ".+"), most_words) if match[1] in (".+", ".*") else (int(m[1]), int(m[2]))
                open_[-1].append(("words", lo, hi))
            elif re.fullmatch(r"[\w\s|]+", match[1]):
                open_[-1].append([tuple(WORD.findall(x.translate(LOWER))) for x in match[1].split("|")])
            else:
                raise ValueError(f"a pattern of characters has no words: {match[1]}")
    if len(open_) > 1:
        raise ValueError(f"beginOptional without endOptional: {template[:60]}")
    if not open_[0] or not isinstance(open_[0][0], str) or isinstance(open_[0][-1], tuple):
        raise ValueError(f"a template starts and ends with mandatory wording: {template[:60]}")
    return open_[0]


def mandatory(parts: Sequence[Part]) -> int:
    """Words that have to stand there; of alternative wordings the shortest counts."""
    return sum(1 if isinstance(p, str) else min(map(len, p)) if isinstance(p, list) else 0 for p in parts)


def pattern(parts: Sequence[Part]) -> str:
    """The same wording as a regular expression over words that each follow one space."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += f" {p}"
        elif isinstance(p, list):
            out += f"(?:{'|'.join(' ' + ' '.join(x) for x in p)})"
        else:
            out += f"(?:{pattern(p[1])})?" if p[0] == "optional" else f"(?: [^ ]+){{{p[1]},{p[2]}}}"
    return out


@dataclass
class Automaton:
    """Wordings as one automaton.  States 0, 1, ... of the texts are sets of the wordings' own states; state 0 waits for a first word."""

    wordings: tuple[tuple[Part, ...], ...]
    most_states: int = 20_000
    words: list[dict[str, list[int]]] = field(default_factory=list)
    any_word: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    ends: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        self.entry = []
        for k, parts in enumerate(self.wordings):
            first = self._new()
            self.entry.append(self._closed({first}))
            self.ends[self._build(parts, first)] = k
        self.entry = [self._closed(e) for e in self.entry]
        self.first_words = {w: [k for k, parts in enumerate(self.wordings) if parts[0] == w] for w in {parts[0] for parts in self.wordings}}
        self.known = {w for d in self.words for w in d}
        self._reset()

    def _reset(self):
        self.sets, self.ids, self.moves, self.accepts = [frozenset()], {frozenset(): 0}, [{}], [()]

    def _new(self) -> int:
        self.words.append({})
        self.any_word.append([])
        self.free.append([])
        return len(self.words) - 1

    def _word(self, at: int, word: str) -> int:
        to = self._new()
        self.words[at].setdefault(word, []).append(to)
        return to

    def _build(self, parts: Sequence[Part], at: int) -> int:
        for p in parts:
            if isinstance(p, str):
                at = self._word(at, p)
                continue
            to = self._new()
            if isinstance(p, list):
                for wording in p:
                    here = at
                    for w in wording:
                        here = self._word(here, w)
                    self.free[here].append(to)
            elif p[0] == "optional":
                self.free[at].append(to)
                self.free[self._build(p[1], at)].append(to)
            else:
                here = at
                for i in range(p[2] + 1):
                    if i >= p[1]:
                        self.free[here].append(to)
                    if i < p[2]:
                        nxt = self._new()
                        self.any_word[here].append(nxt)
                        here = nxt
            at = to
        return at

    def _closed(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def after(self, states: frozenset[int], word: str) -> frozenset[int]:
        return self._closed({t for s in states for t in (*self.words[s].get(word, ()), *self.any_word[s])})

    def step(self, state: int, word: str) -> int:
        """The state behind ``word``, with every wording that may start there."""
        word = word if word in self.known else ""
        to = self.moves[state].get(word)
        if to is None:
            own = self.after(self.sets[state], word)
            for k in self.first_words.get(word, ()):
                own |= self.after(self.entry[k], word)
            full = own not in self.ids and len(self.sets) >= self.most_states
            if full:
                self._reset()
            if own not in self.ids:
                self.ids[own] = len(self.sets)
                self.sets.append(own)
                self.moves.append({})
                self.accepts.append(tuple(sorted(self.ends[s] for s in own if s in self.ends)))
            to = self.ids[own]
            if not full:
                self.moves[state][word] = to
        return to

    def reaches(self, k: int, words: Sequence[str]) -> bool:
        states = self.entry[k]
        for w in words:
            states = self.after(states, w)
            if not states:
                return False
        return any(self.ends.get(s) == k for s in states)


IN_WORD = np.zeros(256, bool)
IN_WORD[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = True
IN_WORD[128:] = True


def scan(text: bytes, automaton: Automaton, seeds: Sequence[bytes]) -> tuple[int, list[tuple[int, int, int]]]:
    """(number of words, (wording, first word, last word) of all matches by place) of a UTF-8 text."""
    text = text.lower()  # of bytes: A-Z alone
    inside = IN_WORD[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    seen = []
    for seed in seeds:
        at = text.find(seed)
        while at >= 0:
            i = int(np.searchsorted(starts, at))
            if i < n and starts[i] == at and ends[i] == at + len(seed):
                seen.append(i)
            at = text.find(seed, at + len(seed))
    if not seen:
        return n, []
    seen.sort()
    word = lambda i: text[starts[i] : ends[i]].decode()
    found: dict[tuple[int, int], int] = {}
    i = -1
    for first in seen:
        if first < i:
            continue
        i, state = first, 0
        while i < n and (state or i == first):
            state = automaton.step(state, word(i))
            for k in automaton.accepts[state]:
                for at in range(bisect_left(seen, i + 1) - 1, -1, -1):
                    s = seen[at]
                    if word(s) == automaton.wordings[k][0] and automaton.reaches(k, [word(j) for j in range(s, i + 1)]):
                        found.setdefault((k, s), i)
                        break
            i += 1
    return n, sorted(((k, s, e) for (k, s), e in found.items()), key=lambda m: (m[1], m[2], m[0]))


@cache
def _compiled(phrases: tuple[str, ...], templates: tuple[str, ...], most_words: int) -> Automaton:
    return Automaton(tuple(tuple(parse(t, most_words)) for t in (*phrases, *templates)))


def with_matches(docs: DataFrame, text_col: str = "text", out: str = "found", phrases: dict[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, most_words: int = 40) -> DataFrame:
    """Adds ``out``: the number of words and all matches (label, phrase or template, number of its wording, first and last word)."""
    texts = tuple(phrases), tuple(t for _, t in templates)
    labels = [*phrases.values(), *(label for label, _ in templates)]
    _compiled(*texts, most_words)  # markup errors show here, not in the tasks

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _compiled(*texts, most_words)
        seeds = [w.encode() for w in automaton.first_words]
        for batch in batches:
            rows = []
            for t in batch:
                n, matches = scan(t.encode() if isinstance(t, str) else b"", automaton, seeds)
                rows.append({"n_words": n, "matches": [{"label": labels[k], "phrase": k < len(phrases), "wording": k, "start_word": s, "end_word": e} for k, s, e in matches]})
            yield pd.DataFrame(rows, columns=["n_words", "matches"])

    return docs.withColumn(out, search.asNondeterministic()(F.col(text_col)))


def weights(phrases: dict[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> list[float]:
    """A match's score by its wording: ``m / (m + 2)`` for ``m`` mandatory words."""
    return [m / (m + 2) for m in (mandatory(parse(t)) for t in (*phrases, *(t for _, t in templates)))]


def op11_license_scan(spark, sf_dir):
    """Words, places of phrases, labels and score of every document; the score is that of the longest wording found, 0 without any."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_matches(docs).select("doc_id", "found.n_words", "found.matches")
    base = F.filter("matches", lambda m: m["phrase"])
    value = F.array(*[F.lit(w) for w in weights()])
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform(base, lambda m: m["start_word"])
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"), F.coalesce(F.array_max(F.transform("matches", lambda m: F.get(value, m["wording"]))), F.lit(0.0)).alias("score"),
    )


def _oracle() -> str:
    """The same by regular expressions over the joined words and list functions."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    wordings = [(label, phrase, True) for phrase, label in PHRASES.items()] + [(label, t, False) for label, t in TEMPLATES]
    hit = lambda t: f"regexp_matches(j, '{pattern(parse(t))} ')"
    there = ", ".join(f"CASE WHEN {hit(t)} THEN '{label}' END" for label, t, _ in wordings)
    base = ", ".join(f"CASE WHEN {hit(t)} THEN '{label}' END" for label, t, phrase in wordings if phrase)
    score = ", ".join(f"CASE WHEN {hit(t)} THEN {w!r}::DOUBLE ELSE 0 END" for (_, t, _), w in zip(wordings, weights(), strict=True))
    place = " OR ".join("(" + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())) + ")" for phrase in PHRASES)
    names = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{x}], lambda e: e IS NOT NULL))), ','), '')"
    return f"""
    WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    j AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j FROM t),
    p AS (SELECT *, CASE WHEN {' OR '.join(hit(t) for t in PHRASES)} THEN list_filter(range(len(w)), lambda i: {place}) ELSE []::BIGINT[] END AS places FROM j)
    SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
           {names(base)} AS base_labels, {names(there)} AS labels, greatest({score}) AS score FROM p"""


QUERIES = {"op11_license_scan": op11_license_scan}
ORACLES = {"op11_license_scan": _oracle()}
