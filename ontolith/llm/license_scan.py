"""License scan by template-markup matching.

A template is mandatory wording with markup: `[[ ... ]]` is an optional region, `{{name:most}}` a replaceable one that takes
up to `most` words of any kind. Each template is compiled into an automaton over words; a text is accepted where the
mandatory wording matches word for word. Phrases without markup are templates too; they are the base labels.

Words: A-Z are lower-cased, then runs of characters other than the ASCII separators. Texts are read whole, in UTF-8: all
separators are ASCII, so bytes can be mapped and split without decoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, importable

#: Phrases and labels of the base scan.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
    the {{quote:1}} to deal in the software without restriction including without limitation the rights to use copy modify merge publish
    distribute sublicense and or sell copies of the software"""
_NO_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
    merchantability fitness for a particular purpose and noninfringement in no event shall the authors [[or copyright holders]] be liable for
    any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
    software or the use or other dealings in the software"""
_BSD = """[[copyright {{holder:60}}]] redistribution and use in source and binary forms with or without modification are permitted provided that
    the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions
    and the following disclaimer"""
_BSD_2 = """[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
    in the documentation and or other materials provided with the distribution"""
_BSD_END = """this software is provided by {{holder:12}} as is and any express or implied warranties including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{holder:12}} be liable for any direct
    indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
    loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability
    or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
    damage"""

#: Notices as their licenses word them; [[optional]], {{replaceable:most words}}. Labels in -text are the opening
#: words of a license and say nothing of the rest; those in -license are written out to the end of the mandatory wording.
TEMPLATES = {
    "mit-license": f"""[[the mit license]] [[copyright {{{{holder:60}}}}]] {_MIT} and to permit persons to whom the software is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be
        included in all copies or substantial portions of the software {_NO_WARRANTY}""",
    "isc-license": """[[isc license]] [[copyright {{holder:60}}]] permission to use copy modify and [[or]] distribute this software for any purpose
        with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the
        software is provided as is and {{holder:6}} disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall {{holder:6}} be liable for any special direct indirect or consequential damages or any
        damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
        arising out of or in connection with the use or performance of this software""",
    "bsd-2-license": f"{_BSD} {_BSD_2} {_BSD_END}",
    "bsd-3-license": f"""{_BSD} {_BSD_2} [[3]] neither the name of {{{{holder:12}}}} nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission {_BSD_END}""",
    "unlicense-license": f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile
        sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and
        by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright
        interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of
        our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
        rights to this software under copyright law {_NO_WARRANTY}""",
    "mit-text": """[[the mit license]] [[copyright {{holder:60}}]] permission is hereby granted free of charge to any person obtaining a copy of this
        software and associated documentation files the {{quote:1}} to deal in the software without restriction including without limitation
        the rights to use copy modify merge publish distribute sublicense and or sell copies of the software""",
    "isc-text": """[[isc license]] [[copyright {{holder:60}}]] permission to use copy modify and [[or]] distribute this software for any purpose with or
        without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies""",
    "bsd-text": """[[copyright {{holder:60}}]] redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions
        and the following disclaimer""",
    "apache-2-notice": """licensed under the apache license version 2 0 the license you may not use this [[file]] {{what:6}} except in compliance with the
        license you may obtain a copy of the license at""",
    "gpl-notice": """this program is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general
        public license as published by the free software foundation either version {{version:2}} of the license or [[at your option]] any
        later version""",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense-text": "this is free and unencumbered software released into the public domain",
    "cc-by-notice": """this {{work:3}} is licensed under a creative commons attribution [[noncommercial]] [[sharealike]] [[noderivatives]] [[noderivs]]
        {{version:2}} [[international]] [[unported]] license""",
    "named-license": "[[released]] [[distributed]] [[licensed]] [[available]] under the [[terms of the]] mit license [[see {{where:8}} for details]]",
}

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Automaton:
    """States 0..n; state k is left by its word to k+1. `skips` are moves without a word; `loops` take any word and count."""

    label: str
    word: list[bytes | None] = field(default_factory=list)  # None: a replaceable region
    most: dict[int, int] = field(default_factory=dict)
    skips: dict[int, list[int]] = field(default_factory=dict)
    mandatory: set[int] = field(default_factory=set)
    anchor: bytes = b""
    anchor_at: int = 0

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        a, opened = cls(label), []
        for part in re.findall(r"\[\[|\]\]|\{\{\w+:\d+\}\}|[^\s\[\]{}]+", template):
            here = len(a.word)
            if part == "[[":
                opened.append(here)
            elif part == "]]":
                a.skips.setdefault(opened.pop(), []).append(here)
            elif part.startswith("{{"):
                a.most[here] = int(part[2:-2].split(":")[1])
                a.word.append(None)
            else:
                if not opened:
                    a.mandatory.add(here)
                a.word.append(part.encode())
        if opened:
            raise ValueError(f"{label}: an optional region is not closed")
        # The longest run of mandatory words side by side; a text without it cannot be accepted.
        runs: list[list[int]] = []
        for k in sorted(a.mandatory):
            if runs and runs[-1][-1] == k - 1 and k not in a.skips.values():
                runs[-1].append(k)
            else:
                runs.append([k])
        if not runs:
            raise ValueError(f"{label}: no mandatory wording")
        run = max(runs, key=len)
        a.anchor, a.anchor_at = b" " + b" ".join(a.word[k] for k in run) + b" ", run[0]
        return a

    def _closure(self, states: dict[int, dict[int, int]]) -> dict[int, dict[int, int]]:
        """states: {state: {start: words taken by the loop it stands in}}; adds what moves without a word reach."""
        todo = list(states)
        while todo:
            k = todo.pop()
            targets = list(self.skips.get(k, ()))
            if k in self.most:
                targets.append(k + 1)  # a replaceable region may be empty
            for t in targets:
                into, fresh = states.setdefault(t, {}), False
                for start in states[k]:
                    if into.get(start, 1 << 30) > 0:
                        into[start], fresh = 0, True
                if fresh:
                    todo.append(t)
        return states

    def spans(self, tokens: list[bytes], line: bytes) -> list[tuple[int, int]]:
        """Accepted spans [start, end) of words, the longest for each start."""
        if self.anchor not in line:
            return []
        found: dict[int, int] = {}
        states: dict[int, dict[int, int]] = {}
        last, reach = len(self.word), len(self.word) + sum(self.most.values())
        places = _places(line, self.anchor)
        for lo, hi in _joined([(max(0, p - reach), min(len(tokens), p + reach)) for p in places]):
            states = {}
            for i in range(lo, hi + 1):
                states = self._closure({**states, 0: {**states.get(0, {}), i: 0}})
                for start in states.get(last, ()):
                    if i > start:
                        found[start] = max(found.get(start, 0), i)
                if i == hi:
                    break
                token, after = tokens[i], {}
                for k, starts in states.items():
                    if k == last:
                        continue
                    if k in self.most:
                        for start, taken in starts.items():
                            if taken < self.most[k]:
                                into = after.setdefault(k, {})
                                into[start] = min(into.get(start, 1 << 30), taken + 1)
                    elif self.word[k] == token:
                        after.setdefault(k + 1, {}).update(dict.fromkeys(starts, 0))
                states = after
        return sorted(found.items())


def _places(line: bytes, phrase: bytes) -> list[int]:
    """Word positions at which the phrase (with a blank at both ends) stands, overlapping ones too."""
    out, at, words_before, counted = [], line.find(phrase), 0, 0
    while at >= 0:
        words_before += line.count(b" ", counted, at)
        counted = at
        out.append(words_before)
        at = line.find(phrase, at + 1)
    return out


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class Scanner:
    def __init__(self, base: dict[str, str] | None = None, templates: dict[str, str] | None = None):
        self.base = [(label, b" " + phrase.encode() + b" ", phrase.count(" ") + 1) for label, phrase in (BASE if base is None else base).items()]
        self.automata = [Automaton.compile(*x) for x in (TEMPLATES if templates is None else templates).items()]

    def scan(self, text: str | None) -> tuple:
        tokens = words(text or "")
        line = b" " + b" ".join(tokens) + b" "
        places, labels = [], set()
        covered = []
        for label, phrase, n in self.base:
            if phrase in line and (at := _places(line, phrase)):
                places += at
                labels.add(label)
                covered += [(p, p + n) for p in at]
        base = sorted(labels)
        for a in self.automata:
            if spans := a.spans(tokens, line):
                labels.add(a.label)
                covered += spans
        share = sum(hi - lo for lo, hi in _joined(covered)) / len(tokens) if tokens else 0.0
        first, last = (min(places), max(places)) if places else (None, None)
        return len(tokens), len(places), first, last, ",".join(base), ",".join(sorted(labels)), min(1.0, share)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each row of df: id, n_words, n_base (all places of base phrases), first_word and last_word (least and
    greatest start; null without a place), base_labels, labels (distinct, sorted, comma-joined), score (the share of the
    words that accepted spans cover). A null text counts as empty: no words, no labels, score 0. Equal rows give equal
    results; other columns of df are not looked at.
    """
    importable(df.sparkSession)
    scanner = Scanner(base, templates)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([scanner.scan(t) for t in batch["text"]], columns=names)
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "id", batch["id"])
            yield out

    narrow = df.select(col(id_col).alias("id"), col(text_col).alias("text"))
    return narrow.mapInPandas(scan, f"id {dict(narrow.dtypes)['id']}, {SCHEMA}")
