"""License scans by templates: markup with optional and replaceable regions is compiled into automata over
words, which accept the texts whose mandatory wording matches exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trovelight.llm.common import prepared, row_field, row_of

# Phrases and the labels they stand for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices by label. [[ ]] is optional wording, {{n}} stands for up to n words of any kind,
# {{a|b}} for one of several words.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]] [[you may not use this file except in compliance with the license you may obtain a copy of the license at {{12}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license]]"),
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license [[gpl]] [[{{version|v}}]] {{2|v2}} [[or at your option any later version]]"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license [[gpl]] [[{{version|v}}]] {{3|v3}} [[or at your option any later version]]"),
    ("gpl-2.0", "this {{program|library|software|file}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "this {{program|library|software|file}} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("cc-by-4.0", "licensed under [[a]] {{cc|creative}} [[commons]] {{by|attribution}} 4 0 [[international]] [[license]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] {{cc|creative}} [[commons]] {{by|attribution}} {{sa|sharealike}} 4 0 [[international]] [[license]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] {{cc|creative}} [[commons]] {{by|attribution}} {{nc|noncommercial}} 4 0 [[international]] [[license]]"),
    ("cc-by-nd-4.0", "licensed under [[a]] {{cc|creative}} [[commons]] {{by|attribution}} {{nd|noderivatives}} 4 0 [[international]] [[license]]"),
    ("mit", "{{released|licensed|distributed|available}} under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "all rights reserved"),
    ("spdx", "spdx license identifier {{mit|isc|apache|gpl|lgpl|agpl|bsd|mpl|cc0|cc}}"),
)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IS_WORD = np.ones(256, bool)
_IS_WORD[[b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)]] = False


@dataclass(frozen=True)
class Automaton:
    """States with moves by word (any word where the key is None) and without one; the last state accepts."""

    label: str
    moves: tuple[dict, ...]
    free: tuple[tuple[int, ...], ...]
    anchor: bytes

    def closed(self, states: set[int]) -> set[int]:
        """`states` and all that they reach without a word."""
        found, waiting = set(states), list(states)
        while waiting:
            for state in self.free[waiting.pop()]:
                if state not in found:
                    found.add(state)
                    waiting.append(state)
        return found

    def longest(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest accepted run of words from `start`."""
        states, end, at = self.closed({0}), None, start
        last = len(self.moves) - 1
        while True:
            if last in states:
                end = at
            if at == len(words):
                return end
            word = words[at]
            reached = set()
            for state in states:
                for key in (word, None):
                    if key in self.moves[state]:
                        reached.add(self.moves[state][key])
            if not reached:
                return end
            states, at = self.closed(reached), at + 1

    def starts(self) -> set[bytes]:
        return {word for state in self.closed({0}) for word in self.moves[state]}


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template. It begins with a word; regions do not overlap, optional ones may nest.

    The anchor is the longest mandatory word: a text without it is not accepted.
    """
    moves: list[dict] = [{}]
    free: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory: list[bytes] = []

    def state() -> int:
        moves.append({})
        free.append([])
        return len(moves) - 1

    for token in re.findall(r"\[\[|\]\]|\{\{[^}]*\}\}|[^\s\[\]{}]+", template):
        here = len(moves) - 1
        if token == "[[":
            opened.append(here)
            # A state of its own, so that leaving the region out does not meet a repetition in it.
            free[here].append(state())
        elif token == "]]":
            end = state()
            free[here].append(end)
            free[opened.pop()].append(end)
        elif token.startswith("{{") and token[2:-2].isdigit():
            ends = [here]
            for _ in range(int(token[2:-2])):
                one = state()
                moves[ends[-1]][None] = one
                ends.append(one)
            end = state()
            for one in ends:
                free[one].append(end)
        elif token.startswith("{{"):
            end = state()
            for word in token[2:-2].split("|"):
                moves[here][word.encode()] = end
        else:
            moves[here][token.encode()] = state()
            if not opened:
                mandatory.append(token.encode())
    if opened:
        raise ValueError(f"a region of {label} does not end")
    return Automaton(label, tuple(moves), tuple(map(tuple, free)), max(mandatory, key=len))


class Scanner:
    """Base phrases and templates over whole texts."""

    def __init__(self, phrases: tuple, templates: tuple) -> None:
        self.phrases = [(phrase.encode().split(), label) for phrase, label in phrases]
        gap = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        # Whether any phrase is in a text, before its words are listed.
        self.any_phrase = re.compile(rb"|".join(gap.join(re.escape(word) for word in words) for words, _ in self.phrases))
        self.automata = [compiled(label, template) for label, template in templates]
        self.by_start: dict[bytes, list[Automaton]] = {}
        for automaton in self.automata:
            for word in automaton.starts():
                self.by_start.setdefault(word, []).append(automaton)
        self.anchors = sorted({automaton.anchor for automaton in self.automata})

    def scan(self, lowered: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """Places (first word, end, label) of phrases, and of the templates' longest matches, which do not overlap per label."""
        has_phrase = self.any_phrase.search(lowered) is not None
        alive = {anchor for anchor in self.anchors if anchor in lowered}
        if not has_phrase and not alive:
            return [], []
        words = _WORD.findall(lowered)
        base, found, ended = [], [], {}
        for at, word in enumerate(words):
            if has_phrase:
                for phrase, label in self.phrases:
                    if word == phrase[0] and words[at : at + len(phrase)] == phrase:
                        base.append((at, at + len(phrase), label))
            for automaton in self.by_start.get(word, ()):
                if automaton.anchor in alive and at >= ended.get(automaton.label, 0):
                    end = automaton.longest(words, at)
                    if end is not None:
                        found.append((at, end, automaton.label))
                        ended[automaton.label] = end
        return base, found


def word_counts(lowered: bytes, ends: np.ndarray) -> np.ndarray:
    """The number of words of each of the texts that lie one after the other and end at `ends`."""
    if not len(lowered):
        return np.zeros(len(ends), np.int64)
    inside = _IS_WORD[np.frombuffer(lowered, np.uint8)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    starting = starts[starts < len(inside)]
    begins[starting] = inside[starting]
    sums = np.concatenate([[0], np.cumsum(begins)])
    return sums[ends] - sums[starts]


def scanned(docs: DataFrame, carry: list[str] | None = None, text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES) -> DataFrame:
    """The carried columns (by default all) of every row as struct `row` with n_words, base and found, both arrays of (start, end, label), and score.

    Words are runs outside `[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lowered; starts and ends count words.
    `base` has every place of every phrase, `found` every longest run that a template accepts. The score is the share
    of the text's words in any of them. Null counts as empty; empty texts have no words and score 0.
    Nothing is shuffled.
    """
    prepared(docs.sparkSession)
    place = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())]))
    schema = T.StructType(
        [row_field(docs, carry), T.StructField("n_words", T.LongType()), T.StructField("base", place), T.StructField("found", place), T.StructField("score", T.DoubleType())]
    )
    places = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        rows = lambda spans: [{"start": s, "end": e, "label": label} for s, e, label in spans]
        for batch in batches:
            texts = [(value.as_py() or b"").translate(_LOWER) for value in batch.column(1).cast(pa.binary())]
            counts = word_counts(b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64))
            bases, founds, scores = [], [], []
            for one, count in zip(texts, counts.tolist(), strict=True):
                base, found = scanner.scan(one)
                bases.append(rows(base))
                founds.append(rows(found))
                scores.append(len({w for s, e, _ in [*base, *found] for w in range(s, e)}) / count if count else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(bases, places), pa.array(founds, places), pa.array(scores, pa.float64())],
                names=schema.names,
            )

    return docs.select(row_of(docs, carry), F.col(f"`{text}`").alias("text")).mapInArrow(scan, schema)
