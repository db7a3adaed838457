"""License scans: fuzzy search for short notices.

Texts are reduced to their words (lower-cased, single spaces). A notice that is allowed k edits is split into k + 1
pieces: any place within k edits holds one of them unchanged, so exact hits of the pieces, found by one
automaton over all notices, locate the candidates. Around each, bounded-error matching verifies the
notice and gives the span and the number of edits. Exact phrases of the base list are found besides, everywhere.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Short notices searched for with edits, and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under the bsd 3 clause license", "bsd"),
    ("licensed under a creative commons attribution", "cc"),
    ("released into the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)
LETTERS_AN_EDIT, MOST_EDITS = 10, 5  # one edit for so many letters of a notice; edits at most
WORD_BYTES = bytes(
    i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)
)


def edits_allowed(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // LETTERS_AN_EDIT)


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the notice cut into edits + 1 pieces of nearly equal length."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@dataclass
class Match:
    label: str
    start: int  # code points of the reduced text
    end: int
    edits: int
    score: float  # 1 for an exact match, less with every edit


class Finder:
    """Seeds and patterns of a list of notices."""

    def __init__(self, notices=NOTICES):
        self.notices = notices
        self.automaton = ahocorasick.Automaton()
        seeds: dict[str, list] = {}
        self.patterns = []
        for number, (notice, _) in enumerate(notices):
            k = edits_allowed(notice)
            for offset, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((number, offset, len(piece)))
            # whole words: a place starts and ends where words do
            self.patterns.append((k, regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?![^ ])")))
        for piece, found in seeds.items():
            self.automaton.add_word(piece, found)
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, set[int]]:
        """By notice: the starts of the stretches that hits of its pieces allow it to lie in."""
        out: dict[int, set[int]] = {}
        for end, found in self.automaton.iter(text):
            for number, offset, size in found:
                out.setdefault(number, set()).add(max(0, end + 1 - size - offset - self.patterns[number][0]))
        return out

    def places(self, number: int, text: str, starts: set[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the places of a notice, which do not overlap: fewer edits first, then from the left.

        A stretch is as long as the notice and three times its edits, so it holds one place at most, and a
        search costs the same however often a text repeats a notice.
        """
        k, pattern = self.patterns[number]
        size, found = len(self.notices[number][0]) + 3 * k + 1, set()
        for start in sorted(starts):
            m = pattern.search(text, start, min(start + size, len(text)))
            if m and (m.end() == len(text) or text[m.end()] == " ") and (not m.start() or text[m.start() - 1] == " "):
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
        kept: list[tuple[int, int, int]] = []
        for edits, start, end in sorted(found):
            at = bisect_left(kept, (start,))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                kept.insert(at, (start, end, edits))
        return kept

    def matches(self, text: str) -> list[Match]:
        found = []
        for number, starts in self.windows(text).items():
            notice, label = self.notices[number]
            for start, end, edits in self.places(number, text, starts):
                found.append(Match(label, start, end, edits, 1 - edits / len(notice)))
        return sorted(found, key=lambda m: (m.start, m.end, m.label))


def base_places(reduced: str) -> list[tuple[int, str]]:
    """(word, label) of every place where the words of a base phrase stand consecutively."""
    found = []
    if "license" in reduced:
        padded = f" {reduced} "
        for phrase, label in BASE:
            at = padded.find(f" {phrase} ")
            while at >= 0:
                found.append((at, label))
                at = padded.find(f" {phrase} ", at + 1)
    words = word_numbers(reduced) if found else None
    return sorted((words(at), label) for at, label in found)


def word_numbers(reduced: str):
    """A function from a code point's place in the reduced text to the number of words that end before it."""
    spaces = [m.start() for m in regex.finditer(" ", reduced)]
    return lambda at: bisect_left(spaces, at)


def scan(text: str | None, finder: Finder) -> dict:
    words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
    reduced = b" ".join(words).decode("utf-8", "replace")
    base, fuzzy = base_places(reduced), finder.matches(reduced)
    labels = {label for _, label in base}
    word = word_numbers(reduced) if fuzzy else None
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": base[0][0] if base else None,
        "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | {m.label for m in fuzzy})),
        "score": 1.0 if base else max((m.score for m in fuzzy), default=0.0),
        "spans": [
            {"label": m.label, "first_word": word(m.start), "last_word": word(m.end), "edits": m.edits}
            for m in fuzzy
        ],
    }


FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,last_word:long,edits:int>>"
)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row.

    Null texts count as empty: no words, no places, empty labels, score 0. Spans count words from 0 and
    include their last word. Repeated rows each keep a row; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(notices)
        names = [x.split()[0] for x in FOUND.split(", ")]
        for b in batches:
            out = pd.DataFrame([scan(t, finder) for t in b["text"]], columns=names)
            out.insert(0, "id", b["id"].astype("Int64").to_numpy())
            yield out.astype({"id": "Int64", "n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id long, {FOUND}")
