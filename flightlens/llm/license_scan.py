"""License scans: fuzzy search for short notices.

A notice of ``L`` characters may be written with ``k`` edits (one per ten
characters, at most ``MAX_EDITS``). Cut into ``k + 1`` pieces, one piece at
least is free of edits wherever the notice stands (pigeonhole), so one pass of
an automaton over all pieces finds the candidate places of all notices. Around
each, a window as long as the match can be is verified by bounded-error
matching of the ``regex`` library, with 0, 1, ... ``k`` errors, so that the
first match has the fewest edits. Of matches that overlap, those with more
edits than another go: a ``version 2`` is not also a misspelt ``version 3``.

Text is compared as its words (lower-cased A-Z) joined by one space, so line
breaks, punctuation and case in a notice do not count as edits. A few base
phrases must stand word by word; the same automaton finds them.

No shuffle: a document is scanned where it is read, whole. The vocabulary of
notices is fixed, so nothing sent to a task grows with the data.

Defined cases: null or empty text: no words, no places, no labels, score 0; a
null id stays; repeated rows are scanned repeatedly; equal edits at one place:
all labels stay; a very long text is held by its task, about four times; empty
tables give no rows; extra columns are ignored unless carried. Bytes that are
not UTF-8 count as one wrong character each.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightlens.llm.decontamination import words_of
from flightlens.llm.runtime import prepare, rows_by_bytes, text_bytes

MAX_EDITS = 4

#: Base phrases, which must stand word by word, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices that are searched with edits, by label.
NOTICES = {
    "mit": ("licensed under the mit license", "released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "apache-2": ("licensed under the apache license version 2 0",),
    "gpl-2": ("gnu general public license version 2",),
    "gpl-3": ("gnu general public license version 3",),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "mpl-2": ("mozilla public license version 2 0",),
    "epl": ("eclipse public license version",),
    "bsd": ("licensed under the bsd license", "released under the bsd license",
            "redistribution and use in source and binary forms with or without modification are permitted"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose",),
    "cc-by": ("licensed under cc by 4 0", "creative commons attribution 4 0 international"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "creative commons attribution sharealike"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "creative commons attribution noncommercial"),
    "cc0": ("creative commons zero universal", "to the extent possible under law the author has waived all copyright"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "proprietary": ("unauthorized copying of this file via any medium is strictly prohibited",),
}

_SPACES = re.compile(rb" {2,}")
_NOT_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
                  for b in range(256))


def joined(data: bytes | None) -> str:
    """The words of a text, one space around each."""
    return _SPACES.sub(b" ", b" " + (data or b"").translate(_NOT_WORD) + b" ").decode("utf-8", "replace")


def edits_allowed(notice: str) -> int:
    return min(MAX_EDITS, len(notice) // 10)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of about equal length, with their places."""
    cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Notices and phrases as one automaton of exact seeds and one pattern per notice and number of errors."""

    def __init__(self, notices: dict[str, tuple[str, ...]], base: dict[str, str]):
        import ahocorasick
        import regex
        self.notices = [(label, n) for label, several in notices.items() for n in several]
        self.base = base
        self.allowed = [edits_allowed(n) for _, n in self.notices]
        self.patterns = [[regex.compile(f"(?e)(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}") if e else regex.compile(regex.escape(n))
                          for e in range(k + 1)] for (_, n), k in zip(self.notices, self.allowed)]
        seeds: dict[str, list[tuple]] = {}
        for i, ((_, notice), k) in enumerate(zip(self.notices, self.allowed)):
            for at, piece in pieces(notice, k):
                seeds.setdefault(piece, []).append((i, at))
        for phrase in base:
            seeds.setdefault(f" {phrase} ", []).append((None, phrase))
        self.automaton = ahocorasick.Automaton()
        for piece, of in seeds.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()
        self.verify = lru_cache(maxsize=4096)(self._verify)

    def _verify(self, notice: int, window: str) -> tuple[int, int, int] | None:
        """(edits, start, end) of the match with the fewest edits in a window."""
        for edits, pattern in enumerate(self.patterns[notice]):
            if m := pattern.search(window):
                return edits, *m.span()
        return None

    def __call__(self, text: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Base places ``(start, phrase)`` and notices found ``(edits, start, end, notice)``, in a ``joined`` text."""
        base: list[tuple[int, str]] = []
        best: dict[int, list[tuple[int, int, int]]] = {}
        tried: set[tuple[int, int]] = set()
        for last, (length, of) in self.automaton.iter(text):
            at = last + 1 - length
            for notice, where in of:
                if notice is None:
                    base.append((at + 1, where))
                    continue
                k, size = self.allowed[notice], len(self.notices[notice][1])
                if (notice, at - where) in tried:
                    continue
                tried.add((notice, at - where))
                low = max(0, at - where - k)
                found = self.verify(notice, text[low:at - where + size + k])
                if found:
                    best.setdefault(notice, []).append((found[0], low + found[1], low + found[2]))
        return base, _fewest(sorted({(e, a, b, n) for n, several in best.items() for e, a, b in several}))


def _fewest(matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without matches that overlap one with fewer edits, or an earlier one of their own notice with as many."""
    kept: list[tuple[int, int, int, int]] = []
    taken: list[tuple[int, int]] = []                   # parts of the text that matches with fewer edits cover
    for _, level in groupby(matches, key=lambda m: m[0]):
        last: dict[int, int] = {}
        here = []
        for m in level:
            if last.get(m[3], 0) <= m[1] and not _covered(taken, m[1], m[2]):
                last[m[3]] = m[2]
                here.append(m)
        kept += here
        taken = _union(taken + [(m[1], m[2]) for m in here])
    return sorted(kept, key=lambda m: (m[1], m[2], m[3]))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _covered(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    i = bisect_left(spans, (end, end))
    return i > 0 and spans[i - 1][1] > start


def _word_numbers(text: str, places: list[int]) -> dict[int, int]:
    """The number of the word at (or after) each place, in one pass over the text."""
    out, at, n = {}, 0, -1
    for p in sorted(set(places)):
        n += text.count(" ", at, p + 1)
        at = p + 1
        out[p] = n
    return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()),
                             ("last_word", pa.int64()), ("found", pa.string()), ("edits", pa.int32())]))
_SPANS_SQL = "array<struct<label: string, notice: string, first_word: long, last_word: long, found: string, edits: int>>"
_scanners: dict[str, Scanner] = {}


def _scan(notices, base, carry: list[str]):
    key = repr((notices, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners[key] = Scanner(notices, base)
        scan = _scanners[key]
        for batch in rows_by_bytes(batches, "data"):
            out = []
            for data in batch.column("data").to_pylist():
                text = joined(data)
                places, found = scan(text)
                word = _word_numbers(text, [p for p, _ in places] + [p for _, a, b, _ in found for p in (a, b - 1)])
                at = sorted(word[p] for p, _ in places)
                spans = [{"label": scan.notices[n][0], "notice": scan.notices[n][1], "first_word": word[a],
                          "last_word": word[b - 1], "found": text[a:b], "edits": e} for e, a, b, n in found]
                exact = sorted({scan.base[p] for _, p in places})
                score = 1.0 if places else max((1 - s["edits"] / len(s["notice"]) for s in spans), default=0.0)
                out.append((text.count(" ") - 1, len(at), at[0] if at else None, at[-1] if at else None, exact,
                            sorted({*exact, *(s["label"] for s in spans)}), score, spans))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in carry] + [pa.array(c, t) for c, t in zip(columns, (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()),
                    pa.float64(), _SPANS))], [*carry, *_ADDED])
    return run


_ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  notices: dict[str, tuple[str, ...]] | None = None, base: dict[str, str] | None = None,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *carry, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``, a row per input row.

    ``spans``: the notices found, with the words they cover, the text found and its edits. ``score``: 1 for a base
    phrase, else 1 less the share of characters edited in the closest notice, 0 if there is none.
    """
    if clash := {"doc_id", "data", *_ADDED} & set(carry):
        raise ValueError(f"carried columns clash with result columns: {sorted(clash)}")
    notices, base = NOTICES if notices is None else notices, BASE if base is None else base
    for text in [*base, *(n for several in notices.values() for n in several)]:
        if joined(text.encode()) != f" {text} " or edits_allowed(text) + 1 > len(text):
            raise ValueError(f"a notice is words in lower case, joined by one space: {text!r}")
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, text_bytes(text_col).alias("data"))
    kinds = dict(source.dtypes)
    keep = ["doc_id", *carry]
    return source.mapInArrow(_scan(notices, base, keep), ", ".join(f"`{c}` {kinds[c]}" for c in keep) +
                             ", n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
                             f"labels array<string>, score double, spans {_SPANS_SQL}")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                         F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", "labels").alias("labels"), "score",
                         F.size("spans").cast("long").alias("n_spans"))


def fewest_edits(notice: str, text: str) -> int:
    """The least edit distance of ``notice`` to any part of ``text``, by the full table (for tests)."""
    row = list(range(len(notice) + 1))
    least = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(notice, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != d)))
        row = new
        least = min(least, row[-1])
    return least


def brute_force_base(text: str | None, base: dict[str, str] = BASE) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels`` word by word (for tests)."""
    words = [w.decode("utf-8", "replace") for w in words_of((text or "").encode())]
    at = [(i, label) for phrase, label in base.items() for i in range(len(words))
          if words[i:i + len(phrase.split())] == phrase.split()]
    return (len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
            ",".join(sorted({label for _, label in at})))
