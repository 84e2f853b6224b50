"""License notices in texts: exact phrases, and short notices with a bounded number of typing errors.

A notice that may hold k errors is cut into k + 1 parts; a text within k errors holds one part unchanged (pigeonhole),
so only places around an exact part are searched, by the regex library's fuzzy matching, which also tells the span and
the number of errors. There the first match from the left is taken, tightened to the best one around it, and the search
goes on behind that. All is done on the text's words in a row, one blank between.

Defined cases: a null or empty text has no words and no labels; places are counted with overlaps, spans of one notice
without; of several spans of a notice at one place the one with the fewest errors counts; null ids and repeated rows
each keep their row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, in_pieces, texts

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices searched with errors: at most one for every ERROR_EACH characters.
NOTICES = {
    "under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "under the apache license version 2": "apache-2",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "under the bsd license": "bsd",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "all rights reserved": "all-rights-reserved",
}
ERROR_EACH = 10
_BLANKS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes.maketrans(_BLANKS, b" " * len(_BLANKS))


def words_in(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case."""
    return text.lower().translate(_TABLE).split() if text else []


class Notice:
    def __init__(self, phrase: str, label: str) -> None:
        n = len(phrase)
        self.label, self.length, self.errors = label, n, n // ERROR_EACH
        cuts = [n * k // (self.errors + 1) for k in range(self.errors + 2)]
        self.parts = [(lo, phrase[lo:hi].encode()) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        self.first, self.best = (regex.compile(f"{flag}(?:{regex.escape(phrase)}){{e<={self.errors}}}") for flag in ("", "(?b)"))

    def spans(self, row: bytes) -> list[tuple[int, int, int]]:
        """(first byte, byte after, errors) of the notice in a row of words."""
        around: list[list[int]] = []
        for lo, part in self.parts:
            at = row.find(part)
            while at >= 0:
                # a match's ends lie at most the errors away from where the part says
                around.append([max(0, at - lo - 4 * self.errors), at - lo + self.length + 4 * self.errors])
                at = row.find(part, at + 1)
        found = []
        around.sort()
        joined: list[list[int]] = []
        for a in around:
            if joined and a[0] <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], a[1])
            else:
                joined.append(a)
        for lo, hi in joined:
            # whole characters only; an error may be a character of up to four bytes
            while lo > 0 and row[lo] & 0xC0 == 0x80:
                lo -= 1
            while hi < len(row) and row[hi] & 0xC0 == 0x80:
                hi += 1
            text = row[lo:hi].decode()
            at = 0
            while m := self.first.search(text, at):
                # too short a stretch for two matches
                m = self.best.search(text, m.start(), m.start() + self.length + 2 * self.errors) or m
                found.append((lo + len(text[: m.start()].encode()), lo + len(text[: m.end()].encode()), sum(m.fuzzy_counts)))
                at = m.end()
        return found


def scan(text: bytes | None, notices: list[Notice], base: dict[str, str]) -> tuple:
    """(number of words, places of exact phrases, first, last, their labels, all labels, score, spans in words with labels and errors)."""
    words = words_in(text)
    row = b" " + b" ".join(words) + b" "
    starts: list[int] | None = None
    places, base_labels = [], set()
    for phrase, label in base.items():
        needle = b" " + phrase.encode() + b" "
        at = row.find(needle)
        while at >= 0:
            places.append(row.count(b" ", 0, at + 1) - 1)
            base_labels.add(label)
            at = row.find(needle, at + 1)
    spans = []
    for notice in notices:
        for lo, hi, errors in notice.spans(row):
            if starts is None:
                starts, at = [], 1
                for w in words:
                    starts.append(at)
                    at += len(w) + 1
            first = max(0, bisect.bisect_right(starts, lo + (row[lo : lo + 1] == b" ")) - 1)
            last = max(first, bisect.bisect_left(starts, hi - (row[hi - 1 : hi] == b" ")) - 1)
            spans.append({"label": notice.label, "first_word": first, "last_word": last, "errors": errors, "score": 1 - errors / notice.length})
    labels = base_labels | {s["label"] for s in spans}
    score = max([1.0 * bool(places), *(s["score"] for s in spans)])
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,errors:long,score:double>>"
_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64()), ("score", pa.float64())])
_ARROW = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def _scan(batches: Iterator[pa.RecordBatch], base: dict[str, str], notices: dict[str, str]) -> Iterator[pa.RecordBatch]:
    made = [Notice(p, label) for p, label in notices.items()]
    for batch in in_pieces(batches):
        rows = [scan(t, made, base) for t in binaries(batch, 1)]
        columns = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """A row for each row of docs, in columns of SCHEMA; spans are in words from 0, both ends included."""
    rows = texts(docs, id_col, text_col)
    return rows.mapInArrow(partial(_scan, base=base, notices=notices), SCHEMA)
