"""A reader of citation strings: author, work, and the passages that they name, as structures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

SCHEMA = "author string, work string, passages array<struct<start: string, end: string, open: boolean>>"
#: Words that say that a passage goes on, and Roman digits.
ONWARDS = ("sq", "sqq", "f", "ff", "et")
DIGITS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: page, letter and line | number | Roman number | word | signs
_TOKEN = re.compile(r"(?P<page>\d+ ?[a-eA-E](?:\d+)?(?![A-Za-z]))|(?P<number>\d+)|(?P<roman>\b[ivxlcdm]+\b|\b[IVXLCDM]+\b)|(?P<word>[^\W\d_]+)|(?P<sign>[.,;:–—-])")


def roman(text: str) -> int | None:
    """The value of a Roman number in its usual form, None for other words."""
    text, total, before = text.lower(), 0, 0
    for c in reversed(text):
        total, before = (total - DIGITS[c] if DIGITS[c] < before else total + DIGITS[c]), max(before, DIGITS[c])
    return total if text == written(total) else None


def written(n: int) -> str:
    steps = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]
    out = ""
    for value, letters in steps:
        out += letters * (n // value)
        n %= value
    return out


def _place(parts: list[str], whole: list[str] | None = None) -> str:
    """Parts joined by dots; those that a range's end leaves out are its start's."""
    if whole and len(parts) < len(whole):
        parts = whole[: len(whole) - len(parts)] + parts
    return ".".join(parts)


def read(text: str) -> tuple[str | None, str | None, list[dict]]:
    """(author, work, passages) of a citation string.

    States: name (the words before any number: the first is the author, the rest the work), place (parts joined by
    dots, a Roman number being a book), range (after a dash: the end, whose missing parts are the start's), list (after a
    comma or semicolon: another place, in the same book where it has fewer parts than the one before).
    """
    words, passages, parts, start, state, gap = [], [], [], None, "name", True
    before: list[str] = []

    def close(onwards: bool = False) -> None:
        nonlocal parts, start, before
        if start is not None:
            passages.append({"start": _place(start), "end": _place(parts, start) if parts else _place(start), "open": onwards or not parts})
            before = start
        elif parts:
            whole = before[: len(before) - len(parts)] + parts if state == "list" and len(parts) < len(before) else parts
            passages.append({"start": _place(whole), "end": _place(whole), "open": onwards})
            before = whole
        parts, start = [], None

    for token in _TOKEN.finditer(text):
        kind, word = token.lastgroup, token.group()
        value = roman(word) if kind == "roman" else None
        follows = re.match(r"\.? ?(?:\d|[ivxlcdmIVXLCDM]+\b)", text[token.end() :]) is not None
        # A Roman number is a book where a place goes on after it; elsewhere it's a word.
        is_part = kind in ("number", "page") or value is not None and (follows or state != "name" and not gap)
        if is_part:
            if parts and gap and state != "name":
                close()
                state = "place"
            parts.append(str(value) if value is not None else word.replace(" ", "").lower())
            state, gap = "place" if state == "name" else state, value is None
        elif kind == "sign":
            if word == "." and state != "name":
                gap = False
            elif word in "–—-" and parts and start is None:
                start, parts, state, gap = parts, [], "range", False
            elif word in ",;" and (parts or start is not None):
                close()
                state, gap = "list", False
        else:
            if word.lower() in ONWARDS and (parts or start is not None):
                close(True)
                state = "list"
            elif parts or start is not None:
                close()
                state = "list"
            elif state == "name":
                words.append(word)
    close()
    return words[0] if words else None, " ".join(words[1:]) or None, passages


def parsed(citation: Column) -> Column:
    """struct<author, work, passages> of a citation string; null for null."""

    @F.pandas_udf(SCHEMA)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else read(t) for t in texts]
        return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=object) for k, c in enumerate(("author", "work", "passages"))})

    return F.when(citation.isNotNull(), of(citation))
