"""Quality rules on repetition inside a text: characters inside duplicated word n-grams and lines.

Rolling hashes of the words give the hash of every n-gram of several lengths; an n-gram is duplicated when
its hash occurs twice in its text. Coverage is the share of the code points in words that lie in duplicated
n-grams (the union, so overlapping ones count once), or in lines equal to an earlier line. A text fails when
a coverage exceeds its limit, or by the base rules (too few words, too many words in repeated 5-word windows).

Null and blank texts have no words and fail as too short. Rows are judged alone: repeated rows, rows without a
doc_id and very long texts are no special case. All columns but doc_id and text are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm import arrays as A
from citeloom.llm.shared import bound_batches

#: n-gram length: largest share, in percent, of word characters inside duplicated n-grams. Beyond the first,
#: ascending, so that a longer duplicate is looked for only where a shorter one is.
LIMITS = {5: 25, 8: 20, 12: 15}
LINE_LIMIT, LEAST_WORDS, BASE_WINDOW, BASE_PERCENT = 30, 10, 5, 20
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + ", ".join(f"dup{n}_chars long" for n in LIMITS)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = keys[order][1:] == keys[order][:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    return same


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total words lie in an n-gram that begins at starts."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every line."""
    breaks = np.flatnonzero(data == 0x0A)
    of_break = np.searchsorted(at, breaks, "right") - 1
    n = len(at) - 1
    start = np.concatenate([at[:-1], breaks + 1])
    text = np.concatenate([np.arange(n), of_break])
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    end = np.where(last, at[1:][text], np.append(start[1:] - 1, 0)) if len(text) else start
    return start, end, text


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All figures of SCHEMA but doc_id, one value a text."""
    n = len(texts)
    words = A.words_of(texts)
    points = A.code_points(words.data)
    chars, text = points[words.end] - points[words.start], words.text
    add = lambda where, values: np.bincount(where, values, n).astype(np.int64)
    out = {"n_words": words.count, "word_chars": add(text, chars)}
    symbols = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(_SYMBOL[words.data], out=symbols[1:])
    out["n_symbols"] = np.diff(symbols[words.text_at])

    start, end, of = _lines(words.data, words.text_at)
    before = np.searchsorted(words.start, start)
    inside = np.searchsorted(words.start, end) - before
    full = inside > 0
    start, end, of, before, inside = start[full], end[full], of[full], before[full], inside[full]
    keys = A.keyed(A.span_hashes(words.data, start, end), of)
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    sums = np.append(0, np.cumsum(chars))
    out["n_dup_lines"] = add(of[later], None)
    out["dup_line_chars"] = add(of[later], (sums[before + inside] - sums[before])[later])

    hashes, maybe = A.span_hashes(words.data, words.start, words.end), None
    for length in LIMITS:
        at, of = A.starts_of_grams(words.count, words.first, length)
        if maybe is not None:
            near = maybe[at]
            at, of = at[near], of[near]
        grams = A.gram_hashes(hashes, length)
        same = twice(A.keyed(grams[at], of)) if len(at) else np.zeros(0, bool)
        maybe = np.zeros(len(hashes), bool)
        maybe[at[same]] = True
        inside = covered(at[same], length, len(hashes))
        out[f"dup{length}_chars"] = add(text[inside], chars[inside])
        if length == BASE_WINDOW:
            out["n_repeat_words"] = add(text[inside], None)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in A.slices(batches, "text"):
        found = measure(batch.column("text"))
        yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(found[k].astype(np.int64)) for k in names[1:])], names)


def repetition(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text): counts, base_failed, kept and the method's own figures, one row a row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    out = docs.mapInArrow(_measured, SCHEMA)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))
    fine = 100 * F.col("dup_line_chars") <= LINE_LIMIT * F.col("word_chars")
    for n, most in LIMITS.items():
        fine &= 100 * F.col(f"dup{n}_chars") <= most * F.col("word_chars")
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [c for c in out.columns if c not in base]
    return out.select(*base, failed.alias("base_failed"), (~failed & fine).alias("kept"), *more)
