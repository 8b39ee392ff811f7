"""Word boundaries and hashes of a whole Arrow text column at once, in numpy.

The helpers work on the UTF-8 bytes of a slice of rows, so no Python code runs per word. A hash of a
span is the difference of two prefix sums of a polynomial modulo 2**64, brought to position 0 and mixed;
equal spans have equal hashes, and different ones differ but for 64-bit collisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Lower case, and a space for ASCII punctuation.
PLAIN = LOWER.copy()
PLAIN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20


class _Powers:
    """P**i and P**-i modulo 2**64, as far as they have been asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            up, down = np.full(n, self.base, U), np.full(n, self.inverse, U)
            up[0] = down[0] = 1
            with np.errstate(over="ignore"):
                self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_bytes_powers, _words_powers = _Powers(_P), _Powers(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def slices(batches: Iterator[pa.RecordBatch], *columns: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of batches again, in slices of at most limit bytes of the columns together, or of one longer row."""
    for batch in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0)).astype(np.int64) for c in columns)
        total, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and where each begins (one more than texts). Null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """All words of some texts: byte ranges in data, and first[i]:first[i + 1], the words of text i."""

    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def runs(flags: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every longest run of True that lies within one text."""
    n = len(flags)
    edge = np.zeros(n + 1, bool)
    edge[text_at] = True
    start, end = flags.copy(), flags.copy()
    if n:
        start[1:] &= ~flags[:-1] | edge[1:n]
        end[:-1] &= ~flags[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words_of(texts: pa.Array, table: np.ndarray | None = None) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; table replaces bytes first."""
    data, at = text_bytes(texts)
    if table is not None:
        data = table[data]
    start, end = runs(~SPACE[data], at)
    return Words(data, at, start, end, np.searchsorted(start, at))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _bytes_powers.get(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of words[i:i + n] for each i that has so many after it, over the ends of texts too."""
    if len(words) < n:
        return np.zeros(0, U)
    up, down = _words_powers.get(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[: len(words)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(words) - n + 1] + U(n))


def starts_of_grams(count: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For grams of n words that lie within one text: their first words and texts."""
    many = np.maximum(count - n + 1, 0)
    text = np.repeat(np.arange(len(count)), many)
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return first[:-1][text] + within, text


def keyed(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    with np.errstate(over="ignore"):
        return mix(hashes + (text.astype(U) + U(1)) * U(_P))


def code_points(data: np.ndarray) -> np.ndarray:
    """How many code points begin before each byte, one more than bytes."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
