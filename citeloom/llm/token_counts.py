"""Token counts of a sentencepiece byte-pair model, by merging with a heap and a linked list.

The symbols of a text are its characters after the model's own normalisation (spaces become U+2581, with
one in front). The adjacent pair whose joint piece has the best score, leftmost on ties, is merged until no
pair forms a piece; the count is the initial symbols minus the merges, and no identifier is made. A
character without a piece stands for its UTF-8 bytes. Where no piece of the model holds a Latin letter and
another character after it, merges never reach over the end of a run of letters: texts are then counted run
by run, and the counts of recent runs are kept in a bounded table.

Null texts count as empty; an empty text has no token. Rows are counted alone: repeated rows and rows without a
doc_id are no special case. Other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm import arrays as A
from citeloom.llm.shared import bound_batches

SPACE = "▁"
#: Words kept at most, and their longest length.
KEPT, LONGEST = 1_000_000, 48
#: Runs of more characters are cut further, so that a merge holds no whole long text.
CUT = 4096
#: After a run of these a text is cut, if the model's pieces allow it (Latin letters).
LETTER = "A-Za-zÀ-ɏ"


class MergeCounter(dict):
    """word -> number of tokens; a missing word is merged, and kept if it is short."""

    def __init__(self, pieces: list[str]):
        """pieces: best first; every character inside a piece is one itself."""
        super().__init__()
        self.ranks = {piece: rank for rank, piece in enumerate(pieces)}
        self.lengths = [len(piece) for piece in pieces]
        if not {c for piece in pieces for c in piece} <= self.ranks.keys():
            raise ValueError("a character of a piece is no piece")
        # A text may be cut between two characters that are nowhere adjacent in a piece.
        inside = {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}
        self.inside = inside
        if any(re.match(f"[{LETTER}][^{LETTER}]", pair) for pair in inside):
            self.words = re.compile("(?s).+")
        else:
            self.words = re.compile(f"{SPACE}+[^{SPACE}{LETTER}]*[{LETTER}]*|[^{SPACE}{LETTER}]+[{LETTER}]*|[{LETTER}]+")

    @classmethod
    def of_model(cls, path: str) -> MergeCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " ﬁ Å\u0301  ①\u3000y\t\n\x00 "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path} normalises texts by more than a sign for blanks")
        ids = (i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i)))
        return cls([model.id_to_piece(i) for i in sorted(ids, key=lambda i: -model.get_score(i))])

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: str) -> int:
        """Tokens of a word. A symbol is the span from its start i to end[i] (0: merged into the one before);
        begin[e] is the start of the symbol that ends at e. A heap entry is a rank and a start; it's stale unless
        the two symbols there still have the length of that piece together."""
        get, lengths, n = self.ranks.get, self.lengths, len(word)
        heap = [rank << 32 | i for i in range(n - 1) if (rank := get(word[i : i + 2])) is not None]
        count = n
        if heap:
            heapify(heap)
            end, begin = list(range(1, n + 1)), list(range(-1, n))
            while heap:
                entry = heappop(heap)
                left = entry & 0xFFFFFFFF
                right = end[left]
                if not right or right >= n:
                    continue
                to = end[right]
                if to - left != lengths[entry >> 32]:
                    continue
                end[left], end[right], begin[to] = to, 0, left
                count -= 1
                if to < n and (rank := get(word[left : end[to]])) is not None:
                    heappush(heap, rank << 32 | left)
                if left and (rank := get(word[(previous := begin[left]) : to])) is not None:
                    heappush(heap, rank << 32 | previous)
        if not word.isascii():  # characters without a piece never merge
            count += sum(len(c.encode()) - 1 for c in word if c not in self.ranks)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        if len(text) > CUT:
            words = (part for word in words for part in (self.parts(word) if len(word) > CUT else (word,)))
        return sum(map(self.__getitem__, words))

    def parts(self, word: str) -> Iterator[str]:
        """A long run, cut wherever no piece has the two characters side by side: no merge reaches over such a place."""
        last = 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.inside:
                yield word[last:i]
                last = i
        yield word[last:]


_counters: dict[str, MergeCounter] = {}


def _counted(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    if model not in _counters:
        _counters[model] = MergeCounter.of_model(model)
    counter = _counters[model]
    for batch in A.slices(batches, "text"):
        _, at = A.text_bytes(batch.column("text"))
        counts = [counter.count(t or "") for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(np.diff(at)), "n_tokens": pa.array(counts, pa.int64())})


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit, one row a row of docs.

    model: path of a sentencepiece BPE model that every executor has.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bound_batches(docs.sparkSession)
    out = docs.mapInArrow(lambda it: _counted(it, model), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
