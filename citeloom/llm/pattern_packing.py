"""Packing of tokenised documents into sequences of a fixed capacity, by patterns of lengths.

The histogram of piece lengths (at most ``capacity`` numbers, whatever the input) is all that the driver
sees. Patterns of two and three lengths that fill a sequence exactly are enumerated, and repeat counts are
fitted to the histogram by non-negative least squares (active set, Lawson and Hanson), rounded down. What is
left of the histogram is packed best fit, longest first. The plan says for the r-th piece of each length in
which sequence and where it goes; ranks come from counts of (length, salt) groups, so a length that a large
share of the pieces has is numbered by many tasks.

Null texts are empty: one piece that holds the end token alone. Repeated rows are packed one by one, rows without a
doc_id too. Runs of white space of any length are encoded as the library does. Columns but doc_id and text are left
alone; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from citeloom.llm import arrays as A
from citeloom.llm.shared import stored

#: Patterns in the fitted solution at most, and pieces of one (length, salt) group that one task numbers.
SUPPORT, GROUP = 400, 64
#: Fits that are tried, the one with the fewest sequences is taken: shortest length in a pattern, as a share of
#: the capacity (short pieces are worth more as filling), and the share of each repeat count that is kept.
LEAST, SHARES = (1 / 8, 1 / 5), (1.0, 0.8, 0.6, 0.4)


class Encoder:
    """Token ids of a byte-level BPE ``tokenizers`` file with the usual split pattern, encoded by tiktoken.

    Same vocabulary, same merges and same pattern give the same ids several times faster. Strings of special
    tokens inside texts become those tokens, as in ``tokenizers``. The pattern tracks back over a run of white space
    character by character, at a cost that is the square of its length: runs are cut out and encoded as the one part that
    they are, all but their last character, which may belong to the word behind.
    """

    RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{16,}")
    #: Fixed value: the split pattern of byte-level files that ask for the usual one.
    SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
            raise ValueError(f"{path} is no plain byte-level BPE file")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.ranks = ranks

    @cached_property
    def part(self):
        """Encodes a text as one part."""
        import tiktoken

        return tiktoken.Encoding("part", pat_str="(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        out, at = [], 0
        for run in self.RUN.finditer(text):
            last = run.end() == len(text) or self.special.match(text, run.end())
            to = run.end() if last else run.end() - 1
            out += [self._encoded(text[at : run.start()]), np.asarray(self.part.encode_to_numpy(text[run.start() : to]), np.uint32)]
            at = to
        return np.concatenate([*out, self._encoded(text[at:])]) if out else self._encoded(text)

    def _encoded(self, text: str) -> np.ndarray:
        allowed = "all" if self.special.search(text) else set()
        return np.asarray(self.encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), np.uint32)


_encoders: dict[str, Encoder] = {}


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encode, last = _encoders[path], np.array([end], np.uint32)
    for batch in A.slices(batches, "text"):
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = np.concatenate([encode(text or ""), last]).astype("<u4")
            head = (len(ids) - 1) % capacity + 1  # a longer document's first piece is what is over
            for k, to in enumerate(range(head, len(ids) + 1, capacity)):
                start = 0 if k == 0 else to - capacity
                part = ids[start:to]
                rows.append((doc, k, start, to - start, zlib.crc32(part.tobytes())) + ((part.tolist(),) if with_ids else ()))
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def patterns_of(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Pairs and triples of the given lengths that sum to capacity, one a row, 0 where a pair has no third."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    low = np.arange(1, capacity // 2 + 1)
    pairs = np.stack([low, capacity - low, np.zeros_like(low)], 1)
    one, two = np.meshgrid(np.arange(1, capacity // 3 + 1), low, indexing="ij")
    three = capacity - one - two
    fits = (one <= two) & (two <= three)
    triples = np.stack([one[fits], two[fits], three[fits]], 1)
    every = np.concatenate([pairs, triples])
    there[0] = True
    return every[there[every].all(1)]


def fit(histogram: np.ndarray, patterns: np.ndarray, support: int = SUPPORT, block: int = 16) -> dict[int, float]:
    """Non-negative least squares of the histogram by patterns: pattern -> repeat count, at most support many.

    Active set of Lawson and Hanson; a step takes in up to block patterns that share no length.
    """
    target = histogram.astype(float)
    target[0] = 0.0
    active, values = np.zeros(0, np.int64), np.zeros(0)
    matrix, left = np.zeros((len(target), 0)), target.copy()
    while len(patterns) and len(active) < support:
        gain = left[patterns].sum(1)
        gain[active] = -np.inf
        used, new = set(), []
        for p in np.argsort(-gain)[: 64 * block]:
            lengths = {int(x) for x in patterns[p] if x}
            if gain[p] <= 1e-3 * max(1.0, target.max()) or len(new) >= block:
                break
            if not lengths & used:
                used |= lengths
                new.append(p)
        if not new:
            break
        columns = np.zeros((len(target), len(new)))
        for j, p in enumerate(new):
            np.add.at(columns[:, j], patterns[p][patterns[p] > 0], 1.0)
        matrix, active, values = np.hstack([matrix, columns]), np.append(active, new), np.append(values, np.zeros(len(new)))
        while len(active):
            gram = matrix.T @ matrix
            gram[np.diag_indices_from(gram)] += 1e-6
            solution = np.linalg.solve(gram, matrix.T @ target)
            low = solution <= 1e-9
            if not low.any():
                values = solution
                break
            ratio = values[low] / np.maximum(values[low] - solution[low], 1e-12)
            values = values + ratio.min() * (solution - values)
            keep = ~(low & (values <= 1e-9))
            if keep.all():
                keep[np.flatnonzero(low)[int(np.argmin(ratio))]] = False
            matrix, active, values = matrix[:, keep], active[keep], values[keep]
        left = target - matrix @ values
        left[0] = 0.0
    return dict(zip(active.tolist(), values.tolist()))


def best_fit(histogram: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """Longest first, each into the sequences with the least room that holds it; by counts, not piece by piece."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        count = int(histogram[length])
        while count:
            room = next((r for r in range(length, capacity) if open_.get(r)), capacity)
            pattern, there = open_[room].pop() if room < capacity else ((), count)
            # The first piece leaves less room, so the next of its length follows it, while they fit.
            each = min(room // length, count)
            used = min(there, count // each)
            if there > used and room < capacity:
                open_[room].append((pattern, there - used))
            open_[room - each * length].append((pattern + (length,) * each, used))
            count -= each * used
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in open_.values():
        for pattern, n in groups:
            out[pattern] += n
    return dict(out)


def plan_of(histogram: np.ndarray, capacity: int) -> dict[tuple[int, ...], int]:
    """histogram[length]: number of pieces; pattern -> number of sequences. Every piece has a place."""
    left = histogram.astype(np.int64).copy()
    plan: dict[tuple[int, ...], int] = defaultdict(int)
    if left[capacity]:
        plan[(capacity,)] = int(left[capacity])
        left[capacity] = 0
    every = patterns_of(np.flatnonzero(left), capacity)
    shortest = np.where(every == 0, capacity, every).min(1) if len(every) else np.zeros(0)
    best: dict[tuple[int, ...], int] | None = None
    for least in LEAST:
        patterns = every[shortest >= capacity * least]
        fitted = sorted(fit(left, patterns).items(), key=lambda x: -x[1])
        for share in SHARES:
            rest, tried = left.copy(), defaultdict(int)
            for chosen, value in fitted:
                pattern = [int(x) for x in patterns[chosen] if x]
                most = min(rest[x] // pattern.count(x) for x in pattern)
                if times := int(min(value * share, most)):
                    tried[tuple(sorted(pattern, reverse=True))] += times
                    for x in pattern:
                        rest[x] -= times
            for pattern, times in best_fit(rest, capacity).items():
                tried[pattern] += times
            if best is None or sum(tried.values()) < sum(best.values()):
                best = tried
    for pattern, times in (best or {}).items():
        plan[pattern] += times
    return dict(plan)


def _places(plan: dict[tuple[int, ...], int], capacity: int) -> list[tuple[np.ndarray, ...] | None]:
    """By length: first rank, first sequence and offset of each run of places."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    next_rank, sequence = [0] * (capacity + 1), 0
    for pattern, times in plan.items():
        for length, offset in zip(pattern, accumulate((0, *pattern))):
            runs[length].append((next_rank[length], sequence, offset))
            next_rank[length] += times
        sequence += times
    return [tuple(np.array(c, np.int64) for c in zip(*r)) if r else None for r in runs]


def _placed(batches: Iterator[pa.RecordBatch], places: list) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            first, base, begin = places[one]
            run = np.searchsorted(first, rank[at], "right") - 1
            sequence[at], offset[at] = base[run] + rank[at] - first[run], begin[run]
        out = batch.drop_columns(["rank"])
        yield out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    pieces = docs.mapInArrow(lambda it: _pieces(it, tokenizer, capacity, end, with_ids), schema)
    pieces = stored(pieces.withColumn("number", F.monotonically_increasing_id()))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most capacity rows
        histogram[length] = n
    places = _places(plan_of(histogram, capacity), capacity)

    salts = F.array(*(F.lit(int(-(-n // GROUP)) or 1) for n in histogram))
    # By a stored number, not by content: copies of a piece are dealt out like any others.
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("number"), F.get(salts, F.col("length").cast("int"))))
    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # Two levels of sums: within blocks of salts, then over blocks, so no task sums a whole hot length alone.
    groups = groups.withColumn("block", F.expr("salt div 1024"))
    blocks = groups.groupBy("length", "block").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("length", "block", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    by = Window.partitionBy("length", "block").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("within", F.coalesce(F.sum("n").over(by), F.lit(0))).join(blocks, ["length", "block"])
    groups = groups.select("length", "salt", (F.col("before") + F.col("within")).alias("before"))
    by = Window.partitionBy("length", "salt").orderBy("number")
    ranked = pieces.withColumn("row", F.row_number().over(by)).join(groups, ["length", "salt"])
    ranked = ranked.select(*[f.split()[0] for f in schema.split(", ")], (F.col("before") + F.col("row") - 1).alias("rank"))
    out = T.StructType([*(f for f in ranked.schema if f.name != "rank"), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(lambda it: _placed(it, places), out)
