"""Benchmark passages in documents, found by spaced seeds: hits survive substituted words.

A seed mask fixes some token positions of a span and ignores the others; two texts that agree on the fixed
ones share a hash. Hashes of the benchmark under each mask are joined with those of the documents. The
documents' hashes first pass a bit table made from the benchmark's, so nearly all that can't
join is never shuffled; what passes is joined exactly. A hit brings its neighbourhood along, so the windows
around it are compared at once, and only what agrees there is looked up in the whole texts: a document is
contaminated when some window of WINDOW aligned tokens (or the whole item, if it is shorter) agrees in at least
AGREE percent of them. The masks of long items meet every such window. An item of fewer than WINDOW tokens is cut
into one piece more than it may have substitutions, so one piece stays whole, and those pieces are its seeds.

Tokens are runs of characters other than white space and ASCII punctuation, A-Z lower-cased. Null or empty
texts and items have no token and match nothing; items without an item_id are left out, items of fewer than
``least`` tokens too (1: none). Rows are judged, not ids: rows without a doc_id as others, rows of one doc_id
each by its text; equal rows and repeated items give the same result again. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm import arrays as A
from citeloom.llm.shared import bit_table, in_table, maybe_among, stored

#: Kept token positions are 1. Any 13 tokens with two substitutions hit at least one of these.
MASKS = ("1111011", "1101111", "11100111", "11111")
WINDOW, AGREE = 13, 80
#: Tokens before and after a seed's first that a hit brings along, and shifts that are looked up together.
BEFORE, AFTER, SHIFTS = WINDOW - 1, WINDOW, 256
U = np.uint64


def pieces_of(n: int) -> list[tuple[int, int]]:
    """Offset and length of the seeds of an item of n tokens, n < WINDOW."""
    edges = np.linspace(0, n, n * (100 - AGREE) // 100 + 2).astype(int).tolist()
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:]))))


def seeds_of(tokens: np.ndarray, words: A.Words, masks: Sequence[str]) -> tuple[np.ndarray, ...]:
    """hash, text, token position and mask of every seed of the masks."""
    out = []
    for number, mask in enumerate(masks):
        at, text = A.starts_of_grams(words.count, words.first, len(mask))
        seed = np.full(len(at), int(mask, 2), U)
        with np.errstate(over="ignore"):
            for offset, keep in enumerate(mask):
                if keep == "1":
                    seed = seed * U(0x9E3779B97F4A7C15) + tokens[at + offset]
        out.append((A.mix(seed), text, at - words.first[text], np.full(len(at), number)))
    return tuple(np.concatenate(c) for c in zip(*out))


def _alike(tokens: np.ndarray, words: A.Words, seed: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Seeds of one text with the same surroundings, as one row: which seeds stand for them, and columns at, size, near
    (the tokens from BEFORE before to AFTER after, 0 outside of the text, as bytes) and places (every at).

    Whether a window agrees depends on what lies around alone, so at and size are cut to that. Repetitive texts would
    else bring every place along with its surroundings.
    """
    places = at[:, None] + np.arange(-BEFORE, AFTER)
    size = words.count[text]
    inside = (places >= 0) & (places < size[:, None])
    flat = np.where(inside, words.first[text][:, None] + places, 0)
    near = np.where(inside, tokens[flat] if len(tokens) else U(0), U(0))
    before = np.minimum(at, BEFORE)
    whole = before + np.minimum(size - at, AFTER)
    key = A.keyed(seed, text)
    with np.errstate(over="ignore"):
        for k in range(BEFORE + AFTER):
            key = A.mix(key * U(0x9E3779B97F4A7C15) + near[:, k])
        key = A.mix(key + (before * (BEFORE + AFTER + 1) + whole).astype(U))
    _, first, of = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(of, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(first)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[order].astype(np.int64)))
    return first, {"at": pa.array(before[first].astype(np.int64)), "size": pa.array(whole[first].astype(np.int64)), "near": pa.array([x.tobytes() for x in near[first]], pa.binary()), "places": lists}


def _seeds(batches: Iterator[pa.RecordBatch], key: str, masks: Sequence[str], bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Seeds of documents (those in the bit table) or, without one, of items: long ones by MASKS, others by pieces."""
    for batch in A.slices(batches, "text"):
        words = A.words_of(batch.column("text"), A.PLAIN)
        tokens = A.span_hashes(words.data, words.start, words.end)
        seed, text, at, number = seeds_of(tokens, words, masks)
        if bits is not None:
            keep = in_table(seed, bits)
        else:
            size = words.count[text]
            keep = (size >= WINDOW) & (number < len(MASKS))
            length = np.array([len(mask) for mask in masks])[number]
            for n in range(1, WINDOW):
                for offset, m in pieces_of(n):
                    keep |= (size == n) & (at == offset) & (length == m) & (number >= len(MASKS))
        seed, text, at = seed[keep], text[keep], at[keep]
        first, columns = _alike(tokens, words, seed, text, at)
        yield pa.record_batch({"seed": pa.array(seed[first].view(np.int64)), key: batch.column(key).take(pa.array(text[first]))} | columns)


def shifts_between(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The different values of place less other, in memory of the order of their range."""
    few, many, sign = (others, places, 1) if len(others) <= len(places) else (places, others, -1)
    low = int(many.min() - few.max())
    there = np.zeros(int(many.max() - few.min()) - low + 1, bool)
    for x in few.tolist():
        there[many - x - low] = True
    return sign * (np.flatnonzero(there) + low)


def best_window(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """Largest share of agreeing tokens, in percent, over windows of the aligned texts, and the tokens agreeing."""
    window = min(WINDOW, len(item))
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high - low < window:
        return 0, 0
    sums = np.append(0, np.cumsum(doc[low + shift : high + shift] == item[low:high]))
    return int(100 * (sums[window:] - sums[:-window]).max() // window), int(sums[-1])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hits around which some window agrees."""
    for batch in batches:
        n = batch.num_rows
        doc, item = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(n, BEFORE + AFTER) for c in ("near", "item_near"))
        at, size, item_at, item_size = (np.asarray(batch.column(c))[:, None] for c in ("at", "size", "item_at", "item_size"))
        place = np.arange(-BEFORE, AFTER)
        inside = (at + place >= 0) & (at + place < size) & (item_at + place >= 0) & (item_at + place < item_size)
        zero = np.zeros((n, 1), np.int64)
        same, both = (np.hstack([zero, np.cumsum(x, 1)]) for x in (inside & (doc == item), inside))
        full = both[:, WINDOW:] - both[:, :-WINDOW] == WINDOW
        fine = (full & (100 * (same[:, WINDOW:] - same[:, :-WINDOW]) >= AGREE * WINDOW)).any(1)
        whole = (item_size < WINDOW) & (both[:, -1:] == item_size) & (100 * same[:, -1:] >= AGREE * item_size)
        fits = np.flatnonzero(fine | whole[:, 0])
        (first, count), (item_first, item_count) = ((np.asarray(x.offsets)[:-1], np.diff(np.asarray(x.offsets))) for x in (batch.column("places"), batch.column("item_places")))
        flat, item_flat = (np.asarray(batch.column(c).values) for c in ("places", "item_places"))
        # Most seeds stand alone; the others' places are taken one by one with each other.
        alone = fits[(count[fits] == 1) & (item_count[fits] == 1)]
        yield _shifted(batch, alone, flat[first[alone]] - item_flat[item_first[alone]])
        for k in np.setdiff1d(fits, alone):
            shifts = shifts_between(flat[first[k] : first[k] + count[k]], item_flat[item_first[k] : item_first[k] + item_count[k]])
            yield _shifted(batch, np.full(len(shifts), k), shifts)


def _shifted(batch: pa.RecordBatch, at: np.ndarray, shifts: np.ndarray) -> pa.RecordBatch:
    at = pa.array(at.astype(np.int64))
    return pa.record_batch({"row": batch.column("row").take(at), "item_id": batch.column("item_id").take(at), "shift": pa.array(shifts.astype(np.int64))})


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.slices(batches, "text"):
        words = A.words_of(batch.column("text"), A.PLAIN)
        tokens = A.span_hashes(words.data, words.start, words.end)
        lists = pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(tokens.view(np.int64)))
        yield pa.record_batch([batch.column("item_id"), lists, pa.array(words.count.astype(np.int32))], ["item_id", "tokens", "n"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in A.slices(batches, "text"):
        words = A.words_of(batch.column("text"), A.PLAIN)
        tokens = A.span_hashes(words.data, words.start, words.end).view(np.int64)
        items = [np.asarray(x.values) for x in batch.column("tokens")]
        found = [max(best_window(tokens[words.first[i] : words.first[i + 1]], items[i], shift) for shift in shifts) for i, shifts in enumerate(batch.column("shifts").to_pylist())]
        share, agree = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        yield pa.record_batch([batch.column("row"), batch.column("item_id"), share, agree], ["row", "item_id", "share", "agree"])


def _identified(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text): row (xxhash64 of doc_id and text), item_id, matched tokens of
    each overlap."""
    docs = _identified(docs)
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null").distinct()
    items = stored(benchmark.mapInArrow(_tokens, "item_id long, tokens array<long>, n int").where(f"n >= {max(1, least)}"))
    short = [r["n"] for r in items.where(f"n < {WINDOW}").select("n").distinct().collect()]  # fewer than WINDOW rows
    masks = MASKS + tuple("1" * m for m in sorted({m for n in short for _, m in pieces_of(n)}))
    schema = "seed long, {} long, at long, size long, near binary, places array<long>"
    item_seeds = benchmark.mapInArrow(lambda it: _seeds(it, "item_id", masks, None), schema.format("item_id"))
    item_seeds = stored(item_seeds.toDF("seed", "item_id", "item_at", "item_size", "item_near", "item_places").join(items.select("item_id").distinct(), "item_id", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(item_seeds, "seed"))
    hits = docs.select("row", "text").mapInArrow(lambda it: _seeds(it, "row", masks, shared.value), schema.format("row"))
    hits = hits.join(item_seeds.hint("merge"), "seed")
    found = hits.mapInArrow(_near, "row long, item_id long, shift long").distinct()
    found = stored(found.groupBy("row", "item_id", F.floor(F.col("shift") / SHIFTS).alias("part")).agg(F.collect_set("shift").alias("shifts")))
    rows = found.select("row").distinct()
    texts = maybe_among(docs.select("row", "text"), rows, "row").join(rows.hint("merge"), "row", "left_semi").dropDuplicates(["row"])
    both = found.join(items, "item_id").join(texts, "row").select("row", "item_id", "shifts", "tokens", "text")
    best = both.mapInArrow(_verified, "row long, item_id long, share long, agree long").where(f"share >= {AGREE}")
    return best.groupBy("row", "item_id").agg(F.max(F.struct("share", "agree"))["agree"].alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, n_items, item_ids (sorted, comma-joined), matched (most tokens), kept; one row a row of docs."""
    found = overlaps(docs, benchmark, least).groupBy("row").agg(
        F.countDistinct("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item_id")).cast("array<string>"), ",").alias("item_ids"), F.max("matched").alias("matched")
    )
    out = _identified(docs).select("doc_id", "row").join(found, "row", "left")
    none = F.col("n_items").isNull()
    return out.select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("matched", F.lit(0)).alias("matched"), none.alias("kept"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """docs without the rows that overlap an item; all columns."""
    rows = overlaps(docs, benchmark, least).select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).join(rows, "__row", "left_anti").select(*docs.columns)
