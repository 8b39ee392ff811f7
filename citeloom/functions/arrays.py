"""Functions on arrays that Spark lacks: of columns, and of Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from citeloom.sources.storage import bound_batches

#: Sums that one step of running_ends copies at most, and how often sums are taken of blocks of blocks.
BLOCK, LEVELS = 16, 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_ends(lengths: Column) -> Column:
    """Sums of the first 1, 2, 3, ... of an array of integers; empty for an empty one.

    Sums of blocks come first, those of blocks of blocks before them, so a step copies a block at most: the cost is
    linear up to BLOCK ** (LEVELS + 1) elements, and a BLOCK ** LEVELS-th of quadratic beyond.
    """

    def after(cut: Column, before: Column) -> Column:
        sums = F.aggregate(cut, F.array(before), lambda out, x: F.array_append(out, F.element_at(out, -1) + x))
        return F.slice(sums, F.lit(2), F.size(cut))

    def ends(every: Column, level: int) -> Column:
        if not level:
            return after(every, F.lit(0))
        cut = lambda b: F.slice(every, b * BLOCK + 1, F.lit(BLOCK))
        blocks = F.sequence(F.lit(0), ((F.size(every) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(cut(b), F.lit(0), lambda a, x: a + x))
        before = let(totals, lambda t: ends(t, level - 1))
        whole = let(before, lambda upto: F.flatten(F.transform(blocks, lambda b: after(cut(b), F.when(b == 0, 0).otherwise(F.get(upto, b - 1))))))
        return F.when(F.size(every) <= BLOCK, after(every, F.lit(0))).otherwise(whole)

    return let(lengths, lambda every: F.when(F.size(every) > 0, ends(every, LEVELS)).otherwise(F.expr("cast(array() as array<int>)")))


def tile_offsets(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The strings of all lists, the bounds of each list among them, and the start and end of each string in code points of
    the text that its list tiles."""
    bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    strings = lists.flatten()
    length = pc.utf8_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(length)])
    end = sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds))
    return strings, bounds, end - length, end


def tiled(docs: DataFrame, x: Column, name: str, counted: bool = False) -> DataFrame:
    """doc_id, pos, start, end and the string (as name) of each string in x, an array that tiles a text; counted: and n, how
    many there are. Lengths are summed up over an Arrow batch: nothing is shuffled."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", x.alias("x")).where("x is not null")
    kinds = [("pos", "int"), ("start", "int"), ("end", "int"), (name, "string"), *([("n", "int")] if counted else [])]
    schema = rows.select("doc_id", *(F.lit(None).cast(kind).alias(c) for c, kind in kinds)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, bounds, start, end = tile_offsets(batch.column("x"))
            n = np.diff(bounds)
            mine = np.repeat(np.arange(len(n)), n)
            whole = lambda a: pa.array(a.astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(mine)), whole(np.arange(len(mine)) - bounds[mine]), whole(start), whole(end), strings]
            yield pa.record_batch(columns + ([whole(n[mine])] if counted else []), schema.names)

    return rows.mapInArrow(run, schema)
