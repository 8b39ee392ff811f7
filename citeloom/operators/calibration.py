"""Confidences made probabilities, and cut-offs chosen from all of them. Scored rows: (confidence, correct).

Equal confidences are counted first. The rest works on ranges of confidences: no task sees more than one range, whatever
the number of different values. Rows without a confidence, or whose correctness is null, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from citeloom.sources.storage import stored

#: Ranges at most, and blocks of one at least.
PARTS, LEAST = 64, 1000
_BLOCK = "low double, high double, n long, right long"


def reliability(scored: DataFrame) -> DataFrame:
    """confidence, n, right of each different confidence."""
    rows = scored.where("confidence is not null and not isnan(confidence) and correct is not null")
    return rows.groupBy(F.col("confidence").cast("double").alias("confidence")).agg(F.count("*").alias("n"), F.sum(F.col("correct").cast("long")).alias("right"))


def range_cuts(points: DataFrame, column: str, parts: int = PARTS) -> list[float]:
    """At most ``parts`` - 1 values that cut a column in ranges of about as many rows."""
    return sorted(set(points.stat.approxQuantile(column, [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []


def _range(column: str, cuts: list[float]):
    """The number of the range that a value is in: how many cuts are at most it."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column))) if cuts else F.lit(0)


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of their ranges and values: neighbours of a range are merged while the earlier one isn't less
    often right."""
    now, stack = None, []

    def told() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c) for c in zip(*stack)], names=["low", "high", "n", "right"])

    for batch in batches:
        for part, *block in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high", "n", "right"))):
            if part != now and stack:
                yield told()
                stack = []
            now = part
            while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
                low, _, n, right = stack.pop()
                block = [low, block[1], n + block[2], right + block[3]]
            stack.append(block)
    if stack:
        yield told()


def isotonic(points: DataFrame, parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """points (confidence, n, right): low, high, n, right, probability: the closest step function that doesn't fall.

    Adjacent violators are pooled inside ranges of the blocks there are, then inside ranges that are shifted by half, until
    neither merges anything: any two neighbours are in one range of either kind, so nothing is left that falls.
    Ranges are cut anew as blocks become fewer, LEAST blocks or more in each. The order of pooling doesn't matter for the
    result.
    """
    blocks = stored(points.select(F.col("confidence").alias("low"), F.col("confidence").alias("high"), "n", "right"))
    left, before = blocks.count(), -1
    while left != before:
        before, cuts = left, range_cuts(blocks, "low", 2 * min(parts, -(-left // least) or 1))
        for some in (cuts[1::2], cuts[::2]):
            placed = blocks.withColumn("part", _range("low", some)).repartition(len(some) + 1, "part").sortWithinPartitions("part", "low")
            blocks = stored(placed.select("part", "low", "high", "n", "right").mapInArrow(_pooled, _BLOCK))
        left = blocks.count()
    return blocks.withColumn("probability", F.col("right") / F.col("n"))


def calibrate(points: DataFrame, blocks: DataFrame, parts: int = PARTS) -> DataFrame:
    """points (confidence, ...) with probability, of the last block that begins at or below; of the first, below all."""
    cuts = range_cuts(blocks, "low", parts)
    asked = points.select("confidence").distinct().withColumns({"part": _range("confidence", cuts), "p": F.lit(None).cast("double"), "turn": F.lit(1)})
    given = blocks.select(F.col("low").alias("confidence"), _range("low", cuts).alias("part"), F.col("probability").alias("p"), F.lit(0).alias("turn"))
    by = Window.partitionBy("part").orderBy("confidence", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = given.unionByName(asked).withColumn("last", F.last("p", ignorenulls=True).over(by)).where("turn = 1")
    # What holds at the start of a range is the last block of those before it: a row a range.
    ends = given.groupBy("part").agg(F.max_by("p", "confidence").alias("end"), F.min_by("p", "confidence").alias("least"))
    every = asked.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    before = every.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("held"), F.first("least", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("least"))
    found = found.join(F.broadcast(before), "part").select("confidence", F.coalesce("last", "held", "least").alias("probability"))
    return points.join(found, "confidence", "left")


def curve(points: DataFrame, parts: int = PARTS) -> DataFrame:
    """points (confidence, n, right) with coverage and precision of all rows at or above each confidence."""
    cuts = range_cuts(points, "confidence", parts)
    rows = points.withColumn("part", _range("confidence", cuts))
    totals = rows.groupBy("part").agg(F.sum("n").alias("n"), F.sum("right").alias("right"))  # a row a range
    above = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("right").over(above), F.lit(0)).alias("right_above"), F.sum("n").over(whole).alias("all"))
    by = Window.partitionBy("part").orderBy(F.desc("confidence")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(offsets), "part").withColumn("taken", F.sum("n").over(by) + F.col("n_above")).withColumn("hit", F.sum("right").over(by) + F.col("right_above"))
    return rows.select("confidence", "n", "right", (F.col("taken") / F.col("all")).alias("coverage"), (F.col("hit") / F.col("taken")).alias("precision"))


def choose_cutoffs(points: DataFrame, precision: float = 0.95, probability: float = 0.5, parts: int = PARTS) -> DataFrame:
    """One row: high, the least confidence from which on all rows together are right as often as ``precision``, with the
    coverage and precision there; low, the least confidence whose fitted probability is ``probability`` or more. Null,
    where there is none: candidates are all different confidences."""
    every = curve(points, parts)
    least = F.min(F.when(F.col("precision") >= precision, F.struct("confidence", "coverage", "precision"))).alias("x")
    low = isotonic(points, parts).agg(F.min(F.when(F.col("probability") >= probability, F.col("low"))).alias("low"))
    return every.agg(least).select(F.col("x.confidence").alias("high"), "x.coverage", "x.precision").crossJoin(F.broadcast(low))  # one row each
