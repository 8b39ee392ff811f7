"""Tables in the shared folder, and links between rows that they join."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns that every operator here works with; others in a table are left alone.
DOCUMENT = ("doc_id", "text")


#: Bytes of an Arrow batch that goes to a Python worker at most (or one longer row): rows alone don't bound it.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session."""
    if spark.conf.get(_BATCH) != str(BATCH_BYTES):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; an error where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here, and a lost executor
    costs no earlier work. The tables stay until the folder is cleared, as a result is still read from them."""
    bound_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bits of a table for each different key, and of a table at least and at most (64 MB), as powers of two.
PER_KEY, LEAST_BITS, MOST_BITS = 128, 16, 29
#: Words of 64 bits that reach the driver as one value (64 KB).
BLOCK = 1 << 13


def bits_for(keys: int) -> int:
    """Bits of the table of so many different keys: a power of two."""
    return 1 << min(MOST_BITS, max(LEAST_BITS, (PER_KEY * keys - 1).bit_length()))


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """A table with two bits set for each key of a long column of hashes: one by its low half, one by its high half.

    Its size follows the number of different keys: of other keys, one in 4,000 has both bits by chance. From 2**22 keys on
    it stays at 2**MOST_BITS bits, so that it can be broadcast: then 1.5 % have them at 2**25 keys, 15 % at 2**27.
    """
    bits = bits_for(keys.agg(F.approx_count_distinct(column)).first()[0])
    places = keys.select(F.explode(F.array(F.col(column).bitwiseAND(bits - 1), F.shiftrightunsigned(column, 32).bitwiseAND(bits - 1))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast((place & 63) as int))")).alias("bits"))
    # Words reach the driver packed, as the bytes of a block of the table: a row a word would take it many times their size.
    pieces = words.withColumn("block", F.expr(f"word div {BLOCK}")).groupBy("block").applyInArrow(_packed, "block long, bytes binary").toArrow()
    table = np.zeros(max(bits // 64, BLOCK), np.int64)
    for block, piece in zip(pieces["block"], pieces["bytes"]):
        at = block.as_py() * BLOCK
        table[at : at + BLOCK] = np.frombuffer(piece.as_buffer(), np.int64)
    return table[: bits // 64].view(np.uint64)


def _packed(words: pa.Table) -> pa.Table:
    """The words of one block as its bytes."""
    block, held = words["block"][0].as_py(), np.zeros(BLOCK, np.int64)
    held[words["word"].to_numpy() - block * BLOCK] = words["bits"].to_numpy()
    return pa.table({"block": pa.array([block], pa.int64()), "bytes": pa.array([held.tobytes()], pa.binary())})


def in_table(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which unsigned keys have both bits set."""

    def there(place: np.ndarray) -> np.ndarray:
        place = place & np.uint64(64 * len(table) - 1)
        return (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    found = there(keys)
    at = np.flatnonzero(found)
    found[at] = there(keys[at] >> np.uint64(32))
    return found


def maybe_among(rows: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose long column key is among keys, and a few others: what is to be joined with keys, before
    it's shuffled. Null keys never pass."""
    place = F.xxhash64(key)
    bound_batches(rows.sparkSession)
    table = rows.sparkSession.sparkContext.broadcast(bit_table(keys.select(place.alias("place")), "place"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = in_table(np.asarray(batch.column("__place")).view(np.uint64), table.value)
            yield batch.filter(pa.array(there)).drop_columns(["__place"])

    return rows.where(F.col(key).isNotNull()).withColumn("__place", place).mapInArrow(passing, rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): node, component (its smallest node).

    Alternating large-star and small-star steps (Kiveris et al., 2014), in joins and minima alone: no
    neighbourhood is gathered into one row, and a hot node's join is one that Spark can split. An empty
    table of edges gives an empty result.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = stored(small)
        # Done, when every node has one edge down and none that has is another's centre.
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("centre")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("centre").alias("centre"))
        if ends.agg(F.max((F.col("down") + F.col("centre") > 1).cast("int"))).first()[0] != 1:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
