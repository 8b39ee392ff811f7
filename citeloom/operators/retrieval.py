"""Dense retrieval: an inverted file over vectors, and votes of what it finds. Vectors: (id, vector), ids unique.

Centroids are trained on a bounded sample (a parameter), every vector is put in the list of its nearest one. A query
probes the lists whose centroids are most similar, in order, and all their members are ranked by their exact cosine.
Lists and the queries that probe them meet in blocks, so a list that holds many vectors is many rows, and what a task
sees is two blocks. Vectors that are null, zero or hold a null or non-finite component take no part; no more do those
of another length than the index has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from citeloom.sources.storage import stored

#: Members and queries of a block.
MEMBERS, QUERIES = 4096, 512
_FOUND = "query long, id long, similarity double"


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """id, vector (array of double, length 1) of the vectors that take part."""
    x = F.col("vector").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    rows = vectors.where(F.col("vector").isNotNull() & fine).select(F.col("id").cast("long").alias("id"), x.alias("x"), norm.alias("norm")).where("norm > 0")
    return rows.select("id", F.transform("x", lambda v: v / F.col("norm")).alias("vector"))


def centroids(vectors: DataFrame, lists: int = 32, sample: int = 100_000, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """``lists`` unit centroids by k-means, trained on the ``sample`` unit vectors that a hash of their ids picks."""
    some = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample)
    model = KMeans(k=lists, maxIter=rounds, seed=seed, featuresCol="features", distanceMeasure="cosine").fit(some.select(array_to_vector("vector").alias("features")))
    found = np.array(model.clusterCenters())
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _nearest(batches: Iterator[pa.RecordBatch], centres: np.ndarray, probes: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for each of its ``probes`` nearest lists."""
    d = centres.shape[1]
    for batch in batches:
        batch = batch.filter(pa.array(np.diff(np.asarray(batch.column("vector").offsets)) == d))
        x = np.asarray(batch.column("vector").flatten()).reshape(-1, d)
        near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
        again = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
        yield pa.record_batch({"list": pa.array(near.ravel().astype(np.int32)), "id": batch.column("id").take(again), "vector": batch.column("vector").take(again)})


def in_lists(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    return vectors.select("id", "vector").mapInArrow(lambda it: _nearest(it, centres, probes), "list int, id long, vector array<double>")


def inverted_file(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """list, id, vector of every unit vector, stored."""
    return stored(in_lists(vectors, centres))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """list, <name>_block, <name>_ids, <name>_vectors: rows of a list in blocks of about size."""
    counts = rows.groupBy("list").agg(F.ceil(F.count("*") / size).alias("blocks"))
    placed = rows.join(F.broadcast(counts), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))  # a row a list
    held = F.collect_list(F.struct("id", "vector"))
    return placed.groupBy("list", "block").agg(held.alias("x")).select("list", F.col("block").alias(f"{name}_block"), F.col("x.id").alias(f"{name}_ids"), F.col("x.vector").alias(f"{name}_vectors"))


def _ranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in range(batch.num_rows):
            ids, others = (np.asarray(batch.column(c)[x].values) for c in ("q_ids", "m_ids"))
            one, two = (np.asarray(batch.column(c)[x].values.flatten()).reshape(len(of), -1) for c, of in (("q_vectors", ids), ("m_vectors", others)))
            scores = one @ two.T
            scores[ids[:, None] == others[None, :]] = -np.inf
            order = np.argsort(others, kind="stable")
            best = order[np.argsort(-scores[:, order], axis=1, kind="stable")[:, :k]]
            near = np.take_along_axis(scores, best, 1)
            at, place = np.nonzero(np.isfinite(near))
            yield pa.record_batch({"query": pa.array(ids[at]), "id": pa.array(others[best[at, place]]), "similarity": pa.array(near[at, place])})


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 8) -> DataFrame:
    """queries (id, vector): query, id, similarity, rank of the k most similar members of the probed lists, without itself."""
    asked = _blocks(in_lists(queries, centres, probes), QUERIES, "q")
    met = asked.join(_blocks(index, MEMBERS, "m").hint("merge"), "list").select("q_ids", "q_vectors", "m_ids", "m_vectors")
    # Little is read for what is computed: the pairs of blocks are dealt out by number.
    met = met.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _first(met.mapInArrow(lambda it: _ranked(it, k), _FOUND), k)


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.expr("row_number() over (partition by query order by round(similarity, 9) desc, id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact(queries: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """The same over all vectors: one list."""
    whole = lambda x: x.select(F.lit(0).alias("list"), "id", "vector")
    met = _blocks(whole(queries), QUERIES, "q").join(_blocks(whole(vectors), MEMBERS, "m"), "list").select("q_ids", "q_vectors", "m_ids", "m_vectors")
    met = met.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _first(met.mapInArrow(lambda it: _ranked(it, k), _FOUND), k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth (query, id) that found has."""
    both = truth.select("query", "id", F.lit(1).alias("all")).join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    row = both.agg(F.sum("all").alias("n"), F.sum("hit").alias("hit")).first()
    return (row.hit or 0) / row.n if row.n else 1.0


def probes_for(vectors: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 10, least: float = 0.9, sample: int = 500, seed: int = 43) -> int:
    """The fewest probes (1, 2, 3, 4, 6, 9, ... all lists) with which ``sample`` queries, picked by a hash, reach the recall."""
    some = stored(vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample))
    truth, probes = stored(exact(some, vectors, k)), 1
    while probes < len(centres) and recall(search(some, index, centres, k, probes), truth) < least:
        probes += max(1, probes // 2)
    return min(probes, len(centres))


def vote(found: DataFrame, labels: DataFrame) -> DataFrame:
    """found (query, id, similarity), labels (id, label): query, label, share, n: the label with most similarity behind
    it (ties: more rows, then the lesser), its share of all, and its rows. Members without a label don't vote."""
    sums = found.join(labels.where("label is not null"), "id").groupBy("query", "label").agg(F.sum(F.greatest("similarity", F.lit(0.0))).alias("weight"), F.count("*").alias("n"))
    best = F.min(F.struct((-F.round("weight", 9)).alias("less"), (-F.col("n")).alias("fewer"), "label")).alias("best")
    out = sums.groupBy("query").agg(best, F.sum("weight").alias("total"))
    return out.select("query", F.col("best.label").alias("label"), F.coalesce(F.try_divide(-F.col("best.less"), "total"), F.lit(0.0)).alias("share"), (-F.col("best.fewer")).alias("n"))
