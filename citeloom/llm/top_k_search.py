"""Exact top-k by inner product: columnar branch and bound over blocks of vectors.

Vectors lie in blocks in vertical layout, one run of values a dimension. A block of queries meets a block of
candidates: scores are summed dimension block by dimension block, and after each of them only pairs stay whose
sum so far, plus the most that the remaining mass of both vectors can add (Cauchy-Schwarz), reaches the query's
k-th best score so far. Few survivors go on as a list of pairs, many as a smaller matrix.

Every block of queries first meets one block of candidates, which bounds its k-th scores from below; then, in a grid of
cells, all the others. A cell keeps k rows a query, so what is merged in the end is k rows for each query and cell.
Nothing is broadcast: queries grow with the table. A task holds one block of each kind at a time.

Components become floor(64 * x), x as double. Vectors that are null or hold a null or non-finite component take no
part; vectors of different lengths aren't compared, those of length 0 have score 0. Repeated rows are rows of their own:
each is a query (if its vec_id is divisible) and a candidate of the others. A null vec_id is never a query; as a
candidate it comes last among ties. Scores must fit a long. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.shared import bound_batches, stored

SCALE, K, EVERY = 64, 20, 20
#: Vectors of a block, and bytes of its components at most.
QUERIES, CANDIDATES, BLOCK_BYTES = 1024, 8192, 4 << 20
#: Dimensions that are added at once, queries that are looked at together, share of pairs from which they are listed.
DIMENSIONS, TILE, FEW = 16, 64, 0.1
#: Blocks of each kind in a cell of the grid.
CELL = 8
_LAST = np.iinfo(np.int64).max
_BLOCK = "block long, d int, n int, ids binary, rows binary, values binary"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of long) and row, a number of the row, of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("x"), F.monotonically_increasing_id().alias("row"))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in blocks of one length d: components dimension by dimension, in as few bytes as they need."""

    def block(d: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, rows, x = (np.concatenate(p) for p in zip(*parts))
        top = max(-int(x.min()) - 1, int(x.max())) if x.size else 0
        kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max)
        values = np.ascontiguousarray(x.T.astype(kind))
        columns = {"block": [int(rows[0])], "d": [d], "n": [len(ids)], "ids": [ids.tobytes()], "rows": [rows.tobytes()], "values": [values.tobytes()]}
        return pa.record_batch([pa.array(v, t) for v, t in zip(columns.values(), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=list(columns))

    waiting: dict[int, list] = {}
    for batch in batches:
        lists = batch.column("x")
        size = np.diff(np.asarray(lists.offsets))
        ids, rows = np.asarray(batch.column("vec_id").fill_null(_LAST)), np.asarray(batch.column("row"))
        flat, first = np.asarray(lists.flatten()), np.cumsum(size) - size
        for d in np.unique(size).tolist():
            of, fit = np.flatnonzero(size == d), max(1, min(most, BLOCK_BYTES // (8 * max(d, 1))))
            for at in range(0, len(of), fit):
                some = of[at : at + fit]
                held = waiting.setdefault(d, [])
                if held and sum(len(p[0]) for p in held) + len(some) > fit:
                    yield block(d, waiting.pop(d))
                    held = waiting.setdefault(d, [])
                held.append((ids[some], rows[some], flat[first[some][:, None] + np.arange(d)].reshape(len(some), d)))
    for d, held in waiting.items():
        if held:
            yield block(d, held)


def _matrix(values: bytes, d: int, n: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(values) // (d * n)] if d * n else np.int8
    return np.frombuffer(values, kind).reshape(d, n)


def _rest(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms of what stands from each cut on, a little above their true values."""
    square = np.square(x.astype(np.float64))
    return np.array([np.sqrt(square[c:].sum(0)) * (1 + 1e-9) for c in cuts]).reshape(len(cuts), x.shape[1])


class Best:
    """The k best (score, id) of each query of a block so far; floor is a score that the k-th surely reaches."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, -np.inf) if floor is None else floor.copy()
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.append(self.query, query), np.append(self.score, score), np.append(self.id, ids)
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]


def search(best: Best, queries: np.ndarray, query_rows: np.ndarray, candidates: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
    """Adds to best what candidates (dimensions x n) have for queries (dimensions x m): branch and bound."""
    d = len(queries)
    cuts = list(range(0, d, DIMENSIONS)) or [0]
    q_rest, c_rest = _rest(queries, [*cuts[1:], d]), _rest(candidates, [*cuts[1:], d])
    largest = float(_rest(queries, [0]).max(initial=0) * _rest(candidates, [0]).max(initial=0))
    # Sums of products are at most the product of the norms: exact in the first type that holds it.
    kind = np.float32 if largest < 2**23 else np.float64 if largest < 2**52 else np.int64
    q, c = queries.astype(kind), candidates.astype(kind)
    slack = largest * 1e-12 if kind is np.int64 else 0.0
    for at in range(0, queries.shape[1], TILE):
        of = slice(at, at + TILE)
        part, floor, alive, few = q[:, of], best.floor[of], np.arange(candidates.shape[1]), None
        sums = np.zeros((part.shape[1], len(alive)), kind)
        for step, begin in enumerate(cuts):
            dims = slice(begin, begin + DIMENSIONS)
            if few is None:
                sums += part[dims].T @ c[dims][:, alive] if len(alive) < candidates.shape[1] else part[dims].T @ c[dims]
                stay = sums + np.outer(q_rest[step, of], c_rest[step, alive]).astype(sums.dtype if kind is np.float32 else np.float64) * (1 + 1e-5) >= floor[:, None] - slack
                if stay.mean() <= FEW or begin == cuts[-1]:
                    i, j = np.nonzero(stay)
                    few, sums = (i, alive[j]), sums[i, j]
                elif not (some := stay.any(0)).all():
                    alive, sums = alive[some], sums[:, some]
            else:
                i, j = few
                for e in range(begin, min(begin + DIMENSIONS, d)):
                    sums += part[e, i] * c[e, j]
                stay = sums + q_rest[step, of][i] * c_rest[step, j] * (1 + 1e-9) >= floor[i] - slack
                few, sums = (i[stay], j[stay]), sums[stay]
        i, j = few
        other = query_rows[at + i] != rows[j]
        best.add(at + i[other], sums[other].astype(np.int64), ids[j[other]])


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Joined blocks: the k best of each query, for each run of rows with one block of queries."""
    now, best = None, None

    def told() -> pa.RecordBatch:
        at = best.query
        known = pa.array(best.id, mask=best.id == _LAST)
        return pa.record_batch({"block": pa.array(np.full(len(at), now, np.int64)), "at": pa.array(at.astype(np.int32)), "row": pa.array(query_rows[at]), "query_id": pa.array(query_ids[at]), "score": pa.array(best.score), "vec_id": known})

    for batch in batches:
        for x in batch.to_pylist():
            if x["q_block"] != now:
                if best is not None:
                    yield told()
                now, n = x["q_block"], x["q_n"]
                query_ids, query_rows = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["q_rows"], np.int64)
                queries = _matrix(x["q_values"], x["d"], n)
                best = Best(n, k, np.frombuffer(x["floor"], np.float64) if x["floor"] is not None else None)
            search(best, queries, query_rows, _matrix(x["values"], x["d"], x["n"]), np.frombuffer(x["rows"], np.int64), np.frombuffer(x["ids"], np.int64))
    if best is not None:
        yield told()


def _floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, found in zip(batch.column("q_n").to_pylist(), batch.column("found").to_pylist()):
            floor = np.full(n, -np.inf)
            for x in found or ():
                floor[x["at"]] = x["least"]
            out.append(floor.tobytes())
        yield batch.drop_columns(["found"]).append_column("floor", pa.array(out, pa.binary()))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """vectors (vec_id, embedding): for each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    bound_batches(spark)
    whole = stored(whole_vectors(vectors))
    blocks = lambda rows, most: rows.mapInArrow(lambda it: _blocks(it, most), _BLOCK)
    candidates = stored(blocks(whole, CANDIDATES))
    asked = whole.where(F.col("vec_id") % every == 0)
    n_asked = asked.count()
    queries = blocks(asked.repartition(max(1, min(2000, n_asked // (4 * TILE))), "row"), QUERIES)
    queries = stored(queries.select("d", *(F.col(c).alias(f"q_{c}") for c in ("block", "n", "ids", "rows", "values"))))
    n_queries, n_candidates = queries.count(), candidates.count()
    rows, columns = -(-n_queries // CELL) or 1, -(-n_candidates // CELL) or 1
    parts = max(1, min(4000, rows * columns, n_queries * n_candidates))
    result = "block long, at int, row long, query_id long, score long, vec_id long"

    # One block of candidates for each block of queries: some block of its length.
    seeds = candidates.groupBy("d").agg(F.min("block").alias("seed"))
    seeded = queries.join(seeds, "d").withColumn("floor", F.lit(None).cast("binary")).repartition(max(1, min(4000, n_queries)), "q_block")
    with_seed = seeded.join(candidates.drop("d"), F.col("seed") == F.col("block"))
    first = stored(with_seed.select("d", "floor", *(c for c in queries.columns if c != "d"), "n", "ids", "rows", "values").mapInArrow(lambda it: _searched(it, k), result))
    least = first.groupBy("block", "at").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    least = least.groupBy(F.col("block").alias("q_block")).agg(F.collect_list(F.struct("at", "least")).alias("found"))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    bounded = stored(queries.join(least, "q_block", "left").select(*queries.columns, "found").mapInArrow(_floors, f"{names}, floor binary"))

    # The grid: each block of queries goes to every column of cells, each block of candidates to every row of them.
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = bounded.join(seeds, "d").withColumn("down", place("q_block", rows).cast("int")).withColumn("across", spread(columns))
    right = candidates.withColumn("across", place("block", columns).cast("int")).withColumn("down", spread(rows))
    cell = ["d", "down", "across"]
    met = left.repartition(parts, *cell).join(right.repartition(parts, *cell).hint("merge"), cell).where("block <> seed")
    rest = met.select("d", "floor", *(c for c in queries.columns if c != "d"), "n", "ids", "rows", "values").mapInArrow(lambda it: _searched(it, k), result)

    rank = F.expr("row_number() over (partition by row order by score desc, vec_id asc nulls last)")
    return first.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle_sql(k: int = K, every: int = EVERY) -> str:
    return f"""WITH x AS (SELECT vec_id, row_number() OVER () AS i, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
s AS (SELECT q.vec_id AS query_id, q.i, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score FROM x q JOIN x c ON q.i <> c.i AND len(q.x) = len(c.x) WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
