"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

Documents with equal shingle sets are first joined by a fingerprint of the set, so a group of copies goes
on as one row. Each remaining row has BANDS * ROWS minima. Rows that share a band are candidates. Within a
bucket every row is first compared with the bucket's smallest row only. In buckets which the links so far
leave in several components, one row of each component is compared with one of each other; then, where that
still leaves several, all rows of different components. So every pair of one bucket is compared, or already
known to be connected, without a table of all pairs of a large group: two rows whose exact overlaps with a hub, a
row of the bucket's largest component, and bit maps of what each lacks of it and has beyond it, rule out the threshold
aren't paired. A pair at similarity 0.8 shares no band
with probability (1 - 0.8**ROWS)**BANDS, about 8e-6.

A candidate's signatures are compared in batches. After n values of which m agree, the posterior of the
similarity (uniform prior) is Beta(m + 1, n - m + 1); the pair is dropped once the probability that it
reaches the threshold falls below MISS. What survives is confirmed on full shingle sets.

Null or blank texts have an empty set and no link; each is its own component. Rows are linked, not ids: where
rows of one doc_id differ, each has its links, and all of that doc_id that aren't empty share a component. Repeated
rows give repeated result rows. A row without a doc_id takes part, its component is the smallest doc_id that it
reaches, null if it reaches none; it's kept only then.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm import arrays as A
from citeloom.llm.shared import components, maybe_among, stored

BANDS, ROWS, MISS, BATCH = 64, 8, 1e-5, 32
#: Values of a signature that are kept (a byte each), and those that are compared first (a bit each).
VALUES, SKETCH = 512, 256
#: Rows of a bucket's largest component from which on all of the bucket's rows are measured against its hub.
FAMILY = 8
#: Bits that show which shingles a set has beyond another's, or lacks of it.
MAP = 512
_rng = np.random.default_rng(7)
_SCALE = (_rng.integers(1, 2**32, (BANDS * ROWS, 2), dtype=np.uint32) | 1).astype(np.uint32)
U = np.uint64
#: A value's short forms are cut from its mix with one of these: the low bits of low * a + high * b are nearly the
#: same function of a shingle for every odd a and b.
_SALT = np.arange(1, BANDS * ROWS + 1, dtype=U) << U(32)


def shingles_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text and the texts they are of; a shorter text has one shingle."""
    words = A.words_of(texts, A.LOWER)
    hashes, count = A.span_hashes(words.data, words.start, words.end), words.count
    at, text = A.starts_of_grams(count, words.first, width)
    grams = A.gram_hashes(hashes, width)[at] if len(at) else np.zeros(0, U)
    for n in range(1, width):
        if len(short := np.flatnonzero(count == n)):
            grams, text = np.append(grams, A.gram_hashes(hashes, n)[words.first[short]]), np.append(text, short)
    order = np.argsort(text, kind="stable")
    return grams[order], text[order]


def distinct(grams: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, at = np.unique(A.keyed(grams, text), return_index=True)
    at.sort()
    return grams[at], text[at]


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in A.slices(batches, "text"):
        n = batch.num_rows
        grams, text = distinct(*shingles_of(batch.column("text"), width))
        size = np.bincount(text, minlength=n)
        has = np.flatnonzero(size)
        at = (np.cumsum(size) - size)[has]
        prints, least = np.zeros((n, 2), U), np.zeros((n, BANDS * ROWS), np.uint32)
        if len(has):
            prints[has, 0], prints[has, 1] = np.add.reduceat(grams, at), np.add.reduceat(A.mix(grams ^ U(0xA5A5A5A5)), at)
            low, high = grams.astype(np.uint32), (grams >> U(32)).astype(np.uint32)
            for k, (a, b) in enumerate(_SCALE):
                least[has, k] = np.minimum.reduceat(low * a + high * b, at)
        keys, short = np.zeros((n, BANDS), U), np.zeros((n, BANDS * ROWS), np.uint16)
        for band in range(BANDS):
            of = slice(band * ROWS, (band + 1) * ROWS)
            part = least[:, of].astype(U)
            short[:, of] = A.mix(part + _SALT[of]) >> U(48)
            key = np.full(n, band + 1, U)
            for k in range(ROWS):
                key = A.mix(key * U(0x9E3779B97F4A7C15) + part[:, k])
            keys[:, band] = key
        value = pa.array(keys.view(np.int64).ravel())
        sketch = np.packbits((short[:, :SKETCH] >> 15).astype(np.uint8), axis=1).view(np.int64)
        yield pa.record_batch(
            {
                "doc_id": batch.column("doc_id"),
                "row": batch.column("row"),
                "n_shingles": pa.array(size.astype(np.int64)),
                "print_a": pa.array(prints[:, 0].view(np.int64)),
                "print_b": pa.array(prints[:, 1].view(np.int64)),
                "signature": pa.array([x.tobytes() for x in (short[:, :VALUES] & 0xFF).astype(np.uint8)], pa.binary()),
                **{f"s{k}": pa.array(sketch[:, k]) for k in range(SKETCH // 64)},
                "keys": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), value),
            }
        )


def least_agreeing(similarity: float, values: list[int], chance: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(n, m) for each n of values: a pair of which fewer than m of the first n values agree is dropped.

    With a uniform prior, P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m). t is raised by the chance that
    shortened values agree where the full ones differ.
    """
    t = similarity + (1 - similarity) * chance
    out = []
    for n in values:
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _verified(batches: Iterator[pa.RecordBatch], rules: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, VALUES) for c in ("signature_a", "signature_b"))
        alive, agree, at = np.arange(n), np.zeros(n, np.int64), 0
        for to, need in rules:
            agree[alive] += (one[alive, at:to] == two[alive, at:to]).sum(1)
            alive, at = alive[agree[alive] >= need], to
        yield batch.select(["a", "b"]).take(pa.array(alive))


def _map(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    bits = np.zeros((n, MAP), np.uint8)
    bits[of, (hashes & U(MAP - 1)).astype(np.int64)] = 1
    return bits


def _confirmed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sizes of both sets, of what they share and of what only b has, and bit maps of the latter's hashes (m, with set
    bits) and of those that only a has (l)."""
    for batch in A.slices(batches, "text_a", "text_b"):
        n = batch.num_rows
        (one, of_one), (two, of_two) = (distinct(*shingles_of(batch.column(c), width)) for c in ("text_a", "text_b"))
        _, at, shared = np.intersect1d(A.keyed(one, of_one), A.keyed(two, of_two), assume_unique=True, return_indices=True)
        left, only = np.ones(len(one), bool), np.ones(len(two), bool)
        left[at], only[shared] = False, False
        more, lack = _map(two[only], of_two[only], n), _map(one[left], of_one[left], n)
        size = lambda of: pa.array(np.bincount(of, minlength=n).astype(np.int64))
        columns = {"a": batch.column("a"), "b": batch.column("b"), "n_a": size(of_one), "n_b": size(of_two), "both": size(of_one[at]), "more": size(of_two[only]), "set": pa.array(more.sum(1, dtype=np.int64))}
        longs = {f"{name}{k}": pa.array(x[:, k]) for name, bits in (("m", more), ("l", lack)) for x in [np.packbits(bits, axis=1).view(np.int64)] for k in range(MAP // 64)}
        yield pa.record_batch(columns | longs)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, a hash of both, of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def classified(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs as of identified(): doc_id, row, n_shingles, component_id, kept; a row each.

    Inside, a row is named by a number that is stored with its signature; a class of equal sets by the least one.
    """
    percent = round(100 * threshold)
    sketch, maps = [f"s{k}" for k in range(SKETCH // 64)], [f"{x}{k}" for x in "ml" for k in range(MAP // 64)]
    longs = lambda names: ", ".join(f"{x} long" for x in names)
    schema = f"doc_id long, row long, n_shingles long, print_a long, print_b long, signature binary, {longs(sketch)}, keys array<long>"
    signed = stored(docs.mapInArrow(lambda it: _signed(it, width), schema).withColumn("node", F.monotonically_increasing_id()))
    same = ["n_shingles", "print_a", "print_b"]
    # Copies go on as one row.
    alone = signed.where("n_shingles > 0").groupBy(*same).agg(F.min("node").alias("rep"), F.min("doc_id").alias("low"))
    classed = stored(signed.select("doc_id", "row", *same).join(alone.hint("merge"), same, "left").drop("print_a", "print_b"))
    of_class = signed.join(classed.where("rep is not null").select(F.col("rep").alias("node")).distinct().hint("merge"), "node", "left_semi")
    reps = stored(of_class.select("node", "doc_id", "row", "n_shingles", "signature", *sketch))
    bands = signed.select("node", "keys").join(reps.select("node").hint("merge"), "node", "left_semi").select("node", F.explode("keys").alias("key"))
    crowded = bands.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    crowded = bands.join(crowded.hint("merge"), "key").join(reps.select("node", "n_shingles", *sketch).hint("merge"), "node")
    crowded = stored(crowded.select("key", "first", "node", "n_shingles", *sketch))
    rules = least_agreeing(percent / 100, list(range(BATCH, VALUES + 1, BATCH)), 1 / 256)
    [(_, agreeing)] = least_agreeing(percent / 100, [SKETCH], 1 / 2)
    similar = f"both > 0 and 100 * both >= {percent} * (n_a + n_b - both)"
    # What the rows of a bucket show of a pair: sizes, and one bit of each of the first values.
    alike = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and " + " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in sketch) + f" <= {SKETCH - agreeing}"

    def likely(pairs: DataFrame) -> DataFrame:
        """Pairs that Bayesian verification of the signatures leaves."""
        both = pairs.join(reps.select(F.col("node").alias("a"), F.col("signature").alias("signature_a")).hint("merge"), "a")
        both = both.join(reps.select(F.col("node").alias("b"), F.col("signature").alias("signature_b")).hint("merge"), "b")
        return stored(both.select("a", "b", "signature_a", "signature_b").mapInArrow(lambda it: _verified(it, rules), "a long, b long"))

    def measured(pairs: DataFrame) -> DataFrame:
        """See _confirmed: pairs from full sets. Few texts take part; a bit table keeps the others from moving."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        nodes = stored(nodes.join(reps.select("node", F.col("doc_id").alias("id"), "row").hint("merge"), "node"))
        texts = maybe_among(docs, nodes, "row").join(nodes.hint("merge"), "row").where("doc_id <=> id")
        texts = stored(texts.select("node", "text").dropDuplicates(["node"]))
        both = pairs.join(texts.toDF("a", "text_a").hint("merge"), "a").join(texts.toDF("b", "text_b").hint("merge"), "b")
        schema = f"a long, b long, n_a long, n_b long, both long, more long, set long, {longs(maps)}"
        return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirmed(it, width), schema))

    def sides(rows: DataFrame, *keys: str) -> list[DataFrame]:
        other = [c for c in rows.columns if c not in keys]
        return [rows.select(*keys, *(F.col(c).alias({"node": x, "n_shingles": f"n_{x}"}.get(c, f"{c}_{x}")) for c in other)) for x in "ab"]

    one, two = sides(crowded.drop("first"), "key")
    firsts = crowded.where("node = first").select("key", F.col("first").alias("a"))
    star = firsts.join(one.hint("merge"), ["key", "a"]).join(two.hint("merge"), "key").where(f"a <> b and {alike}").select("a", "b").distinct()
    star = measured(likely(star))
    # Classes that hold different rows of one doc_id belong together.
    of_id = classed.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    of_id = classed.join(of_id.hint("merge"), "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
    edges = stored(star.where(similar).select("a", "b").union(of_id))
    found = components(edges)

    def parted() -> DataFrame:
        """crowded with part, the component of each row so far."""
        return crowded.join(found.hint("merge"), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    # One row of each component in a bucket, picked anew in each bucket; only picks are looked at for several.
    picked = F.min_by(F.struct("node", "n_shingles", *sketch), F.xxhash64("node", "key")).alias("x")
    picks = stored(parted().groupBy("key", "part").agg(picked).select("key", "part", "x.*"))
    one, two = sides(picks, "key")
    pairs = one.join(two.hint("merge"), "key").where(f"a < b and part_a <> part_b and {alike}").select("a", "b").distinct()
    edges = stored(edges.union(measured(likely(pairs)).where(similar).select("a", "b")))
    found = components(edges)

    # All rows of different components, but for those that a hub tells apart: the least node of the component that
    # has most of a bucket's rows, if it has FAMILY. All rows of the bucket are measured against it.
    sizes = parted().groupBy("key", "part").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("hub"))
    several = stored(sizes.where("parts > 1 and n > 2").select("key", F.col("hub.part").alias("first"), (F.col("hub.n") >= FAMILY).alias("large")))
    rows = stored(parted().drop("first").join(several.hint("merge"), "key"))
    known = star.select(F.col("a").alias("first"), F.col("b").alias("node"))
    rest = rows.where("large and node <> first").select("first", "node").distinct().join(known.hint("merge"), ["first", "node"], "left_anti")
    hubs = measured(rest.toDF("a", "b"))
    against = star.union(hubs).select(F.col("a").alias("first"), F.col("b").alias("node"), F.col("n_a").alias("n_first"), "both", "more", "set", *maps)
    near = stored(rows.where("not (large and node = first)").drop("large").join(against.hint("merge"), ["first", "node"], "left"))
    # Of the hub two sets share at most what neither lacks, and of the rest what their bit maps share and those of
    # the one hide. Hashes that meet in a bit only raise the bound.
    lacked = " + ".join(f"bit_count(l{k}_a | l{k}_b)" for k in range(MAP // 64))
    common = " + ".join(f"bit_count(m{k}_a & m{k}_b)" for k in range(MAP // 64))
    most = f"(least(both_a, both_b, n_first_a - ({lacked})) + least(more_a, more_b, {common} + least(more_a - set_a, more_b - set_b)))"
    bound = f"(both_a is null or both_b is null or {100 + percent} * {most} >= {percent} * (n_a + n_b))"
    one, two = sides(near, "key", "first")
    pairs = one.join(two.hint("merge"), ["key", "first"]).where(f"a < b and part_a <> part_b and {alike} and {bound}").select("a", "b").distinct()
    more = stored(measured(likely(pairs)).union(hubs).where(similar).select("a", "b"))
    if not more.isEmpty():
        found = components(edges.union(more))

    low = found.join(classed.where("rep is not null").groupBy("rep").agg(F.min("doc_id").alias("low")).withColumnRenamed("rep", "node").hint("merge"), "node")
    low = low.groupBy("component").agg(F.min("low").alias("component_id"))
    of_rep = found.join(low.hint("merge"), "component").select(F.col("node").alias("rep"), "component_id")
    out = classed.join(of_rep.hint("merge"), "rep", "left").withColumn("component_id", F.coalesce("component_id", "low", "doc_id"))
    return out.select("doc_id", "row", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id that links reach), kept."""
    return classified(identified(docs), width, threshold).drop("row")


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without those of which a near duplicate with a smaller doc_id is kept; all columns.

    Of a component, all rows of the smallest doc_id stay, so do all that reach no doc_id.
    """
    gone = classified(identified(docs), width, threshold).where("not kept").select(F.col("doc_id").alias("__id"), F.col("row").alias("__gone")).distinct()
    keys = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))).withColumn("__doc", F.col("doc_id").cast("long"))
    return keys.join(gone, (F.col("__row") == F.col("__gone")) & F.col("__doc").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)
