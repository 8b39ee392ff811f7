"""Predicted against true labels, spans, texts and URNs. Labels: (doc_id, pos, start, end, label)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import labels as L, markup, urn
from citeloom.functions.sequences import bit_edits, diagonal_edits
from citeloom.operators import labelling
from citeloom.sources.storage import bound_batches, stored


def drop_ignored(both: DataFrame) -> DataFrame:
    """Rows whose true label (column truth, ids) is not the ignored one."""
    return both.where(F.col("truth") != L.IGNORED)


def token_accuracy(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: n, accuracy over positions that both have."""
    both = truth.select("doc_id", "pos", F.col("label").alias("t")).join(predicted.select("doc_id", "pos", F.col("label").alias("p")), ["doc_id", "pos"])
    return accuracy(both, F.col("t"), F.col("p"))


def accuracy(both: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: n, accuracy of rows that hold both labels of a token."""
    return both.agg(F.count("*").alias("n"), F.avg((truth == predicted).cast("int")).alias("accuracy"))


def _entities(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, start, end, type, t and p: whether truth and prediction have the entity."""
    t, p = labelling.decode_entities(truth, "chunk"), labelling.decode_entities(predicted, "chunk")
    both = t.withColumns({"t": F.lit(1), "p": F.lit(0)}).unionByName(p.withColumns({"t": F.lit(0), "p": F.lit(1)}))
    return both.groupBy("doc_id", "start", "end", "type").agg(F.max("t").alias("t"), F.max("p").alias("p"))


def _by_type(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """type, t, p, h: how many entities the truth has, the prediction, and both."""
    return _entities(truth, predicted).groupBy("type").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum(F.col("t") * F.col("p")).alias("h"))


def entity_counts(rows: DataFrame) -> DataFrame:
    """type, t, p, h of rows (doc_id, tokens: array of structs with start and end, truth and predicted: arrays with a label for
    each token, none null): the same counts, where both sequences of a document stand in its row. A type and batch
    of rows gives one row to be summed."""
    bound_batches(rows.sparkSession)
    bounds = F.transform("tokens", lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    counts = rows.where("size(tokens) > 0").select(bounds.alias("tokens"), "truth", "predicted").mapInArrow(_counted, "type string, t long, p long, h long")
    return counts.groupBy("type").agg(*(F.sum(c).alias(c) for c in ("t", "p", "h")))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        first = np.asarray(tokens.offsets)[:-1] - tokens.offsets[0].as_py()
        places = tokens.flatten()
        start, end = (places.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        types: dict[str, int] = {}
        true, predicted = (_islands(batch.column(c).flatten(), first, start, end, types) for c in ("truth", "predicted"))
        every, of = np.unique(np.concatenate([true, predicted]), axis=0, return_inverse=True)
        of = of.reshape(-1)
        t, p = (np.bincount(of[side], minlength=len(every)) > 0 for side in (slice(len(true)), slice(len(true), None)))
        count = lambda which: pa.array(np.bincount(every[which, 3], minlength=len(types)))
        yield pa.record_batch([pa.array(list(types), pa.string()), *(count(x).cast(pa.int64()) for x in (t, p, t & p))], ["type", "t", "p", "h"])


def _islands(labels: pa.Array, first: np.ndarray, start: np.ndarray, end: np.ndarray, types: dict[str, int]) -> np.ndarray:
    """A row (row of the document, start, end, number of the type) an entity, as decode_entities in mode "chunk" gives."""
    known = labels.dictionary_encode()
    names, code = known.dictionary.to_pylist(), known.indices.to_numpy(zero_copy_only=False)
    kind = np.array([-1 if x == "O" else types.setdefault(x[2:], len(types)) for x in names], np.int64)[code]
    begins = np.array([x[:1] == "B" for x in names], bool)[code]
    before = np.roll(kind, 1)
    before[first[first < len(kind)]] = -1
    at = np.flatnonzero((kind >= 0) & (begins | (before != kind)))
    # An entity goes up to the next one, or the next label outside.
    stops = np.union1d(at, np.flatnonzero(kind < 0))
    stop = np.append(stops, len(kind))[np.searchsorted(stops, at, "right")]
    doc = np.searchsorted(first, at, "right") - 1
    stop = np.minimum(stop, np.append(first, len(kind))[np.searchsorted(first, at, "right")])
    n = stop - at
    cuts = np.cumsum(n) - n
    inner = np.arange(n.sum()) + np.repeat(at - cuts, n)
    low, high = (np.minimum.reduceat(start[inner], cuts), np.maximum.reduceat(end[inner], cuts)) if len(at) else (start[:0], end[:0])
    return np.column_stack([doc, low, high, kind[at]]).astype(np.int64).reshape(-1, 4)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def _scores(hit: Column, predicted: Column, true: Column) -> list[Column]:
    return [_ratio(hit, predicted).alias("precision"), _ratio(hit, true).alias("recall"), _ratio(2 * hit, predicted + true).alias("f1")]


def entity_prf(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: n_true, n_predicted, n_hit, precision, recall, f1 of entities with equal bounds and type."""
    return prf_of(_by_type(truth, predicted))


def prf_of(counts: DataFrame) -> DataFrame:
    """entity_prf from counts (type, t, p, h), as of entity_counts."""
    sums = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(n) for x, n in (("t", "n_true"), ("p", "n_predicted"), ("h", "n_hit"))))
    return sums.select("*", *_scores(F.col("n_hit"), F.col("n_predicted"), F.col("n_true")))


def classification_report(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """name (a type, or micro, macro, weighted), precision, recall, f1, support."""
    return report_of(_by_type(truth, predicted))


def report_of(counts: DataFrame) -> DataFrame:
    """classification_report from counts (type, t, p, h), as of entity_counts."""
    by = stored(counts)
    score = ["precision", "recall", "f1"]
    types = by.select(F.col("type").alias("name"), *_scores(F.col("h"), F.col("p"), F.col("t")), F.col("t").alias("support"))
    micro = by.agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h")).select(F.lit("micro").alias("name"), *_scores(F.col("h"), F.col("p"), F.col("t")), F.col("t").alias("support"))
    macro = types.agg(*(F.avg(s).alias(s) for s in score), F.sum("support").alias("support")).select(F.lit("macro").alias("name"), *score, "support")
    weighted = types.agg(*(_ratio(F.sum(F.col(s) * F.col("support")), F.sum("support")).alias(s) for s in score), F.sum("support").alias("support")).select(F.lit("weighted").alias("name"), *score, "support")
    return types.union(micro).union(macro).union(weighted)


def length_mismatch(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, n_true, n_predicted of documents whose sequences differ in length."""
    t, p = (x.groupBy("doc_id").agg(F.count("*").alias(n)) for x, n in ((truth, "n_true"), (predicted, "n_predicted")))
    both = t.join(p, "doc_id", "full_outer").select("doc_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_true", "n_predicted")))
    return both.where("n_true <> n_predicted")


def prediction_records(docs: DataFrame, predicted: DataFrame, tags: Sequence[str] = markup.TAGS, first: str = "bibl", second: str = "quote") -> DataFrame:
    """doc_id, original, stripped, predicted, and the citations in the original and the predicted text."""
    both = docs.select("doc_id", F.col("text").alias("original")).join(predicted.select("doc_id", F.col("text").alias("predicted")), "doc_id")
    found = lambda c: markup.extract_citations(F.col(c), first, second)
    return both.select("doc_id", "original", markup.strip_tags(F.col("original"), tags).alias("stripped"), "predicted", found("original").alias("original_citations"), found("predicted").alias("predicted_citations"))


def edit_distance_norm(pairs: DataFrame, chunk: int | None = 10_000) -> DataFrame:
    """pairs (doc_id, a, b): doc_id, distance: edits of aligned chunks over the longer lengths; 0 if both are empty.

    Without a chunk whole texts are compared along diagonals, so that few edits cost little however long the texts are.
    """
    longest = F.greatest(F.length("a"), F.length("b"))
    if chunk is None:
        return pairs.withColumn("edits", diagonal_edits(F.col("a"), F.col("b"))).select("doc_id", F.coalesce(F.try_divide(F.col("edits").cast("double"), longest), F.lit(0.0)).alias("distance"))
    rows = pairs.select("doc_id", "a", "b", F.explode(F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0)), F.lit(chunk))).alias("at"))
    rows = rows.select("doc_id", F.substring(F.col("a"), F.col("at") + 1, F.lit(chunk)).alias("a"), F.substring(F.col("b"), F.col("at") + 1, F.lit(chunk)).alias("b"))
    # One task would otherwise do all the chunks of its documents; they are dealt out evenly. The number is given,
    # because few bytes would be joined to one task, however long they take.
    rows = rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.md5("a"))
    rows = rows.select("doc_id", bit_edits(F.col("a"), F.col("b")).alias("edits"), F.greatest(F.length("a"), F.length("b")).alias("length"))
    sums = rows.groupBy("doc_id").agg(F.sum("edits").alias("edits"), F.sum("length").alias("length"))
    return sums.select("doc_id", _ratio(F.col("edits"), F.col("length")).alias("distance"))


def before_after_distance(gold: DataFrame, predicted: DataFrame, untagged: DataFrame, chunk: int | None = 10_000) -> DataFrame:
    """doc_id, after (predicted against gold), before (untagged against gold)."""
    pair = lambda x: gold.select("doc_id", F.col("text").alias("a")).join(x.select("doc_id", F.col("text").alias("b")), "doc_id")
    after, before = (edit_distance_norm(pair(x), chunk).withColumnRenamed("distance", n) for x, n in ((predicted, "after"), (untagged, "before")))
    return after.join(before, "doc_id")


def urn_metrics(ranked: DataFrame, k: int = 3) -> DataFrame:
    """ranked (id, truth, candidate, rank from 1): one row of exact, author, work and passage accuracy of the first
    candidate, coverage, and the share of truths among the first k."""
    # Parts are compared of first candidates alone, so no other is taken apart.
    of_first = lambda c: urn.parse(F.when(F.col("rank") <= 1, F.col(c)))
    rows = ranked.withColumns({"t": of_first("truth"), "c": of_first("candidate")})
    t, c = F.col("t"), F.col("c")
    rows = rows.select("id", "rank", (F.col("truth") == F.col("candidate")).alias("exact"), F.col("candidate").isNotNull().alias("covered"), *((t[p] == c[p]).alias(p) for p in ("author", "work", "passage")))
    flag = lambda c, top: F.max(F.coalesce(F.when(F.col("rank") <= top, F.col(c)), F.lit(False)).cast("int")).alias(c if top == 1 else "top")
    by = rows.groupBy("id").agg(*(flag(c, 1) for c in ("exact", "author", "work", "passage", "covered")), flag("exact", k))
    return by.agg(F.count("*").alias("n"), *(F.avg(c).alias(n) for c, n in (("exact", "exact"), ("author", "author_accuracy"), ("work", "work_accuracy"), ("passage", "passage_accuracy"), ("covered", "coverage"), ("top", "precision_at_k"))))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """scored (confidence, correct): threshold, coverage, precision. Every row is read once for all thresholds."""
    rows = scored.withColumn("threshold", F.explode(F.array(*map(F.lit, sorted(set(thresholds))))))
    taken = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False)).cast("int")
    sums = rows.groupBy("threshold").agg(F.count("*").alias("n"), F.sum(taken).alias("taken"), F.sum(taken * F.col("correct").cast("int")).alias("right"))
    return sums.select("threshold", (F.col("taken") / F.col("n")).alias("coverage"), _ratio(F.col("right"), F.col("taken")).alias("precision"))
