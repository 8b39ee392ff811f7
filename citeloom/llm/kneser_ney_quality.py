"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model has order 5 over 128 symbols of UTF-8 bytes: each printable ASCII character is one, and bytes of longer
characters are told apart by script and by the low bits of what follows. 5-grams of all trusted documents are
counted, as many as there are; they and the 4-grams below them stay in shards, which are joined with the n-grams that
each block of documents asks for, and the answers go back to the blocks, which score their documents. Tables of
three symbols and fewer have at most 128**3 entries whatever the corpus; they alone are broadcast.

Of the trusted documents one in CALIBRATE, by a hash of its doc_id, isn't learned from: what the model has seen it
finds likelier than new text of the same kind. A document is kept when its perplexity is at most the QUANTILE of
those of its language, times SLACK; a language without any takes the quantile of all its documents, and rows without
a language share one group.

Null or empty texts have no perplexity and aren't kept. Repeated rows are scored alike, rows without a doc_id too (no
label is theirs). Repeated labels of a document count once; one that is trusted in one row and not in another is
trusted. Without any trusted text every symbol is as likely. Blocks hold about BLOCK_BYTES of text, or one longer
document. Other columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from citeloom.llm import arrays as A
from citeloom.llm.shared import maybe_among, stored

BITS, ORDER = 7, 5
SYMBOLS_N, DENSE = 1 << BITS, 1 << 3 * BITS
#: Codes of 5-grams carry this bit, so that they and 4-grams can share a table.
TOP = 1 << 40
QUANTILE, SLACK, BLOCK_BYTES, CALIBRATE = 0.995, 1.1, 64 << 20, 5
#: Languages whose limits are sent to every task at most.
BROADCAST_ROWS = 100_000


def _symbols() -> np.ndarray:
    """Symbol of each byte, 0 for none: ASCII from 1 on, then 16 classes of inner bytes, then groups of lead bytes."""
    out = np.full(256, 97, np.int64)  # other control characters
    out[0x20:0x7F] = 1 + np.arange(95)
    out[0x0A] = 96
    out[0x80:0xC0] = 98 + np.arange(64) % 16
    for i, first in enumerate((0xC0, 0xC4, 0xCA, 0xCE, 0xD0, 0xD2, 0xD5, 0xD8, 0xE0, 0xE2, 0xE3, 0xE4, 0xEA, 0xF0)):
        out[first:] = 114 + i
    return out


SYMBOLS = _symbols()


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each byte of each text (four empty symbols stand before it), and text sizes."""
    data, at = A.text_bytes(texts)
    size, before = np.diff(at), ORDER - 1
    place = np.arange(len(data)) + before * (np.repeat(np.arange(len(size)), size) + 1)
    padded = np.zeros(len(data) + before * len(size), np.int64)
    padded[place] = SYMBOLS[data]
    out = np.zeros(len(data), np.int64)
    for k in range(before, -1, -1):
        out = out << BITS | padded[place - k]
    return out, size


def lower(code: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols of a code."""
    return code & ((1 << n * BITS) - 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [np.unique(codes_of(part.column("text"))[0], return_counts=True) for part in A.slices(iter([batch]), "text")]
        if each:
            codes, where = np.unique(np.concatenate([c for c, _ in each]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n for _, n in each]), len(codes))
            yield pa.record_batch({"code": pa.array(codes), "n": pa.array(n.astype(np.int64))})


def discounts(count_of_counts: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from n1..n4 (Chen and Goodman); one half, where too few counts give none."""
    n = count_of_counts.astype(float)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
    out = np.array([k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 for k in (1, 2, 3)])
    return np.clip(out, 0.05, [0.95, 1.9, 2.8])


def lower_order(adjusted: np.ndarray, below: np.ndarray) -> np.ndarray:
    """p(last | rest) of one order, dense: adjusted counts shaped (contexts, symbols), and p of the order below."""
    d = np.append(0.0, discounts(np.array([(adjusted == k).sum() for k in (1, 2, 3, 4)])))
    kind = np.minimum(adjusted, 3).astype(int)
    total = adjusted.sum(1, keepdims=True)
    left = d[kind].sum(1, keepdims=True)
    safe = np.maximum(total, 1)
    return np.where(total > 0, (adjusted - d[kind]) / safe + left / safe * below, below)


def lower_tables(continuations: np.ndarray) -> np.ndarray:
    """p3 for each trigram, from how many symbols were seen before each trigram."""
    s = SYMBOLS_N
    tri = continuations.reshape(s, s, s)
    bi = (tri > 0).sum(0)
    uni = (bi > 0).sum(0)
    p1 = lower_order(uni.reshape(1, s), np.full((1, s), 1 / s))
    p2 = lower_order(bi, p1)
    return lower_order(tri.reshape(s * s, s), np.tile(p2, (s, 1))).reshape(-1)


def _shares(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """counts (code, n) of one order: share (code, share), the discounted n over its context's total, and context
    (context, gamma), what is left for the order below."""
    few = {r["n"]: r["count"] for r in counts.where("n <= 4").groupBy("n").count().collect()}
    d = discounts(np.array([few.get(k, 0) for k in (1, 2, 3, 4)])).tolist()
    kinds = [F.count(F.when(c, 1)) for c in (F.col("n") == 1, F.col("n") == 2, F.col("n") > 2)]
    context = counts.groupBy(F.shiftright("code", BITS).alias("context")).agg(F.sum("n").alias("total"), sum((d[k] * kinds[k] for k in (1, 2)), d[0] * kinds[0]).alias("left"))
    context = context.select("context", "total", (F.col("left") / F.col("total")).alias("gamma"))
    taken = F.element_at(F.array(*map(F.lit, d)), F.least("n", F.lit(3)).cast("int"))
    share = counts.withColumn("context", F.shiftright("code", BITS)).join(context.hint("merge"), "context")
    return share.select("code", ((F.col("n") - taken) / F.col("total")).cast("float").alias("share")), context.select("context", F.col("gamma").cast("float").alias("gamma"))


def _dense(rows: DataFrame, key: str, value: str, empty: float, kind: type) -> np.ndarray:
    out = np.full(DENSE, empty, kind)
    found = rows.select(key, value).toPandas()  # at most DENSE rows
    out[found[key].to_numpy(np.int64)] = found[value]
    return out


def train(trusted: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """trusted (text): weights (code, share, gamma) of 5-grams (with TOP; their share) and 4-grams (their share, and
    gamma as the context of a 5-gram), gamma by context of three symbols, and p3."""
    counts = stored(trusted.select("text").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    below = stored(counts.groupBy(F.col("code").bitwiseAND((1 << 4 * BITS) - 1).alias("code")).agg(F.count("*").alias("n")))
    share5, context5 = _shares(counts)
    share4, context4 = _shares(below)
    least = below.groupBy(F.col("code").bitwiseAND(DENSE - 1).alias("code")).agg(F.count("*").alias("n"))
    gamma, p3 = _dense(context4, "context", "gamma", 1.0, np.float32), lower_tables(_dense(least, "code", "n", 0, np.int64))
    four = share4.join(context5.withColumnRenamed("context", "code"), "code", "full_outer")
    four = four.select("code", F.coalesce("share", F.lit(0.0).cast("float")).alias("share"), F.coalesce("gamma", F.lit(1.0).cast("float")).alias("gamma"))
    five = share5.select((F.col("code") + F.lit(TOP)).alias("code"), "share", F.lit(1.0).cast("float").alias("gamma"))
    return stored(five.union(four)), gamma, p3.astype(np.float32)


def _asked(table: pa.Table) -> pa.Table:
    """The different 5-grams of a block, and the 4-grams at either end of them."""
    each = [np.unique(codes_of(part.column("text"))[0]) for part in A.slices(iter(table.to_batches()), "text")]
    five = np.unique(np.concatenate([np.zeros(0, np.int64), *each]))
    codes = np.concatenate([five + TOP, np.unique(np.concatenate([lower(five, 4), five >> BITS]))])
    block = table.column("block")[0].as_py()
    return pa.table({"block": pa.array(np.full(len(codes), block, np.int64)), "code": pa.array(codes)})


def _scored(docs: pa.Table, answers: pa.Table, gamma: np.ndarray, p3: np.ndarray) -> pa.Table:
    codes = np.asarray(answers.column("code")).astype(np.int64)
    order = np.argsort(codes)
    codes = np.append(codes[order], np.iinfo(np.int64).max)
    share, back = (np.append(np.asarray(answers.column(c)).astype(np.float32)[order], np.float32(none)) for c, none in (("share", 0), ("gamma", 1)))

    def at(asked: np.ndarray) -> np.ndarray:
        """Where asked codes are; those that aren't: the last place."""
        place = np.searchsorted(codes[:-1], asked)
        return np.where(codes[place] == asked, place, len(codes) - 1)

    out = []
    for batch in A.slices(iter(docs.to_batches()), "text"):
        every, size = codes_of(batch.column("text"))
        five, where = np.unique(every, return_inverse=True)
        four = lower(five, 4)
        p4 = share[at(four)] + gamma[four >> BITS] * p3[lower(four, 3)]
        p = (share[at(five + TOP)] + back[at(five >> BITS)] * p4)[where]
        sums = np.append(0.0, np.cumsum(np.log(p), dtype=np.float64))
        ends = np.cumsum(size)
        mean = (sums[ends] - sums[ends - size]) / np.maximum(size, 1)
        out.append(pa.record_batch({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "n_bytes": pa.array(size), "perplexity": pa.array(np.exp(-mean), mask=size == 0)}))
    return pa.Table.from_batches(out, pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("perplexity", pa.float64())]))


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang), labels (doc_id, quality, toxic): doc_id, lang, n_bytes, perplexity, and
    calibrates: whether the document is trusted and not learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = stored(good.withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0))
    learned, held = good.where("not calibrates").drop("calibrates"), good.where("calibrates")
    weights, gamma, p3 = train(maybe_among(docs, learned).join(learned.hint("merge"), "doc_id", "left_semi"))
    dense = docs.sparkSession.sparkContext.broadcast((gamma, p3))  # DENSE entries each
    blocks = max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(blocks)).cast("long"))
    asked = dealt.groupBy("block").applyInArrow(_asked, "block long, code long")
    answers = asked.join(weights.hint("merge"), "code").select("block", "code", "share", "gamma")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda d, a: _scored(d, a, *dense.value), "doc_id long, lang string, n_bytes long, perplexity double")
    return stored(scored).join(held.hint("merge"), "doc_id", "left").withColumn("calibrates", F.coalesce("calibrates", F.lit(False)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_bytes, perplexity, threshold, kept; one row a row of docs."""
    scored = perplexities(docs, labels).withColumn("lang", F.coalesce("lang", F.lit("")))
    at = lambda c: F.percentile_approx(c, QUANTILE, 10_000)
    limit = stored(scored.groupBy("lang").agg(F.coalesce(at(F.when(F.col("calibrates"), F.col("perplexity"))), at(F.col("perplexity"))).alias("limit")))
    # A row a language: few go to every task, so that a language that most documents have isn't one task's.
    if limit.count() <= BROADCAST_ROWS:
        limit = F.broadcast(limit)
    out = scored.join(limit, "lang", "left").withColumn("threshold", F.col("limit") * SLACK)
    return out.select("doc_id", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
