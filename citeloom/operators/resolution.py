"""Resolution of citation strings to URNs with tables: vocabularies, relative frequencies, ranking, assembly.

Citations: (id, bibl, quote, urn, ...). Unresolved rows have a null or empty urn.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import urn as U
from citeloom.sources.storage import stored

SEPARATOR = " [SEP] "
#: Ranked candidates that are sent to every task at most.
BROADCAST_ROWS = 100_000


def _parsed(citations: DataFrame) -> DataFrame:
    return citations.withColumn("parsed", U.parse(F.col("urn"))).where("parsed is not null")


def author_examples(citations: DataFrame) -> DataFrame:
    """bibl, quote ('' if absent), author of resolved citations."""
    return _parsed(citations).select("bibl", F.coalesce("quote", F.lit("")).alias("quote"), F.col("parsed.author").alias("author"))


def author_vocabulary(citations: DataFrame) -> DataFrame:
    """author, author_id by sorted order. One window over distinct authors, whose number a catalogue bounds."""
    authors = _parsed(citations).select(F.col("parsed.author").alias("author")).distinct()
    return authors.withColumn("author_id", F.row_number().over(Window.orderBy("author")) - 1)


def author_training(citations: DataFrame) -> DataFrame:
    """text (bibl and quote), author_id."""
    rows = author_examples(citations).withColumn("text", F.concat("bibl", F.lit(SEPARATOR), "quote"))
    return rows.join(author_vocabulary(citations), "author").select("text", "author_id")


def works_by_author(citations: DataFrame) -> DataFrame:
    """author, works (sorted), n_works."""
    rows = _parsed(citations).where("parsed.work is not null").select("parsed.author", "parsed.work").distinct()
    return rows.groupBy("author").agg(F.sort_array(F.collect_list("work")).alias("works"), F.count("*").alias("n_works"))


def work_training(citations: DataFrame) -> DataFrame:
    """text (author, bibl, quote), work."""
    text = F.concat_ws(SEPARATOR, "parsed.author", "bibl", F.coalesce("quote", F.lit("")))
    return _parsed(citations).where("parsed.work is not null").select(text.alias("text"), F.col("parsed.work").alias("work"))


def frequencies(citations: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """P(author | key) and P(work | author, key) of resolved rows: (key, author, p_author), (key, author, work, p_work)."""
    rows = _parsed(citations).where("parsed.work is not null").select(key.alias("key"), "parsed.author", "parsed.work")
    works = stored(rows.groupBy("key", "author", "work").agg(F.count("*").alias("n")))
    total = F.sum("n").over(Window.partitionBy("key", "author"))
    p_work = works.select("key", "author", "work", (F.col("n") / total).alias("p_work"))
    authors = works.groupBy("key", "author").agg(F.sum("n").alias("n"))
    p_author = authors.select("key", "author", (F.col("n") / F.sum("n").over(Window.partitionBy("key"))).alias("p_author"))
    return p_author, p_work


def rank_candidates(queries: DataFrame, p_author: DataFrame, p_work: DataFrame, k: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """queries (id, key): id, author, work, confidence, rank, and the columns keep of the query: k authors by p, k works of each by p, by the product.

    A query without any candidate keeps one row with nulls, confidence 0 and rank 1.
    """
    first = lambda by, p, *tie: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(p), *tie))
    authors = p_author.withColumn("r", first(["key"], "p_author", "author")).where(F.col("r") <= k).drop("r")
    works = p_work.withColumn("r", first(["key", "author"], "p_work", "work")).where(F.col("r") <= k).drop("r")
    # Ranked once a key, however many queries ask for it.
    best = authors.join(works, ["key", "author"]).withColumn("confidence", F.col("p_author") * F.col("p_work"))
    best = best.withColumn("rank", first(["key"], F.round("confidence", 12), "author", "work")).select("key", "author", "work", "confidence", "rank")
    best = stored(best)
    # At most k * k rows a key: few keys go to every task, so a key that many queries ask for isn't one task's.
    if best.count() <= BROADCAST_ROWS:
        best = F.broadcast(best)
    out = queries.select("id", "key", *keep).join(best, "key", "left")
    return out.select("id", *keep, "author", "work", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("rank", F.lit(1)).alias("rank"))


def assemble_urn(rows: DataFrame) -> DataFrame:
    """rows (id, namespace, work, quote, bibl) with urn."""
    return rows.withColumn("urn", U.assemble(F.col("namespace"), F.col("work"), F.col("quote"), F.col("bibl")))


def orchestrate(rows: DataFrame, high: float = 0.85, low: float = 0.50) -> DataFrame:
    """rows (id, rule_urn, rule_confidence, model_urn, model_confidence) with urn, method.

    A rule's urn above high stands; between low and high the more confident of rule and model is taken; at low or
    below the model is preferred if it has any; without a rule's urn the model is alone.
    """
    rule, model = F.col("rule_urn").isNotNull(), F.col("model_urn").isNotNull()
    better = model & (F.coalesce("model_confidence", F.lit(0.0)) > F.col("rule_confidence"))
    method = (
        F.when(~rule & model, "dnn-only")
        .when(~rule, "unresolved")
        .when(F.col("rule_confidence") > high, "rule-based")
        .when((F.col("rule_confidence") > low) & better, "dnn-override")
        .when(F.col("rule_confidence") > low, "rule-based-verified")
        .when(model, "dnn-preferred")
        .otherwise("rule-based-verified")
    )
    out = rows.withColumn("method", method)
    return out.withColumn("urn", F.when(F.col("method").startswith("dnn"), F.col("model_urn")).otherwise(F.col("rule_urn")))


def resolution_coverage(citations: DataFrame, key: str) -> DataFrame:
    """key (null: all), n, n_resolved, coverage."""
    done = F.sum((F.coalesce("urn", F.lit("")) != "").cast("long"))
    out = citations.rollup(key).agg(F.count("*").alias("n"), done.alias("n_resolved"), F.grouping(key).alias("total"))
    return out.select(F.when(F.col("total") == 1, F.lit(None)).otherwise(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias(key), "n", "n_resolved", (F.col("n_resolved") / F.col("n")).alias("coverage"))


#: Texts of a cell: known ones, and queries.
KNOWN, ASKED = 1 << 15, 1 << 14


def _gram_codes(texts: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, gram as a number) of the distinct grams of each text, by text. Exact up to a width of 3, hashes beyond."""
    places, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        size = min(width, len(points))
        code = np.zeros(len(points) - size + 1, np.uint64)
        for i in range(size):
            code = (code << np.uint64(21) if width <= 3 else code * np.uint64(0x9E3779B97F4A7C15)) + points[i : len(points) - size + 1 + i]
        code = np.unique(code)
        places.append(np.full(len(code), at))
        codes.append(code)
    return np.concatenate(places), np.concatenate(codes)


def _most_similar(asked: pa.Table, known: pa.Table, k: int, least: float, width: int) -> pa.Table:
    """q, urn, similarity: of each text that is asked for the k most similar urns of a cell, through lists of the texts of each gram."""
    empty = pa.table({"q": pa.array([], pa.int64()), "urn": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
    if not asked.num_rows or not known.num_rows:
        return empty
    texts, of = np.unique(np.array(known["text"].to_pylist(), object), return_inverse=True)
    urns = sorted(set(known["urn"].to_pylist()), key=lambda u: (u is not None, u or ""))
    place = {u: i for i, u in enumerate(urns)}
    urn = np.array([place[u] for u in known["urn"].to_pylist()])
    by_text = np.argsort(of, kind="stable")
    of, urn = of[by_text], urn[by_text]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    held, grams_ = _gram_codes(texts, width)
    sizes = np.bincount(held, minlength=len(texts))
    order = np.argsort(grams_, kind="stable")
    held, (every, begin) = held[order].astype(np.int32), np.unique(grams_[order], return_index=True)
    begin = np.append(begin, len(held))
    q_at, q_grams = _gram_codes(asked["text"].to_pylist(), width)
    bounds = np.searchsorted(q_at, np.arange(asked.num_rows + 1))
    found = np.searchsorted(every, q_grams)
    there = (found < len(every)) & (every[np.minimum(found, len(every) - 1)] == q_grams)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, q in enumerate(asked["q"].to_pylist()):
        low, high = bounds[i], bounds[i + 1]
        lists = [held[begin[g] : begin[g + 1]] for g in found[low:high][there[low:high]]]
        if not lists:
            continue
        both = np.bincount(np.concatenate(lists), minlength=len(texts))
        similarity = both / (high - low + sizes - both)
        near = np.flatnonzero(similarity >= least)
        n = first[near + 1] - first[near]
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[near], n)
        near, value = urn[rows], np.repeat(similarity[near], n)
        best = np.lexsort((near, -np.round(value, 9)))
        best = best[np.sort(np.unique(near[best], return_index=True)[1])[:k]]
        out.append((np.full(len(best), q), near[best], value[best]))
    if not out:
        return empty
    q, near, value = map(np.concatenate, zip(*out))
    return pa.table({"q": pa.array(q, pa.int64()), "urn": pa.array([urns[u] for u in near], pa.string()), "similarity": pa.array(value, pa.float64())})


def retrieve_similar(queries: DataFrame, known: DataFrame, k: int = 5, least: float = 0.3, width: int = 3) -> DataFrame:
    """queries (id, text), known (id, text, urn): query, urn, similarity, rank of the k most similar distinct texts.

    Texts that are equal are compared once, and their urns are ranked together. At a low similarity nearly all pairs share
    grams, so cells of KNOWN texts, dealt out by their urns, and ASKED queries meet as texts; each gives k urns a query.
    """
    name = F.xxhash64(F.lower("text"))
    q = queries.where("text <> ''").select(name.alias("q"), F.lower("text").alias("text")).dropDuplicates(["q"])
    b = stored(known.where("text <> ''").select(F.lower("text").alias("text"), F.col("urn").cast("string").alias("urn")).distinct())
    q = stored(q)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    groups, turns = max(cores, -(-b.count() // KNOWN)), max(1, -(-q.count() // ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("turn", F.pmod("q", F.lit(turns)).cast("int")).withColumn("group", every(groups))
    b = b.withColumn("group", F.pmod(F.xxhash64("urn"), F.lit(groups)).cast("int")).withColumn("turn", every(turns))
    # Little is read for what is computed: cells are dealt out to a given number of tasks.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = lambda x: x.repartition(tasks, "group", "turn").groupBy("group", "turn")
    best = cell(q).cogroup(cell(b)).applyInArrow(lambda x, y: _most_similar(x, y, k, least, width), "q long, urn string, similarity double")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("similarity", 9)), "urn"))).where(F.col("rank") <= k)
    return queries.select(F.col("id").alias("query"), name.alias("q")).join(best, "q").select("query", "urn", "similarity", "rank")


def confidence_features(citations: DataFrame) -> DataFrame:
    """id, author_freq, work_freq, has_quote, bibl_length, urn_parts, works_of_author, language_fits of resolved rows."""
    rows = _parsed(citations).select("id", "bibl", F.coalesce("quote", F.lit("")).alias("quote"), "parsed.*", "urn")
    authors = rows.groupBy("author").agg(F.count("*").alias("author_freq"), F.countDistinct("work").alias("works_of_author"))
    works = rows.groupBy("work").agg(F.count("*").alias("work_freq"))
    greek = U.edition(F.col("quote")) == "grc"
    out = rows.join(authors, "author").join(works, "work", "left")
    parts = sum(F.col(c).isNotNull().cast("int") for c in ("namespace", "author", "work", "edition", "passage"))
    return out.select("id", "author_freq", F.coalesce("work_freq", F.lit(0)).alias("work_freq"), (F.col("quote") != "").alias("has_quote"), F.length("bibl").alias("bibl_length"), parts.alias("urn_parts"), "works_of_author", (greek == (F.col("namespace") == "greekLit")).alias("language_fits"))


def synthetic_negatives(citations: DataFrame, seed: int = 42) -> DataFrame:
    """id, work, wrong_work, kind: another work of the author ('within'), if it has one, and the work of a next
    author in the order of chance ('outside'), if there is one."""
    # Made once: it is read for each kind, and for its works.
    rows = stored(_parsed(citations).where("parsed.work is not null").select("id", "parsed.author", "parsed.work"))
    works = rows.select("author", "work").distinct().withColumn("chance", F.md5(F.concat_ws(":", F.lit(seed), "work")))
    inside = Window.partitionBy("author").orderBy("chance", "work")
    whole = Window.partitionBy("author")
    within = works.withColumn("wrong_work", F.coalesce(F.lead("work").over(inside), F.min_by("work", F.struct("chance", "work")).over(whole))).where("wrong_work <> work").select("author", "work", "wrong_work", F.lit("within").alias("kind"))
    # One row an author: a catalogue bounds their number.
    first = works.groupBy("author").agg(F.min_by("work", F.struct("chance", "work")).alias("w"))
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "author")), "author")
    shifted = first.withColumn("wrong_work", F.coalesce(F.lead("w").over(order), F.first("w").over(order))).where("wrong_work <> w").select("author", "wrong_work")
    outside = works.join(shifted, "author").select("author", "work", "wrong_work", F.lit("outside").alias("kind"))
    return rows.join(within.union(outside), ["author", "work"]).select("id", "work", "wrong_work", "kind")


def citation_edges(citations: DataFrame, document: str = "filename") -> DataFrame:
    """document, work, n."""
    return _parsed(citations).where("parsed.work is not null").groupBy(document, F.col("parsed.work").alias("work")).agg(F.count("*").alias("n"))


def co_citations(edges: DataFrame, document: str = "filename") -> DataFrame:
    """work1, work2, n documents that cite both. Documents that cite the same set of works are counted as one row
    with a weight before pairs are made."""
    sets = edges.groupBy(document).agg(F.sort_array(F.collect_set("work")).alias("works")).groupBy("works").agg(F.count("*").alias("n"))
    rows = sets.select("n", "works", F.posexplode("works").alias("i", "work1"))
    pairs = rows.select("n", "work1", F.explode(F.expr("slice(works, i + 2, size(works))")).alias("work2"))
    return pairs.groupBy("work1", "work2").agg(F.sum("n").alias("n"))
