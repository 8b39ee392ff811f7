"""Counts of elements per document, selection by them, and the corpus profile. Input: (doc_id, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from citeloom.functions import markup
from citeloom.operators import chardata, lexing
from citeloom.sources.storage import stored


def tag_counts(docs: DataFrame, tags: Sequence[str] = markup.TAGS) -> DataFrame:
    """doc_id, n_<tag> opening and empty tags of each element, n_tags, n_chars of character data.

    Counted on the pieces of a document, so what stands in comments, CDATA or scripts is no tag. Character data is
    decoded: a reference is one character, so is a line's end; CDATA counts without its brackets; blanks before the first
    tag and after the last stand outside of every element and don't count.
    """
    size = lambda f: F.size(f).cast("long")
    names = F.transform(F.filter("x", lambda p: p.rlike("^<[A-Za-z_]") & lexing.kind_of(p).isin("open", "selfclose")), lambda p: F.lower(F.regexp_extract(p, lexing.NAME, 1)))
    counted = docs.select("doc_id", lexing.pieces(F.col("text")).alias("x"))
    counted = counted.select("doc_id", names.alias("names"), chardata.inner_length(F.col("x")).alias("n_chars"))
    named = lambda t: F.filter("names", lambda n: n == t)
    counts = [size(named(t)).alias(f"n_{t}") for t in tags]
    out = counted.select("doc_id", *counts, F.col("n_chars").cast("long").alias("n_chars")).where("n_chars is not null")
    return out.withColumn("n_tags", sum((F.col(f"n_{t}") for t in tags[1:]), F.col(f"n_{tags[0]}")))


def tag_totals(counts: DataFrame, tags: Sequence[str] = markup.TAGS) -> DataFrame:
    """Counts by document with a row for the corpus (doc_id null), in one pass."""
    sums = [F.sum(f"n_{t}").alias(f"n_{t}") for t in tags]
    return counts.rollup("doc_id").agg(*sums, F.sum("n_tags").alias("n_tags"), F.sum("n_chars").alias("n_chars"))


def select_documents(counts: DataFrame, min_tags: int = 100) -> DataFrame:
    return counts.where(F.col("n_tags") >= min_tags)


def tag_proportions(counts: DataFrame, tags: Sequence[str] = markup.TAGS) -> DataFrame:
    """counts with p_<tag>, the share of each element among the counted; null without any."""
    return counts.withColumns({f"p_{t}": F.try_divide(F.col(f"n_{t}").cast("double"), F.col("n_tags")) for t in tags})


def value_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """name, value (double), n: how often each column has each value, stored; nulls aren't counted."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")
    return stored(rows.select(pairs).select("x.*").where("value is not null").groupBy("name", "value").agg(F.count("*").alias("n")))


def medians(counts: DataFrame, parts: int = 1000) -> DataFrame:
    """counts as of value_counts: name, median (exact: the mean of the two middle values).

    Splitters of each column, from a mergeable sketch, cut its different values in about ``parts`` parts of equal
    counts; only those parts that hold a middle value are ranked.
    """
    cuts = counts.groupBy("name").agg(F.percentile_approx("value", [k / parts for k in range(1, parts)], 10 * parts).alias("cuts"), F.sum("n").alias("total"))
    counts = counts.join(F.broadcast(cuts), "name").withColumn("part", F.size(F.filter("cuts", lambda c: c < F.col("value"))))  # a row a column is broadcast
    parted = counts.groupBy("name", "total", "part").agg(F.sum("n").alias("n"))  # as many rows a column as parts
    before = F.coalesce(F.sum("n").over(Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    middle = parted.withColumn("before", before).where((low <= F.col("before") + F.col("n")) & (high > F.col("before"))).select("name", "part", "before")
    ranked = counts.join(F.broadcast(middle), ["name", "part"])
    ranked = ranked.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("name", "part").orderBy("value")))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("value")))
    return ranked.groupBy("name").agg(((at(low) + at(high)) / 2).alias("median"))


def corpus_profile(counts: DataFrame, tags: Sequence[str] = markup.TAGS, min_tags: int = 100) -> DataFrame:
    """One row: documents in and out, and statistics of totals, counts and shares over those in.

    All come from one table of how often each column has each value. Medians are exact; the standard deviation is the
    population's.
    """
    kept = F.col("n_tags") >= min_tags
    names = {"n_tags": "tags"} | {f"{p}_{t}": t + "_share" * (p == "p") for t in tags for p in "np"}
    rows = tag_proportions(counts, tags).select(*(F.when(kept, F.col(c)).alias(c) for c in names), kept.alias("included"))
    table = value_counts(rows.withColumn("included", F.col("included").cast("int")), [*names, "included"])
    x, n = F.col("value"), F.col("n")
    stats = table.groupBy("name").agg(F.sum("n").alias("m"), F.sum(x * n).alias("total"), F.sum(x * x * n).alias("squares"), F.min("value").alias("min"), F.max("value").alias("max"))
    stats = stats.withColumn("mean", F.col("total") / F.col("m")).join(F.broadcast(medians(table)), "name", "left")  # a row a column
    of = lambda c, what: F.max(F.when(F.col("name") == c, F.col(what)))
    whole = lambda c, what: of(c, what).cast("long")
    included, every = F.coalesce(whole("included", "total"), F.lit(0)), F.coalesce(whole("included", "m"), F.lit(0))
    spread = F.sqrt(F.greatest(of("n_tags", "squares") / of("n_tags", "m") - of("n_tags", "mean") * of("n_tags", "mean"), F.lit(0.0)))
    columns = [included.alias("n_included"), (every - included).alias("n_excluded"), F.lit(min_tags).alias("min_tags"), spread.alias("tags_stddev")]
    for c, name in names.items():
        end = of if c.startswith("p_") else whole
        columns += [] if c.startswith("p_") else [whole(c, "total").alias(f"{name}_total")]
        columns += [of(c, "mean").alias(f"{name}_mean"), end(c, "min").alias(f"{name}_min"), end(c, "max").alias(f"{name}_max"), of(c, "median").alias(f"{name}_median")]
    return stats.agg(*columns)


def char_weighted_proportions(counts: DataFrame, tags: Sequence[str] = markup.TAGS, min_tags: int = 100) -> DataFrame:
    """One row: each element's share, weighted by the documents' characters."""
    rows = tag_proportions(select_documents(counts, min_tags), tags)
    return rows.agg(*(F.try_divide(F.sum(F.col(f"p_{t}") * F.col("n_chars")), F.sum("n_chars")).alias(f"{t}_weighted") for t in tags))
