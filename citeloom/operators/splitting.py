"""Splits by group: no group is in two splits. The order that chance gives is that of md5(seed:trial:group)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.sources.storage import stored

SPLITS = ("train", "val", "test")


def check_ratios(ratios: Sequence[float]) -> tuple[float, float, float]:
    if len(ratios) != 3 or abs(sum(ratios) - 1) > 1e-6 or min(ratios) < 0:
        raise ValueError(f"three ratios that sum to 1 are needed, not {tuple(ratios)}")
    return tuple(ratios)


def ratios_fit(train: Column, val: Column, test: Column) -> Column:
    """The same test on columns."""
    return (F.abs(train + val + test - 1) <= 1e-6) & (F.least(train, val, test) >= 0)


def group_sizes(df: DataFrame, key: str = "filename") -> DataFrame:
    """key, n."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def _chance(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts)))


def chance_ranks(groups: DataFrame, key: str, *by: str) -> DataFrame:
    """groups (key, chance, ...) with rank, from 0 in the order of chance, for each value of by.

    No task ranks all groups: those that share the first digits of their hash are counted, the counts are summed
    (4096 rows a value of by), and groups are ranked inside those.
    """
    groups = groups.withColumn("bucket", F.substring("chance", 1, 3))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = groups.groupBy(*by, "bucket").agg(F.count("*").alias("size")).select(*by, "bucket", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("chance", key)) - 1
    ranked = groups.withColumn("within", rank).join(sizes, [*by, "bucket"])
    return ranked.withColumn("rank", F.col("before") + F.col("within")).drop("bucket", "before", "within")


def group_assignment(df: DataFrame, key: str, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, trials: int = 100, tolerance: float = 0.02, at_once: int = 10) -> DataFrame:
    """key, split. Each trial orders the groups by chance: the first floor(train * groups) train, the next
    floor(val * groups) validate, the rest test. The first trial whose shares of rows are all within tolerance
    of the ratios is taken, else the one that is nearest.

    Groups, not rows, take part in trials, ``at_once`` of which are looked at together; the first that fits is the last.
    """
    train, val, test = check_ratios(ratios)
    sizes = stored(group_sizes(df, key))
    n_groups = sizes.count()

    def tried(first: int, last: int) -> DataFrame:
        rows = sizes.withColumn("trial", F.explode(F.sequence(F.lit(first), F.lit(last))))
        rows = chance_ranks(rows.withColumn("chance", _chance(seed, F.col("trial"), F.col(key))), key, "trial")
        end = F.floor(F.lit(n_groups) * F.lit(train))
        split = F.when(F.col("rank") < end, "train").when(F.col("rank") < end + F.floor(F.lit(n_groups) * F.lit(val)), "val").otherwise("test")
        return rows.withColumn("split", split)

    share = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)) / F.sum("n")
    worst = F.round(F.greatest(*(F.abs(share(s) - r) for s, r in zip(SPLITS, (train, val, test)))), 12).alias("off")
    seen: list[tuple[float, int]] = []
    for first in range(0, trials, at_once):
        found = sorted((r["trial"], r["off"]) for r in tried(first, min(first + at_once, trials) - 1).groupBy("trial").agg(worst).collect())  # a row a trial
        seen += [(off, trial) for trial, off in found]
        if fits := [trial for trial, off in found if off <= tolerance]:
            return tried(fits[0], fits[0]).select(key, "split")
    best = min(seen)[1] if seen else 0
    return tried(best, best).select(key, "split")


def group_split(df: DataFrame, key: str, ratios: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42, trials: int = 100, tolerance: float = 0.02) -> DataFrame:
    """df with split; rows without a key have none."""
    return df.join(group_assignment(df, key, ratios, seed, trials, tolerance), key, "left")


def split_report(df: DataFrame) -> DataFrame:
    """split, n, share."""
    counts = df.groupBy("split").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("split", "n", (F.col("n") / F.col("total")).alias("share"))


def pattern_split(df: DataFrame, author: str, work: str, seed: int = 42, share: float = 0.1) -> DataFrame:
    """df with category: works of held-out authors, held-out works of other authors (new works of seen authors if
    the author has another work left), and what is left, seen."""
    held = lambda *c: F.conv(F.substring(_chance(seed, *map(F.col, c)), 1, 4), 16, 10).cast("int") < int(share * 65536)
    marked = df.withColumn("author_out", held(author)).withColumn("work_out", held(author, work))
    seen = marked.where("not author_out and not work_out").select(author).distinct().withColumn("author_seen", F.lit(True))
    category = F.when(F.col("author_out"), "unseen_author").when(F.col("work_out") & F.col("author_seen"), "seen_author_unseen_work").when(F.col("work_out"), "unseen_work").otherwise("seen")
    return marked.join(seen, author, "left").withColumn("category", category).drop("author_out", "work_out", "author_seen")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of edges (a, b), by rounds of minima and shortcuts: each node takes the least
    label of itself and its neighbours, then the label of its label."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a is not null and b is not null").distinct())
    now = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(now.toDF("b", "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = now.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        least = stored(least)
        step = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(least.join(step, "label").select("node", F.least("label", "next").alias("label"), "old"))
        now = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return now.withColumnRenamed("label", "component")


def leak_free_split(df: DataFrame, abbreviation: str, work: str, ratios: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """df with component and split: no abbreviation and no work stands in two splits.

    Abbreviations and works that stand in one row are joined; a component of that graph goes to one split as a whole,
    by the rule of group_split. Rows without either are in no component and no split (null).
    """
    tagged = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(kind), F.col(c).cast("string")))
    rows = df.withColumn("a", F.coalesce(tagged("a:", abbreviation), tagged("w:", work))).withColumn("b", F.coalesce(tagged("w:", work), F.col("a")))
    found = components(rows.select("a", "b").distinct()).withColumnRenamed("node", "a")
    joined = stored(rows.join(found, "a", "left").drop("a", "b"))
    placed = group_split(joined.where("component is not null"), "component", ratios, seed=seed)
    return placed.unionByName(joined.where("component is null").withColumn("split", F.lit(None).cast("string")))


def holdout(df: DataFrame, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """df with held_out, by a hash of the key: repeatable, and no pass over the data."""
    return df.withColumn("held_out", F.conv(F.substring(_chance(seed, F.col(key)), 1, 4), 16, 10).cast("int") < int(fraction * 65536))


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """df with fold (0..k-1), whole groups in turn in the order of chance.

    See chance_ranks: no task ranks them all.
    """
    groups = df.select(key).distinct().withColumn("chance", _chance(seed, F.col(key)))
    folds = chance_ranks(groups, key).select(key, (F.col("rank") % k).cast("int").alias("fold"))
    return df.join(folds, key, "left")
