"""Sinks: splits with a manifest, tagged documents, windows, evaluations, profiles. JSON keeps non-ASCII text."""

from __future__ import annotations

import json
import tarfile
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def write_splits(df: DataFrame, path: str) -> None:
    """One folder a split. df has a column split."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def _manifest(spark: SparkSession, path: str) -> str | None:
    """The manifest of an earlier, complete split; it's written last."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    rows = spark.read.text(f"{path}/_manifest").take(1)
    return rows[0]["value"] if rows else None


def split_if_needed(spark: SparkSession, make: Callable[[], DataFrame], path: str, strategy: str, ratios: Sequence[float], seed: int, source: str, force: bool = False) -> bool:
    """Writes make()'s splits unless an equal manifest says that they are there; True if it wrote.

    The manifest is removed before the splits and written after them, so a job that dies leaves none.
    """
    want = json.dumps({"strategy": strategy, "ratios": list(ratios), "seed": seed, "source": source})
    if not force and _manifest(spark, path) == want:
        return False
    spark.createDataFrame([], "value string").write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").text(f"{path}/_manifest")
    write_splits(make(), f"{path}/data")
    spark.createDataFrame([(want,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")
    return True


def write_tagged(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """Complete results only: written beside, under processed/, or with overwrite swapped in for path by a rename."""
    target = f"{path.rstrip('/')}/processed" if not overwrite else f"{path.rstrip('/')}.new"
    df.write.mode("overwrite").json(target)
    if not overwrite:
        return target
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    new, old, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (target, path, f"{path.rstrip('/')}.old"))
    fs = new.getFileSystem(conf)
    fs.delete(kept, True)
    if fs.exists(old):
        fs.rename(old, kept)
    fs.rename(new, old)
    fs.delete(kept, True)
    return path


def write_windows(df: DataFrame, path: str) -> None:
    """window_text, filename a line."""
    df.select("window_text", "filename").write.mode("overwrite").json(path)


@F.pandas_udf(T.StringType())
def _member_head(name: pd.Series, size: pd.Series) -> pd.Series:
    def one(name: str, size: int) -> str:
        info = tarfile.TarInfo(name)
        info.size = size
        return info.tobuf(tarfile.PAX_FORMAT).decode()

    return pd.Series([one(*x) for x in zip(name, size)], dtype=object)


def write_archives(files: DataFrame, path: str, members: int = 16) -> None:
    """files (name, text) in UTF-8, inside tar archives of at most so many: one file a text costs the file system more than its
    content does. Padding that fills a block alone needs ignore_zeros (tar -i)."""
    size = F.octet_length("text")
    # The end of a line is the last character of the padding.
    padding = F.repeat(F.lit("\0"), F.pmod(-(size + 1), F.lit(512)))
    rows = files.select(F.concat(_member_head("name", size), "text", padding).alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", members).text(path)


def write_evaluation(metrics: DataFrame, report: DataFrame, records: DataFrame, path: str) -> None:
    for name, df in (("metrics", metrics), ("report", report), ("predictions", records)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_profile(profile: DataFrame, path: str) -> None:
    """One line; the keys stand in the order of the columns."""
    profile.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_back(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


