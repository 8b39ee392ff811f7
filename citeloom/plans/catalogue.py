"""The registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.plans import binding, corpus_queries, label_queries, markup_queries

MODULES = (markup_queries, label_queries, corpus_queries)
QUERIES, ORACLES = binding.QUERIES, binding.ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have enough citations, and what is their mix?"""
    return QUERIES["f5_corpus_profile"](spark, sf_dir)
