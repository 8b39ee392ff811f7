"""From raw documents to packed sequences: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on, with the columns of ``documents``; the
last returns packed pieces. ``run`` writes each stage's result to the shared folder and rereads it, so a stage
works on all that its predecessor kept and a lost executor costs at most one stage.

Null, empty and letterless texts go in the first stage, so an empty table and one of such texts give an empty
result. Rows without a doc_id stay, unless a text like theirs has one; repeated rows stay together. Columns that
``documents`` doesn't have are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.llm import gru_language, minhash_dedup, pattern_packing, pii_sanitise, seed_decontamination
from citeloom.llm.queries import tokenizer
from citeloom.llm.shared import stored
from citeloom.sources.storage import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this a text's pooled probability says that no learned language fits it.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and those that no language fits, go; the network learns from docs itself."""
    network = gru_language.learn(docs.where(~gru_language.held_out(F.col("doc_id"))))
    return gru_language.keep_known(docs, network, LEAST_SCORE).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8) the one with the smallest doc_id stays."""
    return minhash_dedup.drop_near_duplicates(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return seed_decontamination.drop_contaminated(docs, benchmark).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced in text; n_chars follows."""
    return pii_sanitise.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages learn a network and tokenise: SQL can't express them. tests/llm/test_pipeline.py states what each must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
