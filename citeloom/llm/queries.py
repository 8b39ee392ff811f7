"""The queries of this folder: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL for some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import conversation_repair, gru_language, kneser_ney_quality, license_scan, minhash_dedup, oracles, pattern_packing, pii_sanitise, repetition_rules, secret_scan, seed_decontamination, spelling_variants, token_counts, top_k_search
from citeloom.sources.storage import table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is, here and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), width=2)


def op2_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules.repetition(_read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_language.predict_languages(_read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir, "documents"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney_quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_sanitise.report(_read(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_read(spark, sf_dir, "documents"))


def op10_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_read(spark, sf_dir, "documents"))


def op12_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_search.top_k(_read(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(_read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_pattern_packing,
        op3_repetition_rules,
        op4_token_counts,
        op5_gru_language,
        op6_license_scan,
        op7_kneser_ney_quality,
        op8_pii_sanitise,
        op9_secret_scan,
        op10_seed_decontamination,
        op11_spelling_variants,
        op12_top_k_search,
        op13_conversation_repair,
        pipeline,
    )
}
#: The others tokenise, learn, pack or estimate: tests/llm holds them against brute force, libraries or held-out rows.
ORACLES: dict[str, str] = {
    "op1_minhash_dedup": oracles.near_duplicates(),
    "op3_repetition_rules": oracles.repetition(),
    "op6_license_scan": license_scan.oracle_sql(),
    "op9_secret_scan": oracles.secrets(),
    "op10_seed_decontamination": oracles.decontamination(),
    "op11_spelling_variants": spelling_variants.oracle_sql(oracles.crc32),
    "op12_top_k_search": top_k_search.oracle_sql(),
    "op13_conversation_repair": conversation_repair.oracle_sql(oracles.crc32),
}
