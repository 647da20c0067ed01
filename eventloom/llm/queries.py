"""The registered query of each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, lm, lz, near, oracles, packing, pii, quality, secrets, urls, webp
from eventloom.llm.common import read


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.edited_pairs(read(spark, sf_dir, "documents"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded, as sums of logarithms depend on their order."""
    return lm.score_documents(read(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


def op5_lm_score_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with n-grams of two words at most."""
    return lm.score_documents(read(spark, sf_dir, "documents"), order=2).withColumn("log_score", F.round("log_score", 4))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled outcome of a page is the quality label of its id. Posterior figures are rounded, as sums depend on their order."""
    labels = read(spark, sf_dir, "labels")
    outcomes = labels.select(labels.doc_id.alias("page_id"), (1 - labels.quality).alias("bad"))
    return urls.judge(read(spark, sf_dir, "pages"), outcomes, urls.RULES).withColumns({c: F.round(c, 6) for c in ("prior", "mean", "bound")})


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: The key of the registered query only; real ones are secrets.
EXAMPLE_KEY = b"eventloom example key"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"), EXAMPLE_KEY)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests_in_two(read(spark, sf_dir, "documents"))


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_copies(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_lz_fingerprint, op2_quality, op3_bpe, op4_webp, op5_lm_score, op5_lm_score_bigrams, op6_url_reputation, op7_packing, op8_pseudonyms, op9_secrets, op10_near_copies)}


def oracle_sql() -> dict[str, str]:
    return {"op5_lm_score": oracles.LM_ORACLE, "op5_lm_score_bigrams": oracles.BIGRAM_ORACLE, "op6_url_reputation": urls.ORACLE, "op10_near_copies": oracles.NEAR_ORACLE}
