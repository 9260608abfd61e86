"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import oracles
from netloom.llm.chat import chat_digests
from netloom.llm.embed_dedup import near_embeddings
from netloom.llm.kneser_ney import kneser_ney_scores
from netloom.llm.licences import licence_scan
from netloom.llm.ngram_join import ngram_jaccard
from netloom.llm.packing import best_fit_pack
from netloom.llm.pii import pseudonym_report
from netloom.llm.quality import quality
from netloom.llm.store import table
from netloom.llm.toxicity import held_out, toxicity
from netloom.llm.winnow import contamination


#: The secret of the queries' pseudonyms; in production it comes from a key store.
PII_KEY = b"netloom-example-key"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym_report(table(spark, sf_dir, "documents"), PII_KEY)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"), least=0.9)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(probe))
    return chat_digests(turns.union(more))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney_scores(table(spark, sf_dir, "documents"), held_out(10, 0))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_pseudonyms": op1_pii_pseudonyms,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_license_scan": op7_license_scan,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": oracles.NGRAM_JOIN,
    "op4_embedding_near_dedup": oracles.EMBEDDINGS,
    "op6_chat_formatting": oracles.CHAT,
    "op9_decontamination": oracles.DECONTAMINATION,
}
