"""The registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, clustering, decontaminate, interactions, jaccard_join, language, near_dedup, packing, pseudonyms, quality, secrets, substring_dedup, token_counts
from tessera.llm.common import documents

#: The key of the registered query; a deployment passes its own.
PSEUDONYM_KEY = b"registered query"
TOKENIZER = "byte_bpe_50k.json"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.learn(docs.where(~language.held_out()))
    return language.predict(docs, model, ["doc_id", language.held_out().alias("held_out")])


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.pseudonymise(documents(spark, sf_dir), PSEUDONYM_KEY)
    return found.select("doc_id", F.size("spans").cast("long").alias("n_found"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",").alias("spans"), "text")


def op7_quotation_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(documents(spark, sf_dir, "conversations"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op9_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs, secrets.train(docs))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(written(of("assign", "access", "hex")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centres = clustering.cluster_vectors(documents(spark, sf_dir, "embeddings"), k=16, rounds=3)
    digests = F.array(*(F.sha2(F.lit(",".join(map(str, c))), 256) for c in centres.tolist())) if len(centres) else F.array().cast("array<string>")
    return rows.withColumn("centroid_sha256", digests[F.col("cluster")])


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(documents(spark, sf_dir), width=4, percent=85)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_quotation_chat": op7_quotation_chat,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_frequency_quality": op9_line_frequency_quality,
    "op10_secret_scan": op10_secret_scan,
    "op11_sort_means": op11_sort_means,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_filter_interactions": op13_filter_interactions,
}
ORACLES: dict[str, str] = {"op9_line_frequency_quality": quality.ORACLE, "op11_sort_means": clustering.ORACLE, "op12_jaccard_join": jaccard_join.ORACLE, "op13_filter_interactions": interactions.ORACLE}
