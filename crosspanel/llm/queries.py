"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import (
    decontamination, embeddings, kneser_ney, language, near_dedup, oracles, packing, pii, prefix_trie, quality, repair, sharding,
    token_counts, url_filters)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@_query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@_query(oracles.DECONTAMINATION)
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@_query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("piece_bpe_32k.model")
    return token_counts.token_counts(
        _table(spark, sf_dir, "documents"), token_counts.sentencepiece_vocabulary(path), token_counts.has_byte_pieces(path))


@_query(oracles.PERSONAL_DATA)
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*pii.BASE))
    return found.select(
        "doc_id", *(of(k) for k in pii.BASE), F.sha2(pii.digest(base), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"))


@_query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = language.train(docs.where(language.fold() != 2))
    return language.identify(docs, trees).select(
        "doc_id", F.coalesce(language.fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query(oracles.NEAR_DUPLICATES)
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=4)


#: (verdict, host, beginning of the path)
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@_query(oracles.url_filters(URL_RULES))
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(_table(spark, sf_dir, "pages"), URL_RULES)


@_query(oracles.NEAR_VECTORS)
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query()
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality.with_quality(docs.select("doc_id", "text"), model, into="score")
    return scored.select(
        "doc_id", F.coalesce(quality.fold() == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query()
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(kneser_ney.fold() != 0), order=3)
    return kneser_ney.log_probabilities(docs, model).select(
        "doc_id", F.coalesce(kneser_ney.fold() == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


@_query(oracles.PREFIX_TRIE)
def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


@_query(oracles.REPAIR)
def op12_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repairs(repair.damaged(_table(spark, sf_dir, "conversations")))


SHARDS = 24


@_query(oracles.sharding(SHARDS))
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), SHARDS)
