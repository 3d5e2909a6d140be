"""The registered queries of the operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import ball_search, bpe, collocations, fingerprint, line_dedup, mixing, quality_gam, quality_rules, sharding, simhash, sql, suffix_dedup, toxicity, warc
from kinloom.llm.common import table


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op2_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("cleaned_text", "lost")


def op6_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), F.col("source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.judged(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op10_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op11_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op12_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_itemset_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_order_minhash, op2_toxicity_fm, op3_byte_bpe, op4_simhash_ball, op5_line_quality, op6_flow_mixing, op7_warc_bundles,
        op8_quality_gam, op9_line_windows, op10_lpt_shards, op11_suffix_buckets, op12_ball_search, op13_itemset_phrases,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_quality": sql.QUALITY_RULES, "op7_warc_bundles": sql.WARC, "op9_line_windows": sql.LINE_DEDUP,
        "op12_ball_search": sql.BALL_SEARCH, "op13_itemset_phrases": sql.COLLOCATIONS,
    }
