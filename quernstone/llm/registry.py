"""The ``opN_`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, chat_formatting, decontamination, divergence, license_scans, mixing, near_dup, oracle, quality_rules, secret_scans, token_counts, toxicity, url_filters, whitening
from quernstone.plans.durable import durable
from quernstone.sources.tables import table


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scans(spark: SparkSession, base: str) -> DataFrame:
    return license_scans.scan(table(spark, base, "documents"))


def op2_toxicity(spark: SparkSession, base: str) -> DataFrame:
    return toxicity.score(table(spark, base, "documents"), table(spark, base, "labels"))


def op3_token_counts(spark: SparkSession, base: str) -> DataFrame:
    return token_counts.count(table(spark, base, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op4_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, base, "documents"))


def op5_decontamination(spark: SparkSession, base: str) -> DataFrame:
    return decontamination.matches(table(spark, base, "documents"), table(spark, base, "benchmark"))


def op6_chat_formatting(spark: SparkSession, base: str) -> DataFrame:
    return chat_formatting.render(table(spark, base, "conversations"))


def op7_secret_scans(spark: SparkSession, base: str) -> DataFrame:
    found = secret_scans.scan(table(spark, base, "documents"))
    return found.withColumn("value_sha256", F.sha2("value", 256)).drop("value")


def op8_bpe(spark: SparkSession, base: str) -> DataFrame:
    return bpe.encode(table(spark, base, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_minhash_near_dup(spark: SparkSession, base: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, base, "documents"), words=4)


def op10_url_filters(spark: SparkSession, base: str) -> DataFrame:
    return url_filters.judge(table(spark, base, "pages"))


def op11_source_mixing(spark: SparkSession, base: str) -> DataFrame:
    return mixing.taken(table(spark, base, "documents"))


def op12_source_divergence(spark: SparkSession, base: str) -> DataFrame:
    return divergence.audit(table(spark, base, "documents"))


def op13_embedding_whitening(spark: SparkSession, base: str) -> DataFrame:
    return whitening.long_form(whitening.whiten(table(spark, base, "embeddings")))


def host_rank_over_trade(spark: SparkSession, base: str) -> DataFrame:
    """The propagation of op10 over a dense graph that the tables hold: nations as hosts, orders from a customer's nation to a
    supplier's as links, trusted seeds the customers of region 0, blocked ones the suppliers of region 1."""
    nation = table(spark, base, "nation").select("n_nationkey", "n_regionkey")
    buyer = table(spark, base, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("a"))
    seller = table(spark, base, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("b"))
    lines = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    sold = lines.join(table(spark, base, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(buyer, "o_custkey").join(seller, "l_suppkey")
    host = lambda c: F.concat(F.lit("nation"), F.col(c).cast("string"))
    edges = durable(sold.where("a <> b").groupBy(host("a").alias("a"), host("b").alias("b")).agg(F.count("*").alias("links")))
    seeds = lambda rows, key, region, own: (
        rows.join(nation.where(F.col("n_regionkey") == region), F.col(key) == F.col("n_nationkey")).groupBy(host(key).alias("host")).agg(F.count("*").alias("n")).withColumn("own", F.lit(own))
    )
    ruled = durable(seeds(buyer, "a", 0, "allow").unionByName(seeds(seller, "b", 1, "block")))
    return url_filters.host_scores(edges, ruled).withColumn("verdict", url_filters.host_verdict())


def queries() -> dict:
    found = [op1_license_scans, op2_toxicity, op3_token_counts, op4_quality_rules, op5_decontamination, op6_chat_formatting, op7_secret_scans, op8_bpe, op9_minhash_near_dup, op10_url_filters, op11_source_mixing, op12_source_divergence, op13_embedding_whitening, host_rank_over_trade]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL
