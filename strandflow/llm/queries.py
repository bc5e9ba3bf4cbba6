"""The thin ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, digests, licenses, pii, quality, sharding, simhash, substrings
from .common import table


def op1_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_conversations(table(spark, sf_dir, "conversations"))


def document_paths(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``path`` made up from source and id, as the table has none.

    A source is a repository with folders of a thousand and of a hundred ids;
    the first document of a folder stands for its licence file.
    """
    thousand, hundred = F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string")
    top = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), thousand)
    path = F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat(top, F.lit("/"), hundred, F.lit("/LICENSE"))).otherwise(F.concat(top, F.lit("/"), hundred, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.withColumn("path", path)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(document_paths(table(spark, sf_dir, "documents")))


def op3_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_items=True).drop("key")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_quartile_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_with_edits(table(spark, sf_dir, "documents"))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_collapse, op2_license_scan, op3_crf_pii, op4_decontamination, op5_bpe_round_trip, op6_substring_dedup, op7_simhash_near_dedup, op8_quartile_digests, op9_pu_quality, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_collapse": chat.ORACLE, "op6_substring_dedup": substrings.ORACLE}
