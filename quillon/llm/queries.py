"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.hamming import top_k_sql
from quillon.llm.urls import judge_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary())


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary())


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.forest import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.hamming import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.lang_id import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.lang_id import identify_pages

    return identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm._common import shared_folder
    from quillon.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_bpe": op2_bpe,
    "op3_forest": op3_forest,
    "op4_hamming": op4_hamming,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_secrets": op6_secrets,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_urls": op8_urls,
    "op9_language": op9_language,
    "language_of_pages": language_of_pages,
    "op10_sharding": op10_sharding,
}
ORACLES: dict[str, str] = {
    "op4_hamming": top_k_sql(),
    "op8_urls": judge_sql(),
}
