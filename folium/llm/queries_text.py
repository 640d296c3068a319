"""Queries of decontamination, SimHash near-dedup and token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.llm.decontamination import contaminated
from folium.llm.queries_native import documents
from folium.llm.simhash import simhash_groups
from folium.llm.token_counts import token_counts


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
