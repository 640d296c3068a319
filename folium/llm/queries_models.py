"""Queries of the trained operators: toxicity, licences, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.llm.license_scan import scan_licenses
from folium.llm.quality import quality
from folium.llm.queries_native import documents
from folium.llm.toxicity import toxicity


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))
