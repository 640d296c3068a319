"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.llm.queries_native import documents
from folium.llm.secret_scan import digest, scan


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("found")).alias("spans"))
