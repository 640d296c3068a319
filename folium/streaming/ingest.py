"""Streaming ingest: new DOCX or HTML files of a folder become node rows as they arrive.

Every kernel works on one document alone, so no state store is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.sources import documents as D


def stream_nodes(spark: SparkSession, folder: str, kind: str = "docx", files_per_trigger: int = 1000) -> DataFrame:
    """A streaming node table; doc_id is a hash of the file's path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"*.{kind}").load(folder)
    value = F.decode("content", "UTF-8") if kind == "html" else F.col("content")
    return D.nodes(found.select(F.xxhash64("path").alias("doc_id"), value.alias("content")), "doc_id", "content", kind)
