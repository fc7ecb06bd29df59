"""A folder of page JSON files as a stream of elements; stateless, beyond the batch sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.ocr_json import layout_elements

SCHEMA = "pdf_hash string, page_index int, page_json string"


def elements(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Elements of new files (JSON lines of :data:`SCHEMA`) as they arrive."""
    pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return layout_elements(pages, ("pdf_hash", "page_index"))


def labels_per_window(stream: DataFrame, length: str = "10 minutes") -> DataFrame:
    """Elements by label and arrival window, late rows dropped after one more window."""
    timed = stream.withColumn("at", F.current_timestamp()).withWatermark("at", length)
    return timed.groupBy(F.window("at", length), "type").agg(F.count("*").alias("n"))
