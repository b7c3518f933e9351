"""Optional: a folder of .sql files as a stream; every new file is reviewed once, exactly as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.sections import section


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, sql of files as they arrive."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return files.select(F.col("_metadata.file_path").alias("query_id"), F.col("value").alias("sql"))


def review_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, name: str = "findings"):
    """Appends a section of every new file to a Parquet table. Each section is a stateless pass, so nothing is kept between
    batches but the list of files read."""
    return section(watch(spark, folder), name).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
