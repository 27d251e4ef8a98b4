"""Retrieval runs and judgements as they arrive.

The batch operators work on streams as they are where they are stateless; what
needs state is kept per query with a watermark, so that it can be let go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum by window and key; windows are final once the watermark has passed them."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def first_judgements(stream: DataFrame, time: str = "judged_at", late: str = "30 days") -> DataFrame:
    """Judgements without repeats of the same query and document within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["qid", "docid"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that appends to a parquet table until the available input is used up."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is there and reads the table it wrote."""
    query = run_to_table(stream, path, checkpoint)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
