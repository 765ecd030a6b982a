"""Scoring and windowed behaviour over a stream of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from critiq.operators.behavior import behavioral_features_windowed
from critiq.operators.reviews import analyze_reviews


def read_review_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    pattern: str = "*.parquet",
    partitions: int | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New parquet files of a folder as a stream, oldest first, dealt to `partitions` if given.

    Dealing helps when a batch is a few files that cannot be split.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(folder)
    return stream.repartition(partitions) if partitions else stream


def score_stream(reviews: DataFrame, **options) -> DataFrame:
    """Analyse every review as it comes; the analysis keeps no state."""
    return analyze_reviews(reviews, **options)


def windowed_behavior_stream(
    events: DataFrame, time_window: str = "1 day", lateness: str = "1 day"
) -> DataFrame:
    """Features per user and window; a window is final once `lateness` has passed."""
    return behavioral_features_windowed(events.withWatermark("timestamp", lateness), time_window)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to parquet, then stop; restarts where it ended."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
