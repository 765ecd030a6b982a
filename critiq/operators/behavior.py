"""Per-user behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from critiq.operators.ordered import running_totals


def _seconds(micros: Column) -> Column:
    return micros / F.lit(1_000_000.0)


def behavioral_features(events: DataFrame) -> DataFrame:
    """Frequency, mean gap, mean rating, its deviation and mean text length per user.

    Expects user_id, timestamp, rating and text. The gaps between a user's
    consecutive times add up to the last time minus the first, so their mean
    needs no ordering: every feature is a partial aggregate, and a user with
    very many rows costs no more than others.
    """
    stamped = events.filter(F.col("user_id").isNotNull()).select(
        "user_id",
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_us"),
        "rating",
        F.length("text").alias("_length"),
    )
    per_user = stamped.groupBy("user_id").agg(
        F.count("_us").alias("review_frequency"),
        (F.max("_us") - F.min("_us")).alias("_span"),
        F.avg("rating").alias("avg_rating"),
        F.stddev_samp("rating").alias("rating_std"),
        F.avg("_length").alias("avg_review_length"),
    )
    gaps = F.col("review_frequency") - 1
    overall = per_user.filter(gaps > 0).select(
        _seconds(F.sum("_span")) / F.nullif(F.sum(gaps), F.lit(0))
    )
    return per_user.select(
        "user_id",
        "review_frequency",
        F.when(gaps > 0, _seconds(F.col("_span")) / gaps).alias("avg_gap_seconds"),
        overall.scalar().alias("global_avg_gap_seconds"),
        "avg_rating",
        "rating_std",
        "avg_review_length",
    )


def review_gaps(events: DataFrame) -> DataFrame:
    """Each moment a user wrote at, with how many reviews and the seconds since the one before.

    Reviews of the same moment are one row; their gaps among themselves are 0.
    A user with a very large share of the rows is worked on in ranges of time.
    """
    moments = (
        events.filter(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("user_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"))
        .agg(F.count("*").alias("n_reviews"))
    )
    # From the last moment to the first, the next row is the moment before.
    steps = running_totals(
        moments, "us", ["n_reviews"], within=["user_id"], carry_next=["us"], descending=True
    )
    return steps.select(
        "user_id",
        F.timestamp_micros("us").alias("timestamp"),
        "n_reviews",
        _seconds(F.col("us") - F.col("next_us")).alias("gap_seconds"),
    )


def behavioral_features_windowed(events: DataFrame, time_window: str = "1 day") -> DataFrame:
    """The features per user and window of time; works on a stream with a watermark."""
    return (
        events.filter(F.col("user_id").isNotNull())
        .groupBy(F.window("timestamp", time_window).alias("_window"), "user_id")
        .agg(
            F.count("timestamp").alias("review_frequency"),
            F.avg("rating").alias("avg_rating"),
            F.stddev_samp("rating").alias("rating_std"),
            F.avg(F.length("text")).alias("avg_review_length"),
        )
        .select(
            F.col("_window.start").alias("window_start"),
            "user_id",
            "review_frequency",
            "avg_rating",
            "rating_std",
            "avg_review_length",
        )
    )
