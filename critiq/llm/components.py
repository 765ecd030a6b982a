"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.session import discard, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all linked ids; the component is the smallest id that is reached.

    `links` has the columns a and b. Each round joins every id's larger neighbours to its
    smallest neighbour and then every id to the smallest of the neighbours below it; this
    ends in stars after a number of rounds that grows with the logarithm of the longest path.
    Each round is written to the shared folder, and the one before it removed. Ids are of any type
    that has an order. Neighbours of a frequent id are counted before
    they are shuffled, and its rows are joined, which adaptive execution can split.
    """
    edges = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    )
    edges = written(edges.distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("least"))
        least = least.select(F.col("high").alias("node"), F.least("high", "least").alias("least"))
        large = both.join(least, F.col("high") == F.col("node")).where(F.col("low") > F.col("high"))
        large = large.select(F.col("low").alias("high"), F.col("least").alias("low"))
        below = large.groupBy("high").agg(F.min("low").alias("least"))
        below = below.withColumnRenamed("high", "node")
        small = large.join(below, F.col("high") == F.col("node")).where(F.col("low") != F.col("least"))
        small = small.select(F.col("low").alias("high"), F.col("least").alias("low"))
        last, edges = edges, written(small.unionByName(below.toDF("high", "low")).distinct(), "links")
        discard(last)
    stars = edges.select(F.col("high").alias("id"), F.col("low").alias("component"))
    return stars.unionByName(edges.select(F.col("low").alias("id"), F.col("low").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id has one lower neighbour at most, and none if it is one itself."""
    ends = edges.select(F.col("high").alias("node"), F.lit(1).alias("is_high")).unionByName(
        edges.select(F.col("low").alias("node"), F.lit(0).alias("is_high"))
    )
    ends = ends.groupBy("node").agg(F.sum("is_high").alias("high"), F.count("*").alias("all"))
    mixed = (F.col("high") > 1) | ((F.col("high") == 1) & (F.col("all") > 1))
    return ends.where(mixed).isEmpty()
