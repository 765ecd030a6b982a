"""Statistics of feature vectors and comparison of two samples of them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from critiq import fixed_values as fixed
from critiq.functions.arrays import equal_width_bin, mean_squared_difference
from critiq.operators.ordered import running_totals
from critiq.session import written

# Bytes of vectors in a block of the pairwise distance; a pair of blocks is one task's work.
BLOCK_BYTES = 64 << 20
# Vectors that are worth a block of their own in a small table.
LEAST_ROWS = 256


def _elements(df: DataFrame, vector: str, *others: str) -> DataFrame:
    return df.select(*others, F.posexplode(vector).alias("pos", "value")).withColumn(
        "value", F.col("value").cast("double")
    )


def feature_statistics(df: DataFrame, vector: str = "vec") -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each feature.

    One partial aggregate over whole vectors; only the statistics move.
    """
    names = ("mean", "std", "min", "max")
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    found = df.select(Summarizer.metrics(*names).summary(as_vector).alias("s"))
    lists = [vector_to_array(F.col(f"s.{name}")).alias(name) for name in names]
    per_feature = found.select(*lists).select(F.posexplode(F.arrays_zip(*names)).alias("pos", "f"))
    return per_feature.select("pos", "f.mean", "f.std", "f.min", "f.max")


def wasserstein_by_feature(
    real: DataFrame, fake: DataFrame, vector: str = "vec"
) -> DataFrame:
    """Wasserstein-1 distance of each feature between two samples.

    The area between the two distribution functions: running counts over the
    distinct values of both samples, each weighted by the step to the next value.
    """
    both = _elements(real, vector).withColumns({"real": F.lit(1), "fake": F.lit(0)}).unionByName(
        _elements(fake, vector).withColumns({"real": F.lit(0), "fake": F.lit(1)})
    )
    per_value = both.groupBy("pos", "value").agg(
        F.sum("real").alias("real"), F.sum("fake").alias("fake")
    )
    steps = running_totals(
        per_value, "value", ["real", "fake"], within=["pos"], carry_next=["value"]
    )
    apart = F.abs(F.col("cum_real") / F.col("all_real") - F.col("cum_fake") / F.col("all_fake"))
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return steps.groupBy("pos").agg(F.sum(apart * width).alias("distance"))


def wasserstein_distance(real: DataFrame, fake: DataFrame, vector: str = "vec") -> DataFrame:
    """The mean over features of the Wasserstein-1 distance."""
    return wasserstein_by_feature(real, fake, vector).agg(
        F.avg("distance").alias("wasserstein_distance")
    )


def _tile_total():
    """A function that adds up the distances between two blocks of weighted vectors, by array products."""
    step = 1024

    def total(left, right):
        import numpy as np
        import pyarrow as pa

        def block(table):
            vectors = table.column("vec").combine_chunks()
            return np.asarray(vectors.flatten()).reshape(table.num_rows, -1), np.asarray(table.column("w"), float)

        result = 0.0
        if left.num_rows and right.num_rows:
            (a, wa), (b, wb) = block(left), block(right)
            centre = b.mean(axis=0)  # differences stay, and products lose fewer digits
            a, b = a - centre, b - centre
            na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
            for i in range(0, len(a), step):
                for j in range(0, len(b), step):
                    x, y = slice(i, i + step), slice(j, j + step)
                    sizes = na[x, None] + nb[None, y]
                    squares = sizes - 2 * (a[x] @ b[y].T)
                    close = np.nonzero(squares <= 1e-6 * sizes)  # too few digits left: taken directly
                    squares[close] = ((a[x][close[0]] - b[y][close[1]]) ** 2).sum(axis=1)
                    result += float(wa[x] @ np.sqrt(np.maximum(squares, 0)) @ wb[y])
            if left.column("i")[0] == left.column("j")[0]:
                result /= 2  # both orders of each pair were added
        return pa.table({"total": [result]})

    return total


def diversity_score(
    df: DataFrame, vector: str = "vec", block_rows: int | None = None
) -> DataFrame:
    """Mean Euclidean distance over all pairs of different rows, exactly.

    The number of distances grows with the square of the rows whatever is done;
    what is avoided is to have them as rows. Equal vectors are merged into one
    with a weight, so copies cost nothing. The distinct vectors are spread over b
    blocks by hash, as large as a task's memory allows, and each pair of blocks, in
    one order, is a tile of a triangular grid: b (b + 1) / 2 tiles, b + 1 copies of
    each vector. A tile is worked on by array products, and only its sum leaves the
    task. Missing vectors are left out.
    """
    spark = df.sparkSession
    distinct = written(
        df.select(F.col(vector).cast("array<double>").alias("vec"))
        .where(F.col("vec").isNotNull())
        .groupBy("vec")
        .agg(F.count("*").alias("w")),
        "vectors",
    )
    n_distinct, width = distinct.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    rows = block_rows or max(1, BLOCK_BYTES // (8 * max(1, width)))
    blocks = max(1, -(-n_distinct // rows))
    if block_rows is None:  # small tables: enough tiles for all cores
        tiles = 2 * spark.sparkContext.defaultParallelism
        blocks = max(blocks, min(-(-n_distinct // LEAST_ROWS) or 1, math.isqrt(2 * tiles)))
    placed = distinct.withColumn("block", F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int"))
    last = F.lit(blocks - 1)
    left = placed.withColumn("j", F.explode(F.sequence("block", last))).withColumn(
        "i", F.col("block")
    )
    right = placed.withColumn("i", F.explode(F.sequence(F.lit(0), "block"))).withColumn(
        "j", F.col("block")
    )
    sums = (
        left.groupBy("i", "j")
        .cogroup(right.groupBy("i", "j"))
        .applyInArrow(_tile_total(), "total double")
    )
    n = distinct.select(F.sum("w").cast("double")).scalar()
    return sums.agg(
        (2 * F.sum("total") / F.nullif(n * (n - 1), F.lit(0.0))).alias("diversity_score")
    )


def _summed(df: DataFrame, column: str) -> Column:
    return df.select(column).scalar()


def two_sample_evaluation(
    real: DataFrame, fake: DataFrame, vector: str = "vec", score: str = "score"
) -> DataFrame:
    """Distance, diversity of the second sample, and how well a score tells them apart.

    A score above one half says 'real'; precision, recall and F1 are of that verdict.
    """
    labelled = real.select(score, F.lit(1).alias("y_true")).unionByName(
        fake.select(score, F.lit(0).alias("y_true"))
    )
    says_real = F.col(score) > fixed.SCORE_CUT
    is_real = F.col("y_true") == 1
    verdicts = labelled.agg(
        F.count_if(is_real & says_real).alias("_hits"),
        F.count_if(says_real).alias("_predicted"),
        F.count_if(is_real).alias("_actual"),
        F.avg(F.when(is_real, F.col(score))).alias("real_mean_score"),
        F.avg(F.when(~is_real, F.col(score))).alias("fake_mean_score"),
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))

    hits, predicted, actual = F.col("_hits"), F.col("_predicted"), F.col("_actual")
    return verdicts.select(
        _summed(wasserstein_distance(real, fake, vector), "wasserstein_distance").alias(
            "wasserstein_distance"
        ),
        _summed(diversity_score(fake, vector), "diversity_score").alias("diversity_score"),
        ratio(hits, predicted).alias("discriminator_precision"),
        ratio(hits, actual).alias("discriminator_recall"),
        ratio(2 * hits, predicted + actual).alias("discriminator_f1"),
        "real_mean_score",
        "fake_mean_score",
    )


def feature_histograms(
    real: DataFrame,
    fake: DataFrame,
    vector: str = "vec",
    features: Sequence[int] | None = None,
    bins: int = 20,
) -> DataFrame:
    """Histogram of each feature, or of the chosen ones, for the real and the generated sample apart.

    Values that are null, NaN or infinite are left out. The spans of all features are one
    partial aggregate; they are two rows a feature, so they are broadcast to the values.
    """

    def values(sample: DataFrame, origin: str) -> DataFrame:
        cells = _elements(sample, vector).select(F.lit(origin).alias("origin"), "pos", "value")
        known = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
        return cells.where(known if features is None else known & F.col("pos").isin(list(features)))

    both = values(real, "Real").unionByName(values(fake, "Generated"))
    spans = both.groupBy("origin", "pos").agg(
        F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    bin_of = equal_width_bin(F.col("value"), F.col("_low"), F.col("_high"), bins)
    return (
        both.join(F.broadcast(spans), ["origin", "pos"])
        .groupBy("origin", "pos", bin_of.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def reconstruction_anomaly(
    df: DataFrame,
    x: str = "x",
    x_hat: str = "x_hat",
    threshold: float = fixed.RECONSTRUCTION_THRESHOLD,
) -> DataFrame:
    """Add the reconstruction error of each row and whether it exceeds the threshold."""
    return df.withColumn("error", mean_squared_difference(F.col(x), F.col(x_hat))).withColumn(
        "is_anomaly", F.col("error") > threshold
    )


def group_mean_vectors(df: DataFrame, group: str, vector: str = "vec") -> DataFrame:
    """The mean vector of each group, one partial aggregate."""
    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(group).agg(vector_to_array(Summarizer.mean(as_vector)).alias("mean_vec"))
