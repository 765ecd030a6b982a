"""Joins and summaries of review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from critiq import fixed_values as fixed
from critiq.functions import text as T
from critiq.functions.arrays import equal_width_bin
from critiq.operators.ordered import quantile_columns, value_counts


def merge_books_and_reviews(
    books: DataFrame, reviews: DataFrame, match_null_keys: bool = False, salts: int = 1
) -> DataFrame:
    """Reviews with title and main category of their book; several books fan out.

    Which side moves is left to Spark: a book table under the session's
    broadcast limit is broadcast, a larger one is shuffled and hot books are
    split by adaptive execution. Where that is switched off, `salts` spreads
    the reviews of each book over as many tasks, at the price of that many
    copies of the three book columns. Both sides are then shuffled and sorted,
    which spills: Spark's size estimate misses the copies, and a broadcast of
    them would grow with the books in every task.
    """
    wanted = books.select("asin", "title", "main_category")
    if salts > 1:
        hashable = [f.name for f in reviews.schema if "map<" not in f.dataType.simpleString()]
        # A hash of the row, so that a repeated task gives each row the same salt.
        salt = F.pmod(F.xxhash64(*hashable), F.lit(salts))
        every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
        salted = _merge_on(
            wanted.withColumn("_salt", every_salt),
            reviews.withColumn("_salt", salt).hint("merge"),
            match_null_keys,
        )
        return salted.drop("_salt")
    return _merge_on(wanted, reviews, match_null_keys)


def _merge_on(wanted: DataFrame, reviews: DataFrame, match_null_keys: bool) -> DataFrame:
    keys = [name for name in ("asin", "_salt") if name in wanted.columns]
    if not match_null_keys:
        return reviews.join(wanted, keys, "left")
    renamed = wanted.withColumnsRenamed({name: f"_book_{name}" for name in keys})
    same = [reviews[name].eqNullSafe(renamed[f"_book_{name}"]) for name in keys]
    return reviews.join(renamed, same, "left").drop(*[f"_book_{name}" for name in keys])


def prepare_for_analysis(reviews: DataFrame) -> DataFrame:
    """Rename the review columns, parse the time, add length in characters and word count."""
    renamed = reviews.withColumnsRenamed(
        {
            "reviewText": "review_text",
            "overall": "rating",
            "reviewTime": "review_time",
            "unixReviewTime": "unix_review_time",
        }
    )
    return renamed.withColumns(
        {
            "review_time": T.parse_review_time(F.col("review_time")),
            "review_length": F.length("review_text").cast("long"),
            "word_count": T.word_count(F.col("review_text")).cast("long"),
        }
    )


def training_text(reviews: DataFrame) -> DataFrame:
    """Replace the text by title and text together; add whether the review was helpful."""
    together = F.concat(
        F.lit("Title: "),
        F.coalesce("title", F.lit("")),
        F.lit(" Review: "),
        F.coalesce("text", F.lit("")),
    )
    return reviews.withColumns(
        {"text": together, "is_helpful": (F.col("helpful_votes") > 0).cast("int")}
    )


def rating_summary(
    reviews: DataFrame, rating: str = "rating", text_length: str = "review_length", category: str = "category"
) -> DataFrame:
    """One row of statistics; a missing category counts as a category."""
    return reviews.agg(
        F.count("*").alias("total_reviews"),
        F.avg(rating).alias("average_rating"),
        F.stddev_samp(rating).alias("rating_std"),
        F.min(rating).alias("min_rating"),
        F.max(rating).alias("max_rating"),
        F.avg(text_length).alias("average_review_length"),
        (
            F.count_distinct(category) + F.coalesce(F.max(F.col(category).isNull().cast("int")), F.lit(0))
        ).alias("total_categories"),
    )


def category_ratings(
    reviews: DataFrame, category: str = "category", rating: str = "rating"
) -> DataFrame:
    """Mean rating per category, best first; rows without a category are left out."""
    return (
        reviews.filter(F.col(category).isNotNull())
        .groupBy(F.col(category).alias("category"))
        .agg(F.avg(rating).alias("avg_rating"))
        .orderBy(F.desc("avg_rating"), "category")
    )


def top_categories(
    reviews: DataFrame,
    category: str = "category",
    rating: str = "rating",
    k: int = fixed.TOP_CATEGORIES,
) -> DataFrame:
    """The k categories with the best mean rating."""
    return category_ratings(reviews, category, rating).limit(k)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Rows per bin of equal width between the smallest and the largest value.

    Nulls, NaN and infinite values are left out.
    """
    known = df.select(F.col(value).cast("double").alias("_v"))
    known = known.filter(F.abs("_v") < float("inf"))
    known = known.filter(~F.isnan("_v"))
    low = known.select(F.min("_v")).scalar()
    high = known.select(F.max("_v")).scalar()
    binned = known.select(equal_width_bin(F.col("_v"), low, high, bins).alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))


def box_statistics(df: DataFrame, value: str = "rating") -> DataFrame:
    """Quartiles, the values the whiskers reach, and the number of rows beyond them."""
    q1, median, q3 = quantile_columns(value, (0.25, 0.5, 0.75))
    box = F.struct(q1.alias("q1"), median.alias("median"), q3.alias("q3"))
    quartiles = value_counts(df, value).agg(box).scalar()
    reach = 1.5 * (quartiles["q3"] - quartiles["q1"])
    inside = F.col(value).between(quartiles["q1"] - reach, quartiles["q3"] + reach)
    return df.agg(
        F.min(F.when(inside, F.col(value))).alias("lower_whisker"),
        F.max(F.when(inside, F.col(value))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"),
    ).select(*[quartiles[q].alias(q) for q in ("q1", "median", "q3")], "*")
