"""Review analysis and the reports drawn from it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from critiq import fixed_values as fixed
from critiq.functions import speech as S
from critiq.functions import text as T
from critiq.operators.sentiment import cleaned_words, with_word_sentiment

# Review type -> condition over an analysed review.
TYPE_FLAGS = {
    "Emotional": "speech_analysis.emotional_intensity",
    "Sarcastic": "speech_analysis.is_sarcastic",
    "Exaggerated": "speech_analysis.is_exaggerated",
    "Personal": "speech_analysis.is_personal",
    "Recommendation": "speech_analysis.is_recommendation",
}


def type_flag(review_type: str) -> Column:
    flag = F.col(TYPE_FLAGS[review_type])
    return S.is_emotional(flag) if review_type == "Emotional" else flag


def polarity() -> Column:
    return F.col("sentiment_analysis.textblob_sentiment")


def two_way_sentiment() -> Column:
    """Positive above zero; zero counts as Negative."""
    return F.when(polarity() > 0, "Positive").otherwise("Negative")


def analyze_reviews(
    reviews: DataFrame,
    text: str = "review_text",
    lexicon: Mapping[str, float] | DataFrame = fixed.DEFAULT_LEXICON,
    vocabulary: S.SpeechVocabulary = S.DEFAULT_VOCABULARY,
    transformer_score: str | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Add cleaned_text, sentiment_analysis, speech_analysis and is_anomaly to every review.

    Works row by row without a shuffle, on a stream too. `transformer_score`
    names a column holding a positive-class probability computed elsewhere.
    """
    outside = F.col(transformer_score) if transformer_score else F.lit(None)
    cleaned = reviews.withColumn("cleaned_text", T.clean_review_text(F.col(text)))
    split = cleaned.withColumn("_words", cleaned_words("cleaned_text"))
    scored = with_word_sentiment(split, "_words", lexicon, key, "_sentiment")
    # Flags are columns before they are fields: a report that looks at a flag
    # several times then still searches the text for it once.
    flags = S.speech_flags(F.col("cleaned_text"), F.col("_words"), vocabulary)
    flagged = scored.withColumns({f"_{name}": flag for name, flag in flags.items()})
    sentiment = F.struct(
        F.col("_sentiment.polarity").alias("textblob_sentiment"),
        F.struct(
            "_sentiment.neg", "_sentiment.neu", "_sentiment.pos", "_sentiment.compound"
        ).alias("vader_scores"),
        outside.cast("double").alias("transformer_sentiment"),
    )
    speech = F.struct(
        F.abs(F.col("_sentiment.polarity")).alias("emotional_intensity"),
        *[F.col(f"_{name}").alias(name) for name in flags],
    )
    return (
        flagged.withColumns({"sentiment_analysis": sentiment, "speech_analysis": speech})
        .withColumn("is_anomaly", S.is_anomaly(polarity(), F.col("speech_analysis")))
        .drop("_words", "_sentiment", *[f"_{name}" for name in flags])
    )


def review_report(analysed: DataFrame) -> DataFrame:
    """One row: totals, anomaly share, sentiment and speech pattern counts."""
    count_type = [F.count_if(type_flag(t)).alias(t.lower()) for t in fixed.REVIEW_TYPES]
    return analysed.agg(
        F.count("*").alias("total_reviews"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.count_if(polarity() > 0).alias("positive"),
        F.count_if(polarity() < 0).alias("negative"),
        F.count_if(polarity() == 0).alias("neutral"),
        *count_type,
    ).withColumn(
        "anomaly_pct",
        100.0 * F.col("anomaly_count") / F.nullif(F.col("total_reviews"), F.lit(0)),
    )


def _counts_to_rows(counts: DataFrame, labels: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Turn one row of counts c0, c1, ... into labelled rows."""
    rows = [
        F.struct(
            *[F.lit(value).alias(name) for value, name in zip(label, names)],
            F.col(f"c{i}").alias("n"),
        )
        for i, label in enumerate(labels)
    ]
    return counts.select(F.inline(F.array(*rows)))


def _count_each(conditions: Iterable[Column]) -> list[Column]:
    return [F.count_if(condition).alias(f"c{i}") for i, condition in enumerate(conditions)]


def type_sentiment_counts(analysed: DataFrame) -> DataFrame:
    """Reviews per type and sentiment; a review counts once for each of its types."""
    labels = [(t, s) for t in fixed.REVIEW_TYPES for s in ("Positive", "Negative")]
    counts = analysed.agg(
        *_count_each(type_flag(t) & (two_way_sentiment() == s) for t, s in labels)
    )
    return _counts_to_rows(counts, labels, ("type", "sentiment")).filter("n > 0")


def emotion_flow(analysed: DataFrame) -> DataFrame:
    """Flow from emotional and sarcastic reviews to sentiment, and on to its strength.

    A review that is both emotional and sarcastic flows twice.
    """
    first = [(t, s) for t in ("Emotional", "Sarcastic") for s in ("Positive", "Negative")]
    second = [(s, band) for s in ("Positive", "Negative") for band in ("High", "Low")]
    band = F.when(F.abs(polarity()) > fixed.HIGH_BAND, "High").otherwise("Low")
    entries = type_flag("Emotional").cast("long") + type_flag("Sarcastic").cast("long")
    counts = analysed.agg(
        *_count_each(type_flag(t) & (two_way_sentiment() == s) for t, s in first),
        *[
            F.coalesce(
                F.sum(F.when((two_way_sentiment() == s) & (band == b), entries)), F.lit(0)
            ).alias(f"c{i}")
            for i, (s, b) in enumerate(second, start=len(first))
        ],
    )
    return _counts_to_rows(counts, first + second, ("source", "target"))


def type_cooccurrence(analysed: DataFrame) -> DataFrame:
    """Number of reviews that carry both types, for each pair that occurs."""
    pairs = list(combinations(fixed.REVIEW_TYPES, 2))
    counts = analysed.agg(*_count_each(type_flag(a) & type_flag(b) for a, b in pairs))
    return (
        _counts_to_rows(counts, pairs, ("type_a", "type_b"))
        .filter("n > 0")
        .withColumnRenamed("n", "weight")
    )


def type_term_counts(
    analysed: DataFrame,
    k: int = 200,
    stop_words: Iterable[str] = (),
    types: Sequence[str] = ("Emotional", "Sarcastic", "Personal", "Recommendation"),
) -> DataFrame:
    """The k most frequent words in the reviews of each type.

    Words are counted once with one counter per type, so the shuffle carries
    distinct words and not one copy of the text per type.
    """
    words = T.long_words(T.keep_words(T.tokens(F.col("cleaned_text")), stop_words))
    flags = [type_flag(t).alias(f"_{t}") for t in types]
    counted = (
        analysed.select(F.explode(words).alias("token"), *flags)
        .groupBy("token")
        .agg(*[F.count_if(f"_{t}").alias(t) for t in types])
    )
    rows = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("n")) for t in types])
    by_type = counted.select("token", F.inline(rows)).filter("n > 0")
    best_first = W.partitionBy("type").orderBy(F.desc("n"), "token")
    return by_type.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)


def primary_type() -> Column:
    """The first type that applies; exaggeration is not among the choices."""
    chosen = F.lit("Other")
    for review_type in ("Recommendation", "Personal", "Sarcastic", "Emotional"):
        chosen = F.when(type_flag(review_type), review_type).otherwise(chosen)
    return chosen


def review_timeline(analysed: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Time, sentiment, primary type and verdict of each review; now if it has no time."""
    when = F.col(timestamp) if timestamp in analysed.columns else F.lit(None)
    return analysed.select(
        F.coalesce(when, F.current_timestamp()).alias("timestamp"),
        polarity().alias("sentiment"),
        primary_type().alias("type"),
        "is_anomaly",
    )


def review_features(analysed: DataFrame, name: str = "features") -> DataFrame:
    """Add the seven numbers that describe a review: two sentiments, intensity, four flags."""
    flags = ("is_sarcastic", "is_exaggerated", "is_personal", "is_recommendation")
    return analysed.withColumn(
        name,
        F.array(
            polarity(),
            F.col("sentiment_analysis.transformer_sentiment"),
            F.col("speech_analysis.emotional_intensity"),
            *[F.col(f"speech_analysis.{flag}").cast("double") for flag in flags],
        ),
    )
