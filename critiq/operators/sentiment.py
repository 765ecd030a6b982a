"""Lexicon sentiment.

Scores are kept as whole ten-thousandths while they are added, so the polarity
of a text does not depend on the order of addition and sign tests are exact.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from critiq import fixed_values as fixed
from critiq.functions import text as T
from critiq.operators import lookup
from critiq.operators.bounds import LITERAL_ENTRIES, rows_if_small

UNITS = 10_000
TALLY_TYPE = "struct<units: bigint, hits: bigint, positive: bigint, negative: bigint>"


def exact_units(score: float) -> int:
    """A score in whole units; finer scores are an error, not rounded."""
    units = round(score * UNITS)
    if abs(score * UNITS - units) > 1e-6:
        raise ValueError(f"scores have four decimals at most: {score}")
    return units


def _known_scores(lexicon: DataFrame) -> DataFrame:
    """One row per word: of a word that is listed twice the highest score counts; nulls are left out."""
    given = lexicon.select("word", F.col("score").cast("double").alias("score"))
    given = given.where(F.col("word").isNotNull() & F.col("score").isNotNull())
    return given.groupBy("word").agg(F.max("score").alias("score"))


def tally_tokens(words: Column, lexicon: Mapping[str, float]) -> Column:
    """Sum of scores and counts of scored words, within the row."""
    by_word = {word: exact_units(score) for word, score in lexicon.items()}
    scored = list(by_word)
    # Words that are not listed are sorted out by a hash set before the map is searched.
    units_of = F.from_json(F.lit(json.dumps(by_word)), "map<string,bigint>")
    listed = F.filter(words, lambda word: word.isin(scored))
    units = F.transform(listed, lambda word: F.try_element_at(units_of, word))
    empty = F.struct(*[F.lit(0).cast("long").alias(name) for name in ("units", "hits", "positive", "negative")])
    return F.aggregate(
        units,
        empty,
        lambda tally, value: F.struct(
            (tally["units"] + value).alias("units"),
            (tally["hits"] + 1).alias("hits"),
            (tally["positive"] + F.when(value > 0, 1).otherwise(0)).alias("positive"),
            (tally["negative"] + F.when(value < 0, 1).otherwise(0)).alias("negative"),
        ),
    )


def _tally_by_blocks(df: DataFrame, words: Column, lexicon: DataFrame) -> Column:
    """The same tally for a lexicon of any size, which is broadcast in blocks."""
    exact = F.col("score") * UNITS
    finer = F.abs(exact - F.round(exact)) > 1e-6
    message = F.concat(F.lit("scores have four decimals at most: "), F.col("score").cast("string"))
    value = F.when(finer, F.raise_error(message).cast("long")).otherwise(F.round(exact).cast("long"))
    scores = lexicon.select("word", value.alias("value"))
    scores.agg(F.max("value")).first()  # stops at a score that is too fine
    found = [lookup.tallies(words, block, TALLY_TYPE) for block in lookup.dictionary_blocks(scores, "word", df, words)]
    if not found:
        return tally_tokens(words, {})
    if len(found) == 1:
        return found[0]
    added = F.array(*found)
    names = ("units", "hits", "positive", "negative")
    return F.struct(*[F.aggregate(added, F.lit(0).cast("long"), lambda total, t: total + t[n]).alias(n) for n in names])


def _scores(tally: Column, n_words: Column) -> Column:
    total = tally["units"] / F.lit(float(UNITS))
    share = lambda n: F.when(n_words > 0, n / n_words).otherwise(F.lit(0.0))
    return F.struct(
        F.when(
            tally["hits"] > 0, tally["units"] / (F.lit(float(UNITS)) * tally["hits"])
        )
        .otherwise(F.lit(0.0))
        .alias("polarity"),
        share(tally["negative"]).alias("neg"),
        share(n_words - tally["negative"] - tally["positive"]).alias("neu"),
        share(tally["positive"]).alias("pos"),
        (total / F.sqrt(total * total + 15)).alias("compound"),
    )


def cleaned_words(cleaned: str) -> Column:
    """The words of a cleaned text; none for a missing text."""
    return F.coalesce(T.tokens(F.col(cleaned)), F.array().cast("array<string>"))


def with_word_sentiment(
    df: DataFrame,
    words: str,
    lexicon: Mapping[str, float] | DataFrame = fixed.DEFAULT_LEXICON,
    key: Sequence[str] = (),
    name: str = "sentiment",
    literal_entries: int = LITERAL_ENTRIES,
) -> DataFrame:
    """Add struct (polarity, neg, neu, pos, compound) of a column of words.

    A lexicon given as a data frame (word, score) is read into the plan when it
    has at most `literal_entries` words and broadcast in blocks otherwise, with the
    same result. Scores have four decimals at most.
    """
    if isinstance(lexicon, DataFrame):
        lexicon = _known_scores(lexicon)
        rows = rows_if_small(lexicon, literal_entries)
        if rows is not None:
            lexicon = {row["word"]: row["score"] for row in rows}
    if isinstance(lexicon, DataFrame):
        tally = _tally_by_blocks(df, F.col(words), lexicon)
    else:
        tally = tally_tokens(F.col(words), lexicon)
    tallied = df.withColumn("_tally", tally)
    scores = _scores(F.col("_tally"), F.size(words))
    return tallied.withColumn(name, scores).drop("_tally")


def with_sentiment(
    df: DataFrame,
    cleaned: str = "cleaned_text",
    lexicon: Mapping[str, float] | DataFrame = fixed.DEFAULT_LEXICON,
    key: Sequence[str] = (),
    name: str = "sentiment",
    literal_entries: int = LITERAL_ENTRIES,
) -> DataFrame:
    """with_word_sentiment of a cleaned text."""
    # The words are a column of their own, so that each use does not split again.
    split = df.withColumn("_words", cleaned_words(cleaned))
    return with_word_sentiment(split, "_words", lexicon, key, name, literal_entries).drop("_words")
