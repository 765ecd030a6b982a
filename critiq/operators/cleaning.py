"""Cleaning of whole texts, with an optional table of lemmas."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from critiq.functions import text as T
from critiq.operators import lookup
from critiq.operators.bounds import LITERAL_ENTRIES, rows_if_small


def clean_texts(
    docs: DataFrame,
    key: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = (),
    lemmas: DataFrame | None = None,
    literal_entries: int = LITERAL_ENTRIES,
) -> DataFrame:
    """Key and cleaned_text: content words joined by a space, each replaced by its lemma if it has one.

    `lemmas` has the columns token and lemma. A word without a lemma, or with a
    null one, stays; of several lemmas the last in the alphabet counts. A small table is
    written into the plan, a larger one is broadcast in blocks, with the same result.
    """
    split = docs.select(*key, T.content_tokens(F.col(text), stop_words).alias("_words"))
    if lemmas is None:
        return split.select(*key, F.array_join("_words", " ").alias("cleaned_text"))
    known = lemmas.select("token", "lemma").where(F.col("token").isNotNull() & F.col("lemma").isNotNull())
    known = known.groupBy("token").agg(F.max("lemma").alias("lemma"))
    rows = rows_if_small(known, literal_entries)
    if rows == []:
        return clean_texts(docs, key, text, stop_words)
    if rows is not None:
        pairs = {row["token"]: row["lemma"] for row in rows}
        lemma_of = F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")
        replaced = F.transform(
            "_words",
            lambda word: F.when(word.isin(list(pairs)), F.try_element_at(lemma_of, word)).otherwise(word),
        )
        return split.select(*key, F.array_join(replaced, " ").alias("cleaned_text"))
    replaced = F.col("_words")
    for block in lookup.dictionary_blocks(known, "token", split, F.col("_words")):
        found = lookup.replacements(F.col("_words"), block)
        replaced = F.zip_with(found, replaced, lambda lemma, word: F.coalesce(lemma, word))
    return split.select(*key, F.array_join(replaced, " ").alias("cleaned_text"))
