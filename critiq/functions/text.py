"""Text functions.

The character classes are spelled out so that they mean the same in every
language of text: a word character is any letter, number or underscore, and
white space includes the non-breaking and ideographic spaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, functions as F

from critiq import fixed_values as fixed

_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
_WORD = r"\p{L}\p{N}_"
SPACE = f"[{_SPACE}]"
NON_SPACE = f"[^{_SPACE}]"
WORD = f"[{_WORD}]"
NON_WORD = f"[^{_WORD}]"
PUNCTUATION = f"[^{_WORD}{_SPACE}]"
URL = f"http{NON_SPACE}+|www{NON_SPACE}+"
DIGIT = r"\p{Nd}"


def whole_words(words: Iterable[str]) -> str:
    """Pattern that finds any of the words in a lower-case text, between non-word characters."""
    options = "|".join(re.escape(word.lower()) for word in words)
    return f"(?:^|{NON_WORD})(?:{options})(?:$|{NON_WORD})"


def word_then_word(words: Iterable[str]) -> str:
    """Pattern that finds any of the words before white space and another word, in lower case."""
    options = "|".join(re.escape(word.lower()) for word in words)
    return f"(?:^|{NON_WORD})(?:{options}){SPACE}+{WORD}"


def _without_urls(text: Column) -> Column:
    """The text in lower case; only one with the start of a URL is searched for them."""
    # The one-element array binds the lower-case text once.
    return F.transform(
        F.array(F.lower(text)),
        lambda lowered: F.when(
            F.contains(lowered, F.lit("http")) | F.contains(lowered, F.lit("www")),
            F.regexp_replace(lowered, URL, ""),
        ).otherwise(lowered),
    )[0]


def _strip_noise(text: Column) -> Column:
    return F.regexp_replace(_without_urls(text), PUNCTUATION, "")


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def clean_review_text(text: Column) -> Column:
    """Lower case, without URLs and punctuation, single spaces."""
    return _squeeze(_strip_noise(text))


def tokens(cleaned: Column) -> Column:
    """Words of a text that has no white space but blanks; none for an empty text."""
    return F.filter(F.split(cleaned, " "), lambda token: token != "")


def split_contractions(
    words: Column, contractions: Mapping[str, tuple[str, ...]] = fixed.CONTRACTIONS
) -> Column:
    """Replace run-together contractions by their two words."""

    def pieces(word: Column) -> Column:
        parts = F.array(word)
        for whole, halves in contractions.items():
            parts = F.when(word == whole, F.array(*map(F.lit, halves))).otherwise(parts)
        return parts

    # The one-element array binds the words once; most texts have nothing to split.
    return F.transform(
        F.array(words),
        lambda given: F.when(
            F.exists(given, lambda word: word.isin(list(contractions))),
            F.flatten(F.transform(given, pieces)),
        ).otherwise(given),
    )[0]


def keep_words(words: Column, stop_words: Iterable[str]) -> Column:
    """Words that are not stop words, repeats kept."""
    stop = list(stop_words)
    return F.filter(words, lambda word: ~word.isin(stop)) if stop else words


def content_tokens(text: Column, stop_words: Iterable[str]) -> Column:
    """Words left after removing URLs, punctuation, digits and stop words."""
    # Neither class holds a-z or the blank; looking for these first spares most characters the classes.
    letters = F.regexp_replace(_without_urls(text), f"(?![a-z ])[{PUNCTUATION}{DIGIT}]+", "")
    spaced = F.regexp_replace(letters, f"(?![a-z ]){SPACE}", " ")
    return keep_words(split_contractions(tokens(spaced)), stop_words)


def clean_text(text: Column, stop_words: Iterable[str]) -> Column:
    """The content words joined by a space."""
    return F.array_join(content_tokens(text, stop_words), " ")


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for an empty text, null for null."""
    return F.regexp_count(text, F.lit(f"{NON_SPACE}+"))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether any part occurs in the text, inside words too, in any case."""
    lowered = F.lower(text)
    return reduce(
        lambda found, part: found | F.contains(lowered, F.lit(part.lower())),
        parts,
        F.lit(False),
    )


def long_words(words: Column) -> Column:
    """Words of two or more characters."""
    return F.filter(words, lambda word: F.length(word) >= 2)


def word_pairs(words: Column, among: Iterable[str] | None = None) -> Column:
    """Neighbouring words joined by a space, or only the pairs made of the given words."""
    if among is not None:
        chosen = list(among)
        words = F.transform(words, lambda word: F.when(word.isin(chosen), word))

    def neighbours(given: Column) -> Column:
        n = F.greatest(F.size(given) - 1, F.lit(0))
        both = F.zip_with(
            F.slice(given, 1, n), F.slice(given, 2, n), lambda a, b: F.concat(a, F.lit(" "), b)
        )
        return F.filter(both, lambda pair: pair.isNotNull())

    # The one-element array binds the words once for both halves of the pairs.
    return F.transform(F.array(words), neighbours)[0]


def parse_review_time(text: Column, formats: Iterable[str] = fixed.REVIEW_DATE_FORMATS) -> Column:
    """Timestamp by the first format that fits, else by Spark's own parsing, else null."""
    tries = [F.try_to_timestamp(text, F.lit(pattern)) for pattern in formats]
    return F.coalesce(*tries, F.try_to_timestamp(text))
