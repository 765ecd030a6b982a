"""Speech patterns of a review."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from critiq import fixed_values as fixed
from critiq.functions import text as T


@dataclass(frozen=True)
class SpeechVocabulary:
    """The words each speech pattern looks for."""

    sarcasm: tuple[str, ...] = fixed.SARCASM_MARKERS
    intensifiers: tuple[str, ...] = fixed.INTENSIFIERS
    exaggeration: tuple[str, ...] = fixed.SUPERLATIVES + fixed.ABSOLUTES
    personal: tuple[str, ...] = fixed.FIRST_PERSON + fixed.EXPERIENCE_VERBS
    recommendation: tuple[str, ...] = fixed.ADVICE_WORDS + fixed.PRAISE_WORDS


DEFAULT_VOCABULARY = SpeechVocabulary()


def exaggeration_pattern(vocabulary: SpeechVocabulary) -> str:
    """One pattern for: intensifier and word, strong word, repeated exclamation mark."""
    return "|".join(
        (
            T.word_then_word(vocabulary.intensifiers),
            T.whole_words(vocabulary.exaggeration),
            "!{2,}",
        )
    )


def _found(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(F.lower(text), F.lit(pattern)), F.lit(False))


def is_sarcastic(text: Column, vocabulary: SpeechVocabulary = DEFAULT_VOCABULARY) -> Column:
    return F.coalesce(T.contains_any(text, vocabulary.sarcasm), F.lit(False))


def is_exaggerated(text: Column, vocabulary: SpeechVocabulary = DEFAULT_VOCABULARY) -> Column:
    return _found(text, exaggeration_pattern(vocabulary))


def is_personal(text: Column, vocabulary: SpeechVocabulary = DEFAULT_VOCABULARY) -> Column:
    return _found(text, T.whole_words(vocabulary.personal))


def is_recommendation(text: Column, vocabulary: SpeechVocabulary = DEFAULT_VOCABULARY) -> Column:
    return _found(text, T.whole_words(vocabulary.recommendation))


def _has_any(words: Column, wanted: tuple[str, ...]) -> Column:
    known = F.array(*[F.lit(word.lower()) for word in wanted]).cast("array<string>")
    return F.coalesce(F.arrays_overlap(words, known), F.lit(False))


def speech_flags(
    cleaned: Column, words: Column, vocabulary: SpeechVocabulary = DEFAULT_VOCABULARY
) -> dict[str, Column]:
    """The four flags of a cleaned text, given its words too.

    A cleaned text is words and single spaces, so a whole-word pattern on it is
    membership of a word, which is much cheaper than searching for the pattern.
    A vocabulary with anything but plain words is searched for all the same.
    """
    by_word = vocabulary.intensifiers + vocabulary.exaggeration
    by_word += vocabulary.personal + vocabulary.recommendation
    if not all(re.fullmatch(r"\w+", word) for word in by_word):
        return {
            "is_sarcastic": is_sarcastic(cleaned, vocabulary),
            "is_exaggerated": is_exaggerated(cleaned, vocabulary),
            "is_personal": is_personal(cleaned, vocabulary),
            "is_recommendation": is_recommendation(cleaned, vocabulary),
        }
    before_last = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return {
        "is_sarcastic": is_sarcastic(cleaned, vocabulary),
        "is_exaggerated": _has_any(words, vocabulary.exaggeration)
        | _has_any(before_last, vocabulary.intensifiers),
        "is_personal": _has_any(words, vocabulary.personal),
        "is_recommendation": _has_any(words, vocabulary.recommendation),
    }


def is_emotional(intensity: Column) -> Column:
    return intensity > fixed.HIGH_INTENSITY


def is_anomaly(polarity: Column, speech: Column) -> Column:
    """Extreme sentiment, sarcasm together with exaggeration, or strong emotion."""
    return (
        (F.abs(polarity) > fixed.EXTREME_POLARITY)
        | (speech["is_sarcastic"] & speech["is_exaggerated"])
        | (speech["emotional_intensity"] > fixed.HIGH_INTENSITY)
    )
