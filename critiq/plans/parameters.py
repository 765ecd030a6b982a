"""Vocabulary for the registered queries.

The given documents are invented prose, so the queries look for words that
occur in them; the built-in vocabulary is the default everywhere else.
"""

from critiq import fixed_values as fixed
from critiq.functions.speech import SpeechVocabulary

LEXICON = {
    "best": 1.0, "free": 0.8, "great": 0.8, "the": 0.3, "and": 0.1, "of": -0.3,
    "with": -0.6, "hate": -0.9, "worthless": -1.0, "stupid": -1.0, "idiot": -0.9,
    "trash": -0.9, "scum": -0.9, "la": 0.9, "et": 0.85, "des": 0.7, "und": -0.8,
    "die": -0.7, "der": -0.85, "el": 0.5, "los": -0.5, "que": 0.25,
}

VOCABULARY = SpeechVocabulary(
    sarcasm=("hate", "license", "stupid", "but"),
    intensifiers=("than", "from", "nicht", "pour"),
    exaggeration=("best", "free", "all", "trash", "never"),
    personal=("this", "we", "i", "las", "ein"),
    recommendation=("worth", "great", "idiot", "by", "que"),
)

STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "on", "for", "as",
    "with", "was", "be", "by", "are", "this", "at", "from", "la", "de", "les",
    "le", "des", "et", "und", "die", "der",
)

INSULTS = ("idiot", "scum", "stupid", "trash", "worthless")

MAX_SEVERITY = fixed.MAX_SEVERITY
RECONSTRUCTION_CUT = 0.9
TEST_ROWS = 200
FIRST_ROWS = 130
