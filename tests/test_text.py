import pytest
from pyspark.sql import functions as F

from critiq.functions import speech as S
from critiq.functions import text as T
from critiq.operators.cleaning import clean_texts


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("See http://a.b/c now", "see now"),
        ("Café élan!", "café élan"),
        ("a  b\n\tc", "a b c"),
        ("a b　c", "a b c"),
        ("visitwww.x.y today", "visit today"),
        ("snake_case 3d ½", "snake_case 3d ½"),
        ("", ""),
        ("!!!", ""),
        (None, None),
    ],
)
def test_clean_review_text(spark, text, expected):
    assert one(spark, T.clean_review_text, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The 3d film, cannot stop", "d film can not stop"),
        ("I wanna GO", "i wan na go"),
        ("the the", ""),
        ("", ""),
    ],
)
def test_clean_text(spark, text, expected):
    assert one(spark, lambda c: T.clean_text(c, ["the"]), text) == expected


@pytest.mark.parametrize("text, n", [("", 0), ("  ", 0), ("a b", 2), (" a\n b ", 2), (None, None)])
def test_word_count(spark, text, n):
    assert one(spark, T.word_count, text) == n


def test_word_pairs(spark):
    words = lambda c: F.split(c, " ")
    assert one(spark, lambda c: T.word_pairs(words(c)), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: T.word_pairs(words(c), ["b", "c"]), "a b c") == ["b c"]
    assert one(spark, lambda c: T.word_pairs(words(c)), "a") == []


@pytest.mark.parametrize("text", ["09 13, 2009", "2009-09-13", "2009-09-13 00:00:00"])
def test_review_time(spark, text):
    assert str(one(spark, T.parse_review_time, text)) == "2009-09-13 00:00:00"


def test_review_time_short_day_and_unreadable(spark):
    assert str(one(spark, T.parse_review_time, "10 1, 2010")) == "2010-10-01 00:00:00"
    assert one(spark, T.parse_review_time, "soon") is None


SPEECH = [
    (S.is_sarcastic, "Nothing", True),
    (S.is_sarcastic, "a button", True),
    (S.is_sarcastic, "plain", False),
    (S.is_exaggerated, "Wow!!", True),
    (S.is_exaggerated, "Wow!", False),
    (S.is_exaggerated, "Very", False),
    (S.is_exaggerated, "very good", True),
    (S.is_exaggerated, "VERY\n good", True),
    (S.is_exaggerated, "the bestest", False),
    (S.is_exaggerated, "simply the best", True),
    (S.is_personal, "we liked it", True),
    (S.is_personal, "weird", False),
    (S.is_recommendation, "goodness", False),
    (S.is_recommendation, "a good book", True),
    (S.is_recommendation, "worth-while", True),
    (S.is_recommendation, None, False),
]


@pytest.mark.parametrize("flag, text, expected", SPEECH)
def test_speech_flags_of_raw_text(spark, flag, text, expected):
    assert one(spark, flag, text) is expected


def test_word_membership_equals_patterns_on_cleaned_text(spark):
    texts = [text for _, text, _ in SPEECH if text] + [
        "I used it, though it is very", "not bad at all", "Éverything must go", "us", "(us)", "",
    ]
    cleaned = T.clean_review_text(F.col("text"))
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(cleaned.alias("c"))
    by_word = S.speech_flags(F.col("c"), T.tokens(F.col("c")))
    by_pattern = {
        "is_sarcastic": S.is_sarcastic(F.col("c")),
        "is_exaggerated": S.is_exaggerated(F.col("c")),
        "is_personal": S.is_personal(F.col("c")),
        "is_recommendation": S.is_recommendation(F.col("c")),
    }
    same = [by_word[name] == by_pattern[name] for name in by_word]
    assert all(all(row) for row in df.select(*same).collect())
    phrases = S.SpeechVocabulary(personal=("in my opinion",))
    flags = S.speech_flags(F.col("c"), T.tokens(F.col("c")), phrases)
    mine = spark.createDataFrame([("well in my opinion yes",)], "c string")
    assert mine.select(flags["is_personal"]).first()[0] is True


def test_lemmas_written_into_the_plan_or_joined(spark):
    docs = spark.createDataFrame(
        [(1, "Foxes ate the hens, foxes!"), (2, ""), (3, None), (4, "hens")], "id long, text string"
    )
    lemmas = spark.createDataFrame([("foxes", "fox"), ("hens", "hen")], "token string, lemma string")
    for entries in (1000, 0):
        found = clean_texts(docs, ["id"], stop_words=["the"], lemmas=lemmas, literal_entries=entries)
        assert dict(map(tuple, found.collect())) == {1: "fox ate hen fox", 2: "", 3: None, 4: "hen"}
    assert clean_texts(docs, ["id"], lemmas=lemmas.limit(0)).count() == 4
