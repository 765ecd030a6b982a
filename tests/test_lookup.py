"""Long vocabularies against short ones, in one block and in several."""

import random

import pytest
from pyspark.sql import functions as F

from critiq.operators import cleaning, content, lookup, sentiment

WORDS = "stone river, The stones don't cost 5 rivers é été http://x.y free FREE".split()


@pytest.fixture(params=[None, 100, 1])
def block_bytes(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(lookup, "BLOCK_BYTES", request.param)


@pytest.fixture
def docs(spark):
    chance = random.Random(4)
    texts = [" ".join(chance.choice(WORDS) for _ in range(chance.randint(0, 30))) for _ in range(40)]
    return spark.createDataFrame(list(enumerate([*texts, "", None, "x " * 5000])), "id long, text string").repartition(3)


def entries(spark, rows):
    return spark.createDataFrame(rows, content.WORD_LIST_SCHEMA)


LISTS = [
    ("b", "free", "c", 3, 1), ("b", "STONE", "c", None, 0), ("a", "ton", "c", 2, 7), ("a", None, "c", 9, 0), (None, "river", "c", 4, 0),
    ("a", "river", "c", 4, 7), ("a", "é", None, 1, 2), ("c", "absent", "c", 5, 0), ("a", "x", "c", 1, None), ("d", "", "c", 1, 0), ("a", "ton", "c", 2, 7),
]


@pytest.mark.parametrize("rows", [LISTS, LISTS[:1], LISTS[3:5], []])
def test_word_lists_of_any_length_match_alike(spark, docs, block_bytes, rows):
    words = entries(spark, rows)
    for operator in (content.content_matches, content.content_check, content.severity_summary, content.content_appropriate):
        short, long = (sorted(map(str, operator(docs, words, ["id"], literal_entries=n).collect())) for n in (1000, 0))
        assert short == long
    short, long = (content.with_content_checks(docs, words, ["id"], literal_entries=n).collect() for n in (1000, 0))
    assert sorted(map(str, short)) == sorted(map(str, long))


def test_no_word_list_finds_nothing(spark, docs):
    words = entries(spark, [])
    for n in (1000, 0):
        assert content.content_matches(docs, words, ["id"], literal_entries=n).count() == 0
        assert content.content_check(docs, words, ["id"], literal_entries=n).count() == 0
        checked = content.with_content_checks(docs, words, ["id"], literal_entries=n).collect()
        assert len(checked) == 43 and all(r["is_appropriate"] and r["matches"] == {} and r["severity_summary"] == {} for r in checked)


def test_missing_words_and_severities(spark):
    texts = spark.createDataFrame([(1, "a stone"), (2, None)], "id long, text string")
    words = entries(spark, [("l", "stone", "c", None, 0), ("l", None, "c", 9, 1)])
    for n in (1000, 0):
        assert [tuple(r) for r in content.content_check(texts, words, ["id"], literal_entries=n).collect()] == [(1, "l", 1, 0)]
        verdicts = content.content_appropriate(texts, words, ["id"], literal_entries=n).collect()
        assert sorted((r["id"], r["is_appropriate"]) for r in verdicts) == [(1, True), (2, True)]


def test_lemmas_of_any_number(spark, docs, block_bytes):
    pairs = [("stones", "stone"), ("stone", "rock"), ("rivers", "river"), ("été", "é"), ("absent", "x"), ("cost", None), ("rivers", "aaa")]
    lemmas = spark.createDataFrame(pairs, "token string, lemma string")
    found = [sorted(map(str, cleaning.clean_texts(docs, ["id"], lemmas=lemmas, literal_entries=n).collect())) for n in (1000, 0)]
    assert found[0] == found[1]
    assert cleaning.clean_texts(docs, ["id"], lemmas=lemmas.limit(0), literal_entries=0).count() == 43


def test_lexicons_of_any_size(spark, docs, block_bytes):
    scores = [("stone", 0.5), ("river", -0.25), ("free", 0.0), ("the", 0.125), ("absent", 1.0), (None, 1.0), ("x", 0.0001), ("stone", 0.25)]
    lexicon = spark.createDataFrame(scores, "word string, score double")
    cleaned = docs.select("id", F.regexp_replace(F.lower("text"), "[^a-zé ]", "").alias("cleaned_text"))
    found = [
        sorted(map(str, sentiment.with_sentiment(cleaned, lexicon=lexicon, literal_entries=n).collect())) for n in (1000, 0)
    ]
    assert found[0] == found[1]
    nothing = sentiment.with_sentiment(cleaned, lexicon=lexicon.limit(0), literal_entries=0).collect()
    assert {r["sentiment"]["polarity"] for r in nothing} == {0.0}
    finer = spark.createDataFrame([("stone", 0.00001)], "word string, score double")
    with pytest.raises(Exception, match="four decimals"):
        sentiment.with_sentiment(cleaned, lexicon=finer, literal_entries=0).collect()


def test_no_text_is_shuffled(spark, docs):
    plan = content.content_check(docs, entries(spark, LISTS), ["id"], literal_entries=0)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("Exchange") == 1  # the test's own repartition
