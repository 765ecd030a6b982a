import pytest
from pyspark.sql import functions as F

from critiq.operators import reviews as R
from critiq.operators.sentiment import with_sentiment

LEXICON = {"up": 1.0, "fine": 0.8, "warm": 0.7, "half": 0.5, "meh": 0.0, "down": -1.0, "cold": -0.7}


def analysed(spark, texts, **options):
    rows = [(i, text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, review_text string")
    return R.analyze_reviews(df, lexicon=LEXICON, **options)


def test_sentiment_scores(spark):
    row = analysed(spark, ["up down up plain"]).first()["sentiment_analysis"]
    assert row["textblob_sentiment"] == pytest.approx(1 / 3)
    shares = row["vader_scores"]
    assert (shares["neg"], shares["neu"], shares["pos"]) == (0.25, 0.25, 0.5)
    assert shares["compound"] == pytest.approx(1 / 4)
    assert row["transformer_sentiment"] is None


@pytest.mark.parametrize(
    "text, polarity, anomaly",
    [
        ("fine", 0.8, True),  # not extreme, but above the intensity limit
        ("warm", 0.7, False),  # limits are strict
        ("cold", -0.7, False),
        ("up", 1.0, True),
        ("down", -1.0, True),
        ("not the best", 0.0, True),  # sarcastic and exaggerated
        ("not that", 0.0, False),
        ("meh", 0.0, False),
        ("", 0.0, False),
        (None, 0.0, False),
    ],
)
def test_anomaly(spark, text, polarity, anomaly):
    row = analysed(spark, [text]).first()
    assert row["sentiment_analysis"]["textblob_sentiment"] == polarity
    assert row["is_anomaly"] is anomaly
    assert row["review_text"] == text and row["id"] == 0


def test_opposite_scores_cancel_exactly(spark):
    df = spark.createDataFrame([("a b c",)], "cleaned_text string")
    row = with_sentiment(df, lexicon={"a": 0.1, "b": 0.2, "c": -0.3}).first()
    assert row["sentiment"]["polarity"] == 0.0


def test_large_lexicon_is_joined_with_the_same_result(spark):
    texts = ["up down up plain", "", None, "half warm", "nothing here"]
    filler = [(f"filler{i}", 0.1) for i in range(2000)]
    table = spark.createDataFrame(list(LEXICON.items()) + filler, "word string, score double")
    small = {r["id"]: r["sentiment_analysis"] for r in analysed(spark, texts).collect()}
    rows = [(i, text) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, review_text string")
    for key in (["id"], []):  # rows need no key
        joined = R.analyze_reviews(df, lexicon=table, key=key).collect()
        assert {r["id"]: r["sentiment_analysis"] for r in joined} == small


def test_report(spark):
    row = R.review_report(analysed(spark, ["up", "warm", "cold", "i tried"])).first()
    assert row["total_reviews"] == 4 and row["anomaly_count"] == 1 and row["anomaly_pct"] == 25.0
    assert (row["positive"], row["negative"], row["neutral"]) == (2, 1, 1)
    assert (row["emotional"], row["personal"], row["sarcastic"]) == (1, 1, 0)


def test_report_of_nothing(spark):
    row = R.review_report(analysed(spark, ["x"]).filter("id < 0")).first()
    assert row["total_reviews"] == 0 and row["anomaly_pct"] is None


def test_charts(spark):
    rows = analysed(spark, ["up but", "cold but", "half not i", "plain"])
    kinds = {(r["type"], r["sentiment"]): r["n"] for r in R.type_sentiment_counts(rows).collect()}
    assert kinds == {
        ("Emotional", "Positive"): 1,
        ("Sarcastic", "Positive"): 2,
        ("Sarcastic", "Negative"): 1,
        ("Personal", "Positive"): 1,
    }
    flow = {(r["source"], r["target"]): r["n"] for r in R.emotion_flow(rows).collect()}
    assert len(flow) == 8
    assert flow[("Positive", "High")] == 2  # the first review flows twice
    assert flow[("Positive", "Low")] == 1  # exactly one half is low
    assert flow[("Negative", "High")] == 1 and flow[("Emotional", "Negative")] == 0
    pairs = {(r["type_a"], r["type_b"]): r["weight"] for r in R.type_cooccurrence(rows).collect()}
    assert pairs == {("Emotional", "Sarcastic"): 1, ("Sarcastic", "Personal"): 1}


def test_term_counts(spark):
    rows = R.type_term_counts(analysed(spark, ["but aa aa bb", "not bb aa"]), k=2)
    found = {(r["type"], r["token"], r["n"], r["rank"]) for r in rows.collect()}
    assert found == {("Sarcastic", "aa", 3, 1), ("Sarcastic", "bb", 2, 2)}


def test_timeline_and_features(spark):
    rows = analysed(spark, ["up but i", "not i", "i", "good", "best"])
    types = [r["type"] for r in R.review_timeline(rows).collect()]
    assert types == ["Emotional", "Sarcastic", "Personal", "Recommendation", "Other"]
    assert R.review_timeline(rows).filter("timestamp IS NULL").count() == 0
    scored = rows.withColumn("p", F.lit(0.25)).drop("sentiment_analysis", "speech_analysis", "is_anomaly")
    again = R.analyze_reviews(scored, lexicon=LEXICON, transformer_score="p")
    assert R.review_features(again).first()["features"] == [1.0, 0.25, 1.0, 1.0, 0.0, 1.0, 0.0]
