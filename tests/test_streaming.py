from pyspark.sql import functions as F

from critiq.operators.behavior import behavioral_features_windowed
from critiq.operators.reviews import analyze_reviews
from critiq.streaming import reviews as streams


def test_scored_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "best but bad"), (2, "fine")], "id long, review_text string")
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows.coalesce(1).write.parquet(folder)
    for ids in ((1, 2), (3, 4)):
        stream = streams.read_review_stream(spark, folder, rows.schema)
        streams.write_available(streams.score_stream(stream), out, state).awaitTermination()
        found = spark.read.parquet(out)
        batch = analyze_reviews(spark.read.parquet(folder))
        assert sorted(r["id"] for r in found.collect()) == list(range(1, ids[-1] + 1))
        assert found.select("id", "is_anomaly").exceptAll(batch.select("id", "is_anomaly")).count() == 0
        rows.withColumn("id", F.col("id") + 2).coalesce(1).write.mode("append").parquet(folder)
        if ids[-1] == 4:
            break


def test_windowed_stream(spark, tmp_path):
    events = spark.sql(
        """SELECT * FROM VALUES (1, timestamp'2024-01-01 05:00', 1.0, 'a'), (1, timestamp'2024-01-01 06:00', 3.0, 'abc'),
           (2, timestamp'2024-01-02 00:00', 2.0, 'x'), (9, timestamp'2024-01-09 00:00', 2.0, 'x')
           AS t(user_id, timestamp, rating, text)"""
    )
    folder = str(tmp_path / "in")
    events.coalesce(1).write.parquet(folder)
    stream = streams.windowed_behavior_stream(streams.read_review_stream(spark, folder, events.schema))
    streams.write_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    closed = spark.read.parquet(str(tmp_path / "out"))
    batch = behavioral_features_windowed(events).filter("user_id < 9")  # the last day is still open
    assert closed.count() == 2 and closed.exceptAll(batch).count() == 0
