"""Values at the edges: nulls, repeated keys, NaN, infinity, limits over several files."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from critiq.operators import cleaning, content, evaluation, ordered, split, tables
from critiq.operators.sentiment import with_word_sentiment
from critiq.sources import csv_reviews, jsonl, profile

INF, NAN = float("inf"), float("nan")


def numbers(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def test_histogram_leaves_out_what_has_no_place(spark):
    found = tables.histogram(numbers(spark, [1.0, 2.0, 3.0, NAN, INF, -INF, None]), "v", bins=2)
    assert sorted((r["bin"], r["n"]) for r in found.collect()) == [(0, 1), (1, 2)]


def test_box_without_nan_and_with_infinity(spark):
    row = tables.box_statistics(numbers(spark, [1.0, 2.0, 3.0, 4.0, 5.0, None]), "v").first()
    assert (row["q1"], row["median"], row["q3"], row["n_outliers"]) == (2.0, 3.0, 4.0, 0)
    row = tables.box_statistics(numbers(spark, [1.0, 2.0, 3.0, 4.0, 5.0, NAN]), "v").first()
    assert (row["q1"], row["median"], row["q3"]) == (2.0, 3.0, 4.0)
    counts = ordered.value_counts(numbers(spark, [1.0, INF, -INF, 1.0, NAN, None]), "v").collect()
    assert sorted((r["v"], r["n"], r["cum_n"]) for r in counts) == [(-INF, 1, 1), (1.0, 2, 3), (INF, 1, 4)]


def test_auc_with_missing_and_infinite_scores(spark):
    rows = [(1, INF), (1, 0.4), (0, 0.4), (0, -INF), (1, None), (0, NAN), (None, 0.9)]
    scored = spark.createDataFrame(rows, "y_true int, y_score double")
    assert evaluation.roc_auc(scored).first()[0] == pytest.approx(3.5 / 4)


def test_confusion_matrix_counts_missing_labels(spark):
    rows = [(1, 1), (None, 1), (1, None)]
    found = evaluation.confusion_matrix(spark.createDataFrame(rows, "y_true int, y_pred int")).collect()
    assert {(r["y_true"], r["y_pred"]): r["n"] for r in found} == {(1, 1): 1, (None, 1): 1, (1, None): 1, (None, None): 0}
    empty = evaluation.confusion_matrix(spark.createDataFrame([], "y_true int, y_pred int"))
    assert empty.count() == 0


def test_split_of_keys_in_parts(spark):
    rows = [("a:b", "c"), ("a", "b:c"), ("a", None), (None, "a")]
    df = spark.createDataFrame(rows, "x string, y string")
    for size in range(1, 4):
        assert split.train_test_split_exact(df, ["x", "y"], size).where("split = 'test'").count() == size


@pytest.mark.parametrize("size", [300, 1000, 5000])
def test_lexicon_of_any_size(spark, size):
    lexicon = {f"w{i}": (i - size // 2) / 10_000 for i in range(size)}
    words = [["w0", "w1", "other", f"w{size - 1}"], [], ["other"], ["w0"] * 3]
    df = spark.createDataFrame([(i % 2, w) for i, w in enumerate(words)], "id int, words array<string>")
    repeated = [*lexicon.items(), ("w0", -1.0), ("w1", None), (None, 0.5)]
    table = spark.createDataFrame(repeated, "word string, score double")
    plain = [r["sentiment"] for r in with_word_sentiment(df, "words", lexicon).collect()]
    for bound in (0, 10_000):
        found = with_word_sentiment(df, "words", table, literal_entries=bound)
        assert sorted(map(str, (r["sentiment"] for r in found.collect()))) == sorted(map(str, plain))


def test_scores_finer_than_four_decimals_are_an_error(spark):
    df = spark.createDataFrame([(["a"],)], "words array<string>")
    with pytest.raises(ValueError):
        with_word_sentiment(df, "words", {"a": 0.00004})
    table = spark.createDataFrame([("a", 0.00004)], "word string, score double")
    with pytest.raises(PySparkException):
        with_word_sentiment(df, "words", table, literal_entries=0).collect()


def test_lemmas_on_both_paths(spark):
    rows = [(None, "running dogs"), (1, "running cats"), (1, "other words"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "id int, text string")
    lemmas = [("running", "run"), ("running", "ran"), ("dogs", None), ("cats", "cat"), (None, "x")]
    table = spark.createDataFrame(lemmas, "token string, lemma string")
    found = [
        sorted(map(tuple, cleaning.clean_texts(docs, ["id"], lemmas=table, literal_entries=n).collect()), key=str)
        for n in (0, 100)
    ]
    assert found[0] == found[1]
    assert (None, "run dogs") in found[0] and (1, "run cat") in found[0]


def test_word_lists_on_both_paths(spark):
    rows = [(None, "a Bad thing"), (1, "bad and worse"), (1, "fine"), (2, None), (None, "fine")]
    docs = spark.createDataFrame(rows, "id int, text string")
    entries = [("l", "bad", 4, 0), ("l", "worse", 5, 1), ("m", "thing", 1, 0)]
    words = spark.createDataFrame(entries, "list_name string, word string, severity int, position int")
    for make in (content.content_matches, content.content_check, content.with_content_checks):
        sides = []
        for bound in (0, 100):
            rows = make(docs, words, ["id"], literal_entries=bound).collect()
            sides.append(sorted(str(sorted(r.asDict(recursive=True).items(), key=str)) for r in rows))
        assert sides[0] == sides[1]


def lines_in_files(spark, folder, sizes):
    start = 0
    for number, size in enumerate(sizes):
        text = "\n".join(str(i) for i in range(start, start + size))
        (folder / f"part-{number}.txt").write_text(text + "\n" if size else "")
        start += size


def test_first_lines_over_files_of_different_sizes(spark, tmp_path):
    lines_in_files(spark, tmp_path, [3, 40, 0, 1, 200])
    for limit in (1, 3, 4, 43, 44, 100, 244, 900):
        found = {int(r["value"]) for r in profile.read_lines(spark, str(tmp_path), limit).collect()}
        assert found == set(range(min(limit, 244)))
    assert profile.read_lines(spark, str(tmp_path), None).count() == 244


def test_first_rows_of_csv(spark, tmp_path):
    for number, (start, stop) in enumerate([(0, 2), (2, 30), (30, 31)]):
        rows = "".join(f'"t{i}","line one\nline two"\n' for i in range(start, stop))
        (tmp_path / f"part-{number}.csv").write_text("Title,description\n" + rows)
    for limit in (1, 2, 7, 31):
        found = csv_reviews.load_reviews(spark, str(tmp_path), limit=limit).collect()
        assert sorted((r["asin"], r["title"]) for r in found) == sorted((f"book_{i}", f"t{i}") for i in range(limit))
    assert csv_reviews.load_reviews(spark, str(tmp_path)).count() == 31


def test_json_as_the_writer_of_the_files_means_it(spark, tmp_path):
    lines = [
        '{"asin": "a", "asin": "b", "overall": 3.0, "reviewText": "x, NaN, y"}',
        '{"asin": "c", "overall": NaN}',
        '{"asin": "d", "overall": -Infinity, "reviewText": "z"}',
        '{"asin": "e", "overall": }',
    ]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    scan = jsonl.read_reviews(spark, str(tmp_path / "r.jsonl"))
    found = {r["asin"]: r for r in scan.rows.collect()}
    assert set(found) == {"b", "c", "d"} and scan.rejects.count() == 1
    assert math.isnan(found["c"]["overall"]) and found["d"]["overall"] == -INF
    assert found["b"]["reviewText"] == "x, NaN, y"
    assert scan.rows.where(F.col("overall") == 3.0).count() == 1
