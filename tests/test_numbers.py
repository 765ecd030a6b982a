"""Ordered work, tables, distributions, features and evaluation against brute force."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from critiq.operators import behavior, distribution, evaluation, features, models, split, tables
from critiq.operators.ordered import row_positions, running_totals, value_counts


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_groups_with_a_hot_group(spark, descending):
    rng = random.Random(1)
    rows = [(0, float(v), rng.randint(1, 9)) for v in rng.sample(range(10_000), 900)]
    rows += [(g, float(v), 1) for g in (1, 2) for v in rng.sample(range(10_000), 30)]
    df = spark.createDataFrame(rows, "g int, v double, n long")
    found = running_totals(df, "v", ["n"], ["g"], ["v"], descending, ranges=16).collect()
    assert len(found) == len(rows)
    for g in (0, 1, 2):
        mine = sorted((r for r in found if r["g"] == g), key=lambda r: r["v"], reverse=descending)
        total = 0
        for row, after in zip(mine, [*mine[1:], None]):
            total += row["n"]
            assert row["cum_n"] == total
            assert row["next_v"] == (after["v"] if after else None)
        assert {r["all_n"] for r in mine} == {total}


def test_row_positions(spark):
    keys = random.Random(2).sample(range(100_000), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    placed = {r["k"]: r["position"] for r in row_positions(df, "k").collect()}
    assert placed == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize(
    "values", [[3.0], [1.0, 2.0], [5.0] * 300 + list(range(100)), [0.0, 0.0, 1.0, 1e9, None]]
)
def test_box(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "rating double")
    row = tables.box_statistics(df)
    row = row.first()
    known = np.array([v for v in values if v is not None], float)
    q1, median, q3 = np.percentile(known, [25, 50, 75])
    assert (row["q1"], row["median"], row["q3"]) == pytest.approx((q1, median, q3))
    inside = known[(known >= q1 - 1.5 * (q3 - q1)) & (known <= q3 + 1.5 * (q3 - q1))]
    assert (row["lower_whisker"], row["upper_whisker"]) == (inside.min(), inside.max())
    assert row["n_outliers"] == len(known) - len(inside)


def test_value_counts_of_hot_value(spark):
    df = spark.createDataFrame([(7.0,)] * 50 + [(1.0,)], "v double")
    rows = {r["v"]: (r["n"], r["cum_n"], r["all_n"]) for r in value_counts(df, "v").collect()}
    assert rows == {1.0: (1, 1, 51), 7.0: (50, 51, 51)}


@pytest.mark.parametrize("bins", [3, 20, 50])
def test_histogram_equals_numpy(spark, bins):
    values = [i / 10 for i in range(101)] + [0.3] * 50 + list(np.random.default_rng(0).random(500))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    counts = dict(map(tuple, tables.histogram(df, "v", bins).collect()))
    expected, _ = np.histogram(values, bins=bins)
    assert [counts.get(i, 0) for i in range(bins)] == expected.tolist()


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert list(map(tuple, tables.histogram(df, "v").collect())) == [(0, 3)]


def test_rating_tables(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 3), ("a", 2.0, 4), ("b", 5.0, 5), (None, 4.0, 0)],
        "category string, rating double, review_length int",
    )
    row = tables.rating_summary(df).first()
    assert (row["total_reviews"], row["total_categories"], row["average_review_length"]) == (4, 3, 3.0)
    assert row["rating_std"] == pytest.approx(np.std([1, 2, 5, 4], ddof=1))
    assert list(map(tuple, tables.category_ratings(df).collect())) == [("b", 5.0), ("a", 1.5)]
    assert list(map(tuple, tables.top_categories(df, k=1).collect())) == [("b", 5.0)]


def test_behavior(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [
        (1, at(3), 1.0, "abc"), (1, at(1), 3.0, "a"), (1, at(1, 12), 5.0, None), (1, None, 7.0, "ab"),
        (2, at(5), 2.0, "x"), (None, at(9), 9.0, "x"), (3, None, 1.0, ""),
    ]
    df = spark.createDataFrame(rows, "user_id long, timestamp timestamp, rating double, text string")
    found = {r["user_id"]: r for r in behavior.behavioral_features(df).collect()}
    assert set(found) == {1, 2, 3}
    one, two, three = found[1], found[2], found[3]
    assert one["review_frequency"] == 3 and one["avg_gap_seconds"] == 86400.0
    assert one["global_avg_gap_seconds"] == 86400.0 and one["avg_review_length"] == 2.0
    assert one["rating_std"] == pytest.approx(np.std([1, 3, 5, 7], ddof=1))
    assert two["rating_std"] is None and two["avg_gap_seconds"] is None
    assert three["review_frequency"] == 0 and three["avg_gap_seconds"] is None
    gaps = behavior.review_gaps(df).orderBy("user_id", "timestamp").collect()
    assert [(r["user_id"], r["n_reviews"], r["gap_seconds"]) for r in gaps] == [
        (1, 1, None), (1, 1, 43200.0), (1, 1, 129600.0), (2, 1, None),
    ]
    daily = behavior.behavioral_features_windowed(df).filter("user_id = 1").orderBy("window_start")
    assert [r["review_frequency"] for r in daily.collect()] == [2, 1]


@pytest.mark.parametrize("n, size", [(100, 30), (100, 0), (20, 50), (500, 499)])
def test_split_size_is_exact(spark, n, size):
    df = spark.range(n).withColumnRenamed("id", "k")
    found = split.train_test_split_exact(df, ["k"], size)
    assert found.filter("split = 'test'").count() == min(n, size)
    again = split.train_test_split_exact(df.repartition(7), ["k"], size)
    assert found.exceptAll(again).count() == 0
    other = split.train_test_split_exact(df, ["k"], size, seed=1)
    assert size in (0, 50) or found.exceptAll(other).count() > 0


def test_behavior_and_text_features_together(spark):
    text = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 0.0])], "user_id long, text_features array<double>")
    user = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 5.0)], "user_id long, a double, b double")
    rows = {r["user_id"]: r["features"] for r in features.combine_features(text, user, columns=("a", "b")).collect()}
    assert rows == {1: [-1.0, 0.0, -1.0, None], 2: [1.0, 0.0, 1.0, 0.0]}


# --- Evaluation --------------------------------------------------------------

SCORED = [(1, 1, 0.9), (1, 0, 0.4), (0, 1, 0.8), (0, 0, 0.1), (1, 1, 0.8), (2, 0, 0.3)]


def scored(spark, rows=SCORED):
    return spark.createDataFrame(rows, "y_true int, y_pred int, y_score double")


def test_confusion_and_report(spark):
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in evaluation.confusion_matrix(scored(spark)).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 6 and cells[(1, 1)] == 2 and cells[(2, 2)] == 0
    report = {r["row_label"]: r for r in evaluation.classification_report(scored(spark)).collect()}
    assert report["1"]["precision"] == pytest.approx(2 / 3) and report["1"]["support"] == 3
    assert (report["2"]["precision"], report["2"]["f1"]) == (0.0, 0.0)
    assert report["accuracy"]["f1"] == 0.5 and report["accuracy"]["precision"] is None
    assert report["macro avg"]["recall"] == pytest.approx((2 / 3 + 1 / 2 + 0) / 3)
    weighted = evaluation.weighted_metrics(scored(spark)).first()
    assert weighted["recall"] == pytest.approx(0.5)
    assert report["weighted avg"]["precision"] == pytest.approx(weighted["precision"])
    compared = evaluation.model_comparison({"a": scored(spark)}).collect()
    assert {r["metric"] for r in compared} == {"precision", "recall", "f1-score"}
    counts = dict(map(tuple, evaluation.prediction_distribution(scored(spark)).collect()))
    assert counts == {0: 3, 1: 3}


def test_binary_metrics_without_positives(spark):
    row = evaluation.binary_metrics(scored(spark, [(0, 0, 0.1), (1, 0, 0.2)])).first()
    assert tuple(row) == (0.5, 0.0, 0.0, 0.0)


def brute_auc(rows):
    ones = [s for t, _, s in rows if t == 1]
    others = [s for t, _, s in rows if t != 1]
    wins = sum((a > b) + (a == b) / 2 for a in ones for b in others)
    return wins / (len(ones) * len(others))


def test_roc(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), 0, rng.randint(0, 40) / 40) for _ in range(400)]
    df = scored(spark, rows)
    assert evaluation.roc_auc(df).first()[0] == pytest.approx(brute_auc(rows))
    full = evaluation.roc_curve(df, drop_intermediate=False).orderBy(F.desc("threshold")).collect()
    short = evaluation.roc_curve(df).orderBy(F.desc("threshold")).collect()
    area = lambda pts: sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert area(full) == pytest.approx(brute_auc(rows)) == pytest.approx(area(short))
    assert tuple(full[0]) == (0.0, 0.0, math.inf) and tuple(full[-1])[:2] == (1.0, 1.0)
    assert set(map(tuple, short)) <= set(map(tuple, full))


def test_roc_keeps_first_and_last_and_drops_points_on_a_line(spark):
    df = scored(spark, [(0, 0, 0.9), (0, 0, 0.8), (0, 0, 0.7), (1, 0, 0.6), (1, 0, 0.5)])
    kept = sorted((r["threshold"] for r in evaluation.roc_curve(df).collect()), reverse=True)
    assert kept == [math.inf, 0.9, 0.7, 0.5]


def test_one_class_only(spark):
    assert evaluation.roc_auc(scored(spark, [(1, 1, 0.2), (1, 1, 0.3)])).first()[0] is None


def test_logits_and_loss(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0],)], "logits array<double>")
    first, second = evaluation.logits_to_predictions(df).collect()
    assert first["y_pred"] == 1 and sum(first["probs"]) == pytest.approx(1.0)
    assert first["probs"][0] == pytest.approx(math.exp(-2) / (2 + math.exp(-2)))
    assert second["probs"] == pytest.approx([1.0, 0.0])
    rows = spark.createDataFrame([(1, 1, 0.5), (0, 1, 0.25)], "y_true int, y_pred int, p_true double")
    row = evaluation.scored_loss_accuracy(rows).first()
    assert row["loss"] == pytest.approx((math.log(2) + math.log(4)) / 2) and row["accuracy"] == 0.5


# --- Vectors -----------------------------------------------------------------


def vectors(spark, array, **columns):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(array)]
    return spark.createDataFrame(rows, "id long, vec array<double>")


def brute_wasserstein(a, b):
    points = np.sort(np.concatenate([a, b]))
    cdf = lambda s: np.searchsorted(np.sort(s), points[:-1], side="right") / len(s)
    return float(np.sum(np.abs(cdf(a) - cdf(b)) * np.diff(points)))


def test_wasserstein(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(80, 3)), rng.normal(1, 2, size=(50, 3))
    a[:30, 0] = 0.5  # a hot value
    found = distribution.wasserstein_by_feature(vectors(spark, a), vectors(spark, b)).collect()
    for row in found:
        assert row["distance"] == pytest.approx(brute_wasserstein(a[:, row["pos"]], b[:, row["pos"]]))
    same = distribution.wasserstein_distance(vectors(spark, a), vectors(spark, a)).first()[0]
    assert same == 0.0
    single = distribution.wasserstein_distance(vectors(spark, [[1.0]]), vectors(spark, [[3.5]]))
    assert single.first()[0] == 2.5


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_diversity_with_copies(spark, block_rows):
    rng = np.random.default_rng(5)
    array = np.concatenate([rng.normal(size=(40, 4)), np.ones((20, 4))])  # a third are copies
    gaps = [np.linalg.norm(x - y) for i, x in enumerate(array) for y in array[:i]]
    found = distribution.diversity_score(vectors(spark, array), block_rows=block_rows).first()[0]
    assert found == pytest.approx(np.mean(gaps))
    assert distribution.diversity_score(vectors(spark, [[1.0, 2.0]])).first()[0] is None


def test_feature_statistics_and_histograms(spark):
    array = np.random.default_rng(6).normal(size=(60, 3))
    rows = distribution.feature_statistics(vectors(spark, array)).orderBy("pos").collect()
    assert [r["std"] for r in rows] == pytest.approx(array.std(axis=0, ddof=1).tolist())
    assert [r["min"] for r in rows] == pytest.approx(array.min(axis=0).tolist())
    both = distribution.feature_histograms(vectors(spark, array), vectors(spark, array * 2), features=(0, 2))
    totals = {(r["origin"], r["pos"]): r["t"] for r in both.groupBy("origin", "pos").agg(F.sum("n").alias("t")).collect()}
    assert totals == {(o, p): 60 for o in ("Real", "Generated") for p in (0, 2)}


def test_two_samples(spark):
    real = vectors(spark, [[0.0], [1.0]]).withColumn("score", F.lit(0.75))
    fake = vectors(spark, [[2.0], [4.0]]).withColumn("score", F.when(F.col("id") == 0, 0.9).otherwise(0.5))
    row = distribution.two_sample_evaluation(real, fake).first()
    assert row["wasserstein_distance"] == 2.5 and row["diversity_score"] == 2.0
    assert row["discriminator_precision"] == pytest.approx(2 / 3)  # one half is not above one half
    assert row["discriminator_recall"] == 1.0 and row["discriminator_f1"] == pytest.approx(0.8)
    assert (row["real_mean_score"], row["fake_mean_score"]) == pytest.approx((0.75, 0.7))


def test_reconstruction_limit_is_strict(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5]), ([1.0, 1.0], [0.0, 1.0])], "x array<double>, x_hat array<double>")
    rows = distribution.reconstruction_anomaly(df, threshold=0.25).collect()
    assert [(r["error"], r["is_anomaly"]) for r in rows] == [(0.25, False), (0.5, True)]


def test_scale(spark):
    array = np.random.default_rng(8).normal(3, 5, size=(50, 3))
    array[:, 1] = 0.1  # constant
    rows = features.standard_scale(vectors(spark, array)).orderBy("id").collect()
    found = np.array([r["scaled"] for r in rows])
    dev = array.std(axis=0)
    dev[1] = 1
    assert np.allclose(found, (array - array.mean(axis=0)) / dev, atol=1e-12)


def test_pca_equals_svd(spark):
    array = np.random.default_rng(9).normal(size=(200, 6)) @ np.diag([5, 4, 3, 2, 1, 0.5])
    rows = features.pca_scores(vectors(spark, array), k=3).orderBy("id").collect()
    centred = array - array.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:3]
    axes *= np.sign(axes[np.arange(3), np.abs(axes).argmax(axis=1)])[:, None]
    assert np.allclose([r["scores"] for r in rows], centred @ axes.T, atol=1e-8)
    errors = features.pca_reconstruction_anomaly(vectors(spark, array), k=3).orderBy("id").collect()
    rebuilt = centred @ axes.T @ axes
    assert np.allclose([r["error"] for r in errors], ((centred - rebuilt) ** 2).mean(axis=1), atol=1e-8)


# --- Text features -----------------------------------------------------------

TEXTS = ["red fox red", "red fox", "blue sky blue sky", "", "a red sky"]


def documents(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def brute_tfidf(texts, max_features, min_df):
    lists = []
    for text in texts:
        words = [w for w in text.split() if len(w) >= 2]
        lists.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    terms = {t for ws in lists for t in ws}
    df = {t: sum(t in ws for ws in lists) for t in terms}
    tf = {t: sum(ws.count(t) for ws in lists) for t in terms}
    kept = sorted((t for t in terms if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    scores = {}
    for i, ws in enumerate(lists):
        row = {t: ws.count(t) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in kept if t in ws}
        norm = math.sqrt(sum(x * x for x in row.values()))
        scores.update({(i, t): x / norm for t, x in row.items()})
    return scores


@pytest.mark.parametrize("max_features, min_df", [(1000, 2), (1000, 1), (3, 1), (4, 1), (2, 2)])
def test_tfidf(spark, max_features, min_df):
    rng = random.Random(10)
    texts = TEXTS + [" ".join(rng.choice("aa bb cc dd".split()) for _ in range(8)) for _ in range(10)]
    found = features.tfidf_scores(documents(spark, texts), ["id"], max_features=max_features, min_df=min_df)
    scores = {(r["id"], r["term"]): r["score"] for r in found.collect()}
    assert scores == pytest.approx(brute_tfidf(texts, max_features, min_df))


@pytest.mark.parametrize("limit", ["TIED_WORDS", "LISTED_WORDS"])
def test_pairs_are_whole_where_they_cannot_be_restricted(spark, monkeypatch, limit):
    monkeypatch.setattr(features, limit, 1)
    texts = ["zz yy", "xx ww", "vv uu", "aa bb"]
    found = features.tfidf_scores(documents(spark, texts), ["id"], max_features=3, min_df=1)
    scores = {(r["id"], r["term"]): r["score"] for r in found.collect()}
    assert scores == pytest.approx(brute_tfidf(texts, 3, 1))


def test_keywords_and_scaled_scores(spark):
    best = features.top_keywords(documents(spark), top_n=2).collect()
    scores = brute_tfidf(TEXTS, 1000, 2)
    mean = {t: sum(s for (_, u), s in scores.items() if u == t) / len(TEXTS) for _, t in scores}
    expected = sorted(mean.items(), key=lambda x: (-x[1], x[0]))[:2]
    assert [r["term"] for r in best] == [t for t, _ in expected]
    assert [r["score"] for r in best] == pytest.approx([s for _, s in expected])
    scaled = features.scaled_tfidf(documents(spark), ["id"]).collect()
    for term in mean:
        dense = np.array([scores.get((i, term), 0.0) for i in range(len(TEXTS))])
        z = (dense - dense.mean()) / dense.std()
        rest = next(r["value"] for r in scaled if r["term"] == term and r["id"] is None)
        cells = {r["id"]: r["value"] for r in scaled if r["term"] == term and r["id"] is not None}
        assert [cells.get(i, rest) for i in range(len(TEXTS))] == pytest.approx(z.tolist())


def test_no_terms(spark):
    with pytest.raises(ValueError):
        features.tfidf_scores(documents(spark, ["", "a"]), ["id"])


def test_forest(spark):
    rows = [(i, "good nice" if i % 2 else "bad sad", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, y_true int")
    held_out = models.baseline_forest(df, ["id"], test_size=10, trees=5).collect()
    assert len(held_out) == 10 and all(r["y_pred"] == r["y_true"] for r in held_out)
    assert models.baseline_forest(df, ["id"], same_rows=True, trees=5).count() == 40
    assert models.baseline_forest(df, ["id"], test_size=0.25, trees=5).count() == 10


@pytest.mark.parametrize("few, digits", [(1, 1), (2, 2), (40, 1)])
def test_split_size_is_exact_whatever_the_rounds(spark, monkeypatch, few, digits):
    df = spark.range(300).withColumnRenamed("id", "k")
    expected = split.train_test_split_exact(df, ["k"], 37)
    monkeypatch.setattr(split, "_FEW_ROWS", few)
    monkeypatch.setattr(split, "_DIGITS", digits)
    found = split.train_test_split_exact(df, ["k"], 37)
    assert found.exceptAll(expected).count() == 0 and found.filter("split = 'test'").count() == 37


def test_diversity_of_far_and_nearly_equal_vectors(spark):
    rng = np.random.default_rng(8)
    array = np.concatenate([1e4 + rng.normal(size=(300, 5)), 1e4 + 1e-6 * rng.normal(size=(300, 5))])
    differences = array[:, None] - array[None]
    gaps = np.sqrt((differences**2).sum(axis=2))[np.triu_indices(600, 1)]
    for options in ({}, {"block_rows": 90}):
        assert distribution.diversity_score(vectors(spark, array), **options).first()[0] == pytest.approx(np.mean(gaps), rel=1e-9)
    tiny = distribution.diversity_score(vectors(spark, array[300:])).first()[0]
    assert tiny == pytest.approx(np.mean(gaps[gaps < 1e-3]), rel=1e-6)
    assert distribution.diversity_score(vectors(spark, array).limit(0)).first()[0] is None


def test_histograms_leave_out_what_is_no_number(spark):
    rows = [([1.0, float("nan")],), ([3.0, 2.0],), ([float("inf"), 4.0],), ([None, 6.0],), (None,)]
    sample = spark.createDataFrame(rows, "vec array<double>")
    found = distribution.feature_histograms(sample, sample.limit(0), bins=2).collect()
    assert sorted((r["origin"], r["pos"], r["bin"], r["n"]) for r in found) == [("Real", 0, 0, 1), ("Real", 0, 1, 1), ("Real", 1, 0, 1), ("Real", 1, 1, 2)]


def test_a_costly_score_is_computed_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def costly(x):
        calls.add(1)
        return x / 10

    scored = spark.range(50).select((F.col("id") % 2).alias("y_true"), F.udf(costly, "double")(F.col("id") % 7).alias("y_score"))
    area = evaluation.roc_auc(scored).first()[0]
    assert 0 < area < 1 and calls.value == 50


def test_one_call_has_every_metric(spark):
    rows = [(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.9), (1, 1, 0.7), (1, 0, 0.4), (2, 1, 0.55)]
    scored = spark.createDataFrame(rows, "y_true int, y_pred int, s double")
    found = {(r["metric"], r["label"], r["other"]): r["value"] for r in evaluation.evaluate_all(scored, score="s").collect()}
    single = evaluation.binary_metrics(scored).first().asDict()
    assert {k: found[k, None, None] for k in single} == pytest.approx(single)
    weighted = evaluation.weighted_metrics(scored).first()
    assert [found[f"weighted_{m}", None, None] for m in ("precision", "recall", "f1")] == pytest.approx([weighted[m] for m in ("precision", "recall", "f1")])
    for row in evaluation.class_metrics(scored).collect():
        assert found["class_f1", str(row["label"]), None] == pytest.approx(row["f1"]) and found["support", str(row["label"]), None] == row["support"]
    for row in evaluation.confusion_matrix(scored).collect():
        assert found["confusion", str(row["y_true"]), str(row["y_pred"])] == row["n"]
    assert found["roc_auc", None, None] == pytest.approx(evaluation.roc_auc(scored, score="s").first()[0])
    assert sum(k[0] == "tpr" for k in found) == evaluation.roc_curve(scored, score="s").count()
    assert {r["metric"] for r in evaluation.evaluate_all(scored).collect()}.isdisjoint({"roc_auc", "tpr"})
    assert evaluation.evaluate_all(scored.limit(0)).where("value <> 0").count() == 0


def test_terms_are_counted_without_a_row_object_each(spark, capsys):
    docs = spark.sql("SELECT * FROM VALUES (array('b', 'a', 'b')), (array('b')), (array()), (NULL), (array('c', 'c')) AS d(words)")
    counts = features.term_counts(docs, F.col("words"))
    counts.explain()
    assert "inline" not in capsys.readouterr().out
    assert sorted(map(tuple, counts.collect())) == [("a", 1, 1), ("b", 3, 2), ("c", 2, 1)]
