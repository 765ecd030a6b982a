"""Baseline classifier over TF-IDF features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from critiq import fixed_values as fixed
from critiq.functions import text as T
from critiq.operators.features import fit_vocabulary, tfidf_vectors
from critiq.operators.split import train_test_split_exact
from critiq.session import written


def baseline_forest(
    labelled: DataFrame,
    key: Sequence[str],
    text: str = "text",
    label: str = "y_true",
    test_size: int | float = 1000,
    same_rows: bool = False,
    max_features: int = fixed.MAX_FEATURES,
    trees: int = fixed.FOREST_TREES,
    max_depth: int = 5,
    seed: int = fixed.SEED,
) -> DataFrame:
    """Predictions (key, y_true, y_pred, p_positive) of a random forest on word TF-IDF.

    Scored on held-out rows (their number, or their share of all rows as a
    fraction), or on its own training rows with same_rows.
    """
    words = T.long_words(T.tokens(T.clean_review_text(F.col(text))))
    rows = written(
        labelled.select(*key, F.col(label).cast("int").alias("y_true"), words.alias("words")),
        "labelled",
    )
    if same_rows:
        train = test = rows
    else:
        if isinstance(test_size, float):
            test_size = math.ceil(test_size * rows.count())
        split = train_test_split_exact(rows, key, test_size, seed)
        train, test = (split.filter(F.col("split") == part) for part in ("train", "test"))
    vocabulary = fit_vocabulary(train, "words", max_features, min_df=1, pairs=False)
    forest = RandomForestClassifier(
        featuresCol="tfidf", labelCol="y_true", numTrees=trees, maxDepth=max_depth, seed=seed
    )
    model = forest.fit(tfidf_vectors(train, vocabulary).select("tfidf", "y_true"))
    scored = model.transform(tfidf_vectors(test, vocabulary))
    return scored.select(
        *key,
        "y_true",
        F.col("prediction").cast("int").alias("y_pred"),
        F.get(vector_to_array("probability"), F.lit(1)).alias("p_positive"),
    )
