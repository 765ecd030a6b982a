"""Evaluation of scored tables.

Everything that looks at classes starts from the counts per (true, predicted)
pair, everything that looks at thresholds from the counts per distinct score:
the large table is read once and aggregated before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from critiq.functions.arrays import argmax, softmax
from critiq.operators.ordered import running_totals
from critiq.session import written


def _safe_ratio(part: Column, whole: Column) -> Column:
    """part / whole, and 0 when there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def _f1(precision: Column, recall: Column) -> Column:
    return _safe_ratio(2 * precision * recall, precision + recall)


#: Labels that a confusion matrix may have.
MOST_CLASSES = 1000


def pair_counts(
    scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", weight: str | None = None
) -> DataFrame:
    """Rows per pair of labels; with `weight`, rows that stand for several."""
    rows = F.count("*") if weight is None else F.sum(weight)
    return scored.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(rows.alias("n"))


def confusion_matrix(
    scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", weight: str | None = None
) -> DataFrame:
    """Counts for every pair of labels that occur anywhere, zeros included.

    A missing label is a class of its own. More than `MOST_CLASSES` labels are an error, because
    the cells are as many as their square.
    """
    counts = pair_counts(scored, y_true, y_pred, weight)
    found = counts.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    labels = [F.lit(row["label"]) for row in found.limit(MOST_CLASSES + 1).collect()]
    if len(labels) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} labels")
    if not labels:
        return counts
    kind = found.schema["label"].dataType
    every = F.array(*[F.struct(label.cast(kind).alias("label")) for label in labels])
    cells = scored.sparkSession.range(1).select(F.explode(every).alias("t")).select("t", F.explode(every).alias("p"))
    cells = cells.select(F.col("t.label").alias("_true"), F.col("p.label").alias("_pred"))
    same = F.col("_true").eqNullSafe(F.col("y_true")) & F.col("_pred").eqNullSafe(F.col("y_pred"))
    return cells.join(counts, same, "left").select(
        F.col("_true").alias("y_true"), F.col("_pred").alias("y_pred"), F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def binary_metrics(
    scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", positive: int = 1
) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class; 0 where undefined."""
    is_true, is_pred = F.col(y_true) == positive, F.col(y_pred) == positive
    return (
        scored.agg(
            F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"),
            F.count_if(is_true & is_pred).alias("_hits"),
            F.count_if(is_pred).alias("_predicted"),
            F.count_if(is_true).alias("_actual"),
        )
        .withColumn("precision", _safe_ratio(F.col("_hits"), F.col("_predicted")))
        .withColumn("recall", _safe_ratio(F.col("_hits"), F.col("_actual")))
        .withColumn("f1_score", _f1(F.col("precision"), F.col("recall")))
        .select("accuracy", "precision", "recall", "f1_score")
    )


def class_metrics(
    scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", weight: str | None = None
) -> DataFrame:
    """Precision, recall, F1 and support of each class seen in truth or prediction."""
    nothing = F.lit(0).cast("long")
    seen = pair_counts(scored, y_true, y_pred, weight).select(
        F.inline(
            F.array(
                F.struct(
                    F.col("y_true").alias("label"),
                    F.col("n").alias("actual"),
                    nothing.alias("predicted"),
                    F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(nothing).alias("hits"),
                ),
                F.struct(
                    F.col("y_pred").alias("label"),
                    nothing.alias("actual"),
                    F.col("n").alias("predicted"),
                    nothing.alias("hits"),
                ),
            )
        )
    )
    return (
        seen.groupBy("label")
        .agg(F.sum("actual").alias("support"), F.sum("predicted").alias("_predicted"), F.sum("hits").alias("_hits"))
        .withColumn("precision", _safe_ratio(F.col("_hits"), F.col("_predicted")))
        .withColumn("recall", _safe_ratio(F.col("_hits"), F.col("support")))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
        .select("label", "precision", "recall", "f1", "support", "_hits")
    )


def _weighted(metric: str) -> Column:
    return F.sum(F.col(metric) * F.col("support")) / F.sum("support")


def weighted_metrics(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Accuracy and the class metrics weighted by support, as one row."""
    return class_metrics(scored, y_true, y_pred).agg(
        (F.sum("_hits") / F.sum("support")).alias("accuracy"),
        _weighted("precision").alias("precision"),
        _weighted("recall").alias("recall"),
        _weighted("f1").alias("f1"),
    )


def classification_report(
    scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    """One row per class, then accuracy (as f1), macro average and weighted average."""
    classes = class_metrics(scored, y_true, y_pred)
    metrics = ("precision", "recall", "f1")
    summary = classes.agg(
        F.struct(
            F.lit("accuracy").alias("row_label"),
            F.lit(None).cast("double").alias("precision"),
            F.lit(None).cast("double").alias("recall"),
            (F.sum("_hits") / F.sum("support")).alias("f1"),
            F.sum("support").alias("support"),
        ).alias("accuracy"),
        F.struct(
            F.lit("macro avg").alias("row_label"),
            *[F.avg(m).alias(m) for m in metrics],
            F.sum("support").alias("support"),
        ).alias("macro"),
        F.struct(
            F.lit("weighted avg").alias("row_label"),
            *[_weighted(m).alias(m) for m in metrics],
            F.sum("support").alias("support"),
        ).alias("weighted"),
    ).select(F.inline(F.array("accuracy", "macro", "weighted")))
    per_class = classes.select(
        F.col("label").cast("string").alias("row_label"), *metrics, "support"
    )
    return per_class.unionByName(summary)


def prediction_distribution(scored: DataFrame, y_pred: str = "y_pred") -> DataFrame:
    return scored.groupBy(F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def _threshold_counts(scored: DataFrame, y_true: str, score: str, positive: int) -> DataFrame:
    # Rows without a score or a label cannot be placed on the curve and are left out. Scores are judged
    # after they are counted and written: a filter would be moved below and compute them once more.
    per_score = scored.where(F.col(y_true).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(y_true) == positive).alias("tp"),
        F.count_if(F.col(y_true) != positive).alias("fp"),
    )
    known = written(per_score, "scores").where(F.col("threshold").isNotNull() & ~F.isnan("threshold"))
    return running_totals(
        known,
        "threshold",
        ["tp", "fp"],
        carry_next=["threshold", "tp", "fp"],
        descending=True,
        write_first=False,
    )


def roc_curve(
    scored: DataFrame,
    y_true: str = "y_true",
    score: str = "y_score",
    positive: int = 1,
    drop_intermediate: bool = True,
) -> DataFrame:
    """False and true positive rate at each threshold, starting at (0, 0) above all scores.

    A point between two equal steps lies on the line through its neighbours and
    is dropped unless drop_intermediate is off; the first and last always stay.
    """
    steps = _threshold_counts(scored, y_true, score, positive)
    if drop_intermediate:
        first = (F.col("cum_tp") == F.col("tp")) & (F.col("cum_fp") == F.col("fp"))
        last = F.col("next_threshold").isNull()
        turns = (F.col("tp") != F.col("next_tp")) | (F.col("fp") != F.col("next_fp"))
        steps = steps.filter(first | last | turns)
    points = steps.select(
        (F.col("cum_fp") / F.nullif("all_fp", F.lit(0))).alias("fpr"),
        (F.col("cum_tp") / F.nullif("all_tp", F.lit(0))).alias("tpr"),
        "threshold",
    )
    start = scored.sparkSession.range(1).select(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold")
    )
    return points.unionByName(start)


def roc_auc(
    scored: DataFrame, y_true: str = "y_true", score: str = "y_score", positive: int = 1
) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when only one class occurs."""
    steps = _threshold_counts(scored, y_true, score, positive)
    # Width of a step times the mean of its two heights, in whole half-pairs.
    half_pairs = F.col("fp").cast("decimal(38,0)") * (2 * F.col("cum_tp") - F.col("tp"))
    pairs = F.sum("tp").cast("double") * F.sum("fp").cast("double") * 2
    return steps.agg((F.sum(half_pairs).cast("double") / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def evaluate_all(
    scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", score: str | None = None, positive: int = 1
) -> DataFrame:
    """Every metric of a scored table in one long table: (metric, label, other, value).

    Accuracy, precision, recall and f1_score of the positive class; the same weighted by class, with the
    prefix weighted_; each class with class_precision, class_recall, class_f1 and support; a cell
    of the confusion matrix for each pair of labels (true, predicted); with a score also roc_auc, and
    each point of the curve as tpr, with its fpr as label and its threshold as other.
    """
    counts = written(
        scored.groupBy(F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n")), "pairs"
    )
    text = lambda c: F.col(c).cast("string")
    nothing = F.lit(None).cast("string")

    def long(df: DataFrame, names: dict[str, str], label: Column, other: Column) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for c, n in names.items()])
        return df.select(label.alias("label"), other.alias("other"), F.inline(cells)).select("metric", "label", "other", "value")

    single = _of_counts(counts, positive)
    result = long(single, {c: c for c in single.columns}, nothing, nothing)
    classes = class_metrics(counts, weight="n")
    summary = classes.agg(
        (F.sum("_hits") / F.sum("support")).alias("accuracy"), *[_weighted(m).alias(m) for m in ("precision", "recall", "f1")]
    )
    result = result.unionByName(long(summary, {c: f"weighted_{c}" for c in ("precision", "recall", "f1")}, nothing, nothing))
    of_class = {"precision": "class_precision", "recall": "class_recall", "f1": "class_f1", "support": "support"}
    result = result.unionByName(long(classes, of_class, text("label"), nothing))
    result = result.unionByName(long(confusion_matrix(counts, weight="n"), {"n": "confusion"}, text("y_true"), text("y_pred")))
    if score is not None:
        result = result.unionByName(long(roc_auc(scored, y_true, score, positive), {"roc_auc": "roc_auc"}, nothing, nothing))
        points = roc_curve(scored, y_true, score, positive)
        result = result.unionByName(long(points, {"tpr": "tpr"}, text("fpr"), text("threshold")))
    return result


def _of_counts(counts: DataFrame, positive: int) -> DataFrame:
    """The metrics of the positive class from counts per pair of labels."""
    is_true, is_pred = F.col("y_true") == positive, F.col("y_pred") == positive

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    known = F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    sums = counts.agg(
        (rows(F.col("y_true") == F.col("y_pred")) / F.nullif(rows(known), F.lit(0))).alias("accuracy"),
        rows(is_true & is_pred).alias("_hits"),
        rows(is_pred).alias("_predicted"),
        rows(is_true).alias("_actual"),
    )
    precision, recall = _safe_ratio(F.col("_hits"), F.col("_predicted")), _safe_ratio(F.col("_hits"), F.col("_actual"))
    return sums.select("accuracy", precision.alias("precision"), recall.alias("recall")).withColumn(
        "f1_score", _f1(F.col("precision"), F.col("recall"))
    )


def scored_loss_accuracy(
    scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", p_true: str = "p_true"
) -> DataFrame:
    """Mean log loss of the probability given to the true class, and accuracy."""
    return scored.agg(
        F.avg(-F.ln(p_true)).alias("loss"),
        F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"),
    )


def logits_to_predictions(df: DataFrame, logits: str = "logits") -> DataFrame:
    """Add the predicted class y_pred and the class probabilities probs."""
    return df.withColumns({"y_pred": argmax(F.col(logits)), "probs": softmax(F.col(logits))})


def model_comparison(models: dict[str, DataFrame]) -> DataFrame:
    """Weighted precision, recall and F1 of each scored table, in long form."""
    rows = None
    for name, scored in models.items():
        one = (
            weighted_metrics(scored)
            .select(F.lit(name).alias("model"), "precision", "recall", F.col("f1").alias("f1-score"))
            .unpivot("model", ["precision", "recall", "f1-score"], "metric", "value")
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows
