"""Text and vector features: TF-IDF, scaling, principal components."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, CountVectorizerModel, ElementwiseProduct, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Row, functions as F

from critiq import fixed_values as fixed
from critiq.functions import text as T
from critiq.functions.arrays import array_sum
from critiq.operators.content import with_content_checks
from critiq.session import written

# The vocabulary is held by the driver and every task; this bounds it.
MAX_VOCABULARY = 1 << 18

# Words fetched beyond the vocabulary, to see which are tied with its last word.
TIED_WORDS = 10_000

# Pairs are restricted to a list of words only while the list fits well into a plan.
LISTED_WORDS = 20_000


@dataclass(frozen=True)
class Vocabulary:
    """The kept terms, their document counts and the number of documents."""

    terms: tuple[str, ...]
    document_counts: tuple[int, ...]
    documents: int

    @property
    def idf(self) -> np.ndarray:
        """Smoothed inverse document frequency plus one."""
        return np.log((1 + self.documents) / (1 + np.array(self.document_counts, float))) + 1


def term_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """Occurrences and documents of every term.

    Sorting a document's terms brings equal ones together, so both counts come
    from one aggregation by term and no (document, term) pairs are shuffled.
    """
    in_order = docs.select(F.sort_array(terms).alias("_sorted"))
    # The outer form: for the plain one Spark adds a filter that sorts once more.
    placed = in_order.select("_sorted", F.posexplode_outer("_sorted").alias("_place", "term"))
    first = (F.col("_place") == 0) | (F.get("_sorted", F.col("_place") - 1) != F.col("term"))
    marked = placed.where(F.col("term").isNotNull()).select("term", first.alias("first"))
    return marked.groupBy("term").agg(
        F.count("*").alias("occurrences"), F.count_if("first").alias("documents")
    )


def _most_frequent(counts: DataFrame, rows: int, min_df: int) -> list[Row]:
    return (
        counts.filter(F.col("documents") >= min_df)
        .orderBy(F.desc("occurrences"), "term")
        .limit(rows)
        .collect()
    )


def _words_pairs_may_use(frequent: list[Row], max_features: int, complete: bool) -> list[str] | None:
    """The words a kept pair can consist of; None if not all of them are at hand.

    A pair occurs no more often, and in no more documents, than either of its
    words. So once max_features words are found, only words at least as
    frequent as the last of them can make up a pair that is kept.
    """
    if len(frequent) < max_features:
        return [row["term"] for row in frequent]
    least = frequent[max_features - 1]["occurrences"]
    if not complete and frequent[-1]["occurrences"] >= least:
        return None
    return [row["term"] for row in frequent if row["occurrences"] >= least]


def fit_vocabulary(
    docs: DataFrame,
    words: str = "words",
    max_features: int = fixed.MAX_FEATURES,
    min_df: int = fixed.MIN_DF,
    pairs: bool = True,
) -> Vocabulary:
    """The max_features most frequent words and pairs that occur in min_df documents.

    Ties go to the smaller term. Pairs are counted in a second pass, and only
    those that could be frequent enough, so the many rare pairs of a large
    collection are never shuffled.
    """
    if max_features > MAX_VOCABULARY:
        raise ValueError(f"max_features is limited to {MAX_VOCABULARY}")
    fetched = max_features + TIED_WORDS if pairs else max_features
    frequent = _most_frequent(term_counts(docs, F.col(words)), fetched, min_df)
    best = frequent[:max_features]
    if pairs and best:
        among = _words_pairs_may_use(frequent, max_features, len(frequent) < fetched)
        among = among if among is not None and len(among) <= LISTED_WORDS else None
        double = term_counts(docs, T.word_pairs(F.col(words), among))
        best += _most_frequent(double, max_features, min_df)
        best.sort(key=lambda row: (-row["occurrences"], row["term"].encode()))
        best = best[:max_features]
    if not best:
        raise ValueError("no term occurs in enough documents")
    best.sort(key=lambda row: row["term"])
    return Vocabulary(
        tuple(row["term"] for row in best), tuple(row["documents"] for row in best), docs.count()
    )


def tfidf_vectors(
    docs: DataFrame, vocabulary: Vocabulary, words: str = "words", name: str = "tfidf"
) -> DataFrame:
    """Add the TF-IDF vector of each document, sparse and of length one."""
    paired = sorted({word for term in vocabulary.terms if " " in term for word in term.split(" ")})
    among = paired if len(paired) <= LISTED_WORDS else None
    terms = F.concat(words, T.word_pairs(F.col(words), among)) if paired else F.col(words)
    counted = CountVectorizerModel.from_vocabulary(
        list(vocabulary.terms), inputCol="_terms", outputCol="_counts"
    ).transform(docs.withColumn("_terms", terms))
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idf), inputCol="_counts", outputCol="_weighted"
    ).transform(counted)
    return (
        Normalizer(p=2.0, inputCol="_weighted", outputCol=name)
        .transform(weighted)
        .drop("_terms", "_counts", "_weighted")
    )


def vector_cells(df: DataFrame, vector: str, vocabulary: Vocabulary, *others: str) -> DataFrame:
    """The non-zero cells of sparse vectors as rows (term, score)."""
    inner = F.unwrap_udt(vector)
    cells = df.select(*others, inner.alias("_v")).select(
        *others, F.inline(F.arrays_zip("_v.indices", "_v.values"))
    )
    names = F.from_json(F.lit(_json_list(vocabulary.terms)), "array<string>")
    return cells.select(*others, F.get(names, F.col("indices")).alias("term"), F.col("values").alias("score")).filter(
        F.col("score") != 0
    )


def _json_list(items: Sequence) -> str:
    return json.dumps(list(items), ensure_ascii=False)


def keyword_words(text: str = "text", stop_words: Sequence[str] = ()) -> Column:
    """The content words TF-IDF looks at."""
    return T.long_words(T.content_tokens(F.col(text), stop_words))


def _words_table(
    docs: DataFrame, key: Sequence[str], text: str, stop_words: Sequence[str]
) -> DataFrame:
    """Key and words of each document, cleaned once and written for the passes that follow."""
    return written(docs.select(*key, keyword_words(text, stop_words).alias("words")), "words")


def tfidf_scores(
    docs: DataFrame,
    key: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = (),
    max_features: int = fixed.MAX_FEATURES,
    min_df: int = fixed.MIN_DF,
) -> DataFrame:
    """TF-IDF score of every kept term in every document, non-zero ones only."""
    table = _words_table(docs, key, text, stop_words)
    vocabulary = fit_vocabulary(table, "words", max_features, min_df)
    return vector_cells(tfidf_vectors(table, vocabulary), "tfidf", vocabulary, *key)


def top_keywords(
    docs: DataFrame,
    text: str = "text",
    stop_words: Sequence[str] = (),
    top_n: int = fixed.TOP_KEYWORDS,
    max_features: int = fixed.MAX_FEATURES,
    min_df: int = fixed.MIN_DF,
) -> DataFrame:
    """The terms with the highest mean score; documents without a term count as zero."""
    table = _words_table(docs, (), text, stop_words)
    vocabulary = fit_vocabulary(table, "words", max_features, min_df)
    cells = vector_cells(tfidf_vectors(table, vocabulary), "tfidf", vocabulary)
    return (
        cells.groupBy("term")
        .agg((F.sum("score") / vocabulary.documents).alias("score"))
        .orderBy(F.desc("score"), "term")
        .limit(top_n)
    )


def _usable_deviation(mean: Column, variance: Column, n: Column) -> Column:
    """Population deviation; 1 where the variance is no more than rounding noise."""
    eps = float(np.finfo(float).eps)
    noise = n * eps * variance + F.pow(n * mean * eps, F.lit(2.0))
    return F.when(variance <= noise, F.lit(1.0)).otherwise(F.sqrt(variance))


def scaled_tfidf(
    docs: DataFrame,
    key: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = (),
    max_features: int = fixed.MAX_FEATURES,
    min_df: int = fixed.MIN_DF,
) -> DataFrame:
    """TF-IDF scores standardised per term, kept sparse.

    A row with null key gives, per term, the value of every cell not listed.
    """
    table = _words_table(docs, key, text, stop_words)
    vocabulary = fit_vocabulary(table, "words", max_features, min_df)
    cells = vector_cells(tfidf_vectors(table, vocabulary), "tfidf", vocabulary, *key)
    n = F.lit(float(vocabulary.documents))
    mean = F.sum("score") / n
    moments = cells.groupBy("term").agg(
        mean.alias("_mean"), (F.sum(F.col("score") * F.col("score")) / n - mean * mean).alias("_var")
    )
    # At most max_features rows, so every task can hold them.
    stats = moments.select(
        "term", "_mean", _usable_deviation(F.col("_mean"), F.col("_var"), n).alias("_dev")
    )
    scaled = cells.join(F.broadcast(stats), "term").select(
        *key, "term", ((F.col("score") - F.col("_mean")) / F.col("_dev")).alias("value")
    )
    zero = stats.select(
        *[F.lit(None).cast(docs.schema[k].dataType).alias(k) for k in key],
        "term",
        (-F.col("_mean") / F.col("_dev")).alias("value"),
    )
    return scaled.unionByName(zero)


def standard_scale(df: DataFrame, vector: str = "vec", name: str = "scaled") -> DataFrame:
    """Add the vector with each feature at mean 0 and population deviation 1.

    Missing elements are left out of the statistics and stay missing.
    """
    per_position = (
        df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "value"))
        .groupBy("pos")
        .agg(
            F.avg("value").alias("mean"),
            F.var_pop("value").alias("variance"),
            F.count("value").cast("double").alias("n"),
        )
    )
    # One row holding two numbers per feature.
    stats = per_position.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos",
                    "mean",
                    _usable_deviation(F.col("mean"), F.col("variance"), F.col("n")).alias("dev"),
                )
            )
        ).alias("stats")
    ).scalar()
    scaled = F.zip_with(
        F.col(vector).cast("array<double>"), "_stats", lambda x, s: (x - s["mean"]) / s["dev"]
    )
    return df.withColumn("_stats", stats).withColumn(name, scaled).drop("_stats")


def combine_features(
    text_features: DataFrame,
    behaviour: DataFrame,
    key: str = "user_id",
    vector: str = "text_features",
    columns: Sequence[str] = (
        "review_frequency",
        "avg_gap_seconds",
        "avg_rating",
        "rating_std",
        "avg_review_length",
    ),
) -> DataFrame:
    """Text and behaviour features of each key side by side, standardised."""
    together = text_features.join(behaviour, key).select(
        key,
        F.concat(
            F.col(vector).cast("array<double>"), F.array(*[F.col(c).cast("double") for c in columns])
        ).alias("features"),
    )
    return standard_scale(together, "features", "features")


def _fit_components(df: DataFrame, vector: str, k: int):
    """Centred vectors, fitted components and the signs that make them unique."""
    as_vector = df.withColumn("_raw", array_to_vector(F.col(vector).cast("array<double>")))
    centred = (
        StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred")
        .fit(as_vector)
        .transform(as_vector)
    )
    model = PCA(k=k, inputCol="_centred", outputCol="_scores").fit(centred)
    loadings = model.pc.toArray()
    largest = np.abs(loadings).argmax(axis=0)
    signs = np.sign(loadings[largest, np.arange(k)])
    return centred, model, signs


def pca_scores(
    df: DataFrame, vector: str = "vec", k: int = fixed.PCA_COMPONENTS, name: str = "scores"
) -> DataFrame:
    """Add the first k principal component scores of the centred vectors.

    The largest loading of each component is made positive.
    """
    centred, model, signs = _fit_components(df, vector, k)
    signed = ElementwiseProduct(
        scalingVec=Vectors.dense(signs), inputCol="_scores", outputCol="_signed"
    ).transform(model.transform(centred))
    return signed.withColumn(name, vector_to_array("_signed")).drop(
        "_raw", "_centred", "_scores", "_signed"
    )


def pca_reconstruction_anomaly(
    df: DataFrame,
    vector: str = "vec",
    k: int = fixed.PCA_COMPONENTS,
    threshold: float = fixed.RECONSTRUCTION_THRESHOLD,
) -> DataFrame:
    """Add the error of rebuilding each vector from k components, and the verdict.

    Components are orthonormal, so what is lost is the squared length of the
    centred vector less that of its scores.
    """
    centred, model, _ = _fit_components(df, vector, k)

    def squared_length(column: str) -> Column:
        return array_sum(F.transform(vector_to_array(column), lambda x: x * x))

    lost = squared_length("_centred") - squared_length("_scores")
    return (
        model.transform(centred)
        .withColumn("error", F.greatest(lost, F.lit(0.0)) / F.size(vector))
        .withColumn("is_anomaly", F.col("error") > threshold)
        .drop("_raw", "_centred", "_scores")
    )


def content_analysis(
    docs: DataFrame,
    words: DataFrame,
    key: Sequence[str],
    text: str = "text",
    stop_words: Sequence[str] = (),
    top_n: int = 10,
    max_severity: int = fixed.MAX_SEVERITY,
    max_features: int = fixed.MAX_FEATURES,
    min_df: int = fixed.MIN_DF,
) -> DataFrame:
    """Content checks, verdict and the best top_n keywords of every document.

    Keywords are scored against the whole collection; they are picked within
    the document's own vector, without a shuffle.
    """
    checked = with_content_checks(docs.select(*key, text), words, key, text, max_severity)
    table = written(
        checked.withColumn("words", keyword_words(text, stop_words)).drop(text), "content"
    )
    vocabulary = fit_vocabulary(table, "words", max_features, min_df)
    names = F.from_json(F.lit(_json_list(vocabulary.terms)), "array<string>")
    vectors = tfidf_vectors(table, vocabulary).withColumn(
        "_v", F.unwrap_udt("tfidf")
    )
    cells = F.zip_with(
        "_v.indices",
        "_v.values",
        lambda i, v: F.struct((-v).alias("order"), F.get(names, i).alias("keyword"), v.alias("score")),
    )
    best = F.slice(F.sort_array(F.filter(cells, lambda c: c["score"] > 0)), 1, top_n)
    return vectors.withColumn(
        "keywords",
        F.transform(best, lambda c: F.struct(c["keyword"].alias("keyword"), c["score"].alias("score"))),
    ).select(*key, "matches", "severity_summary", "is_appropriate", "keywords")
