"""The registered queries: name -> function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from critiq.functions import text as T
from critiq.functions import speech as S
from critiq.operators import (
    behavior,
    cleaning,
    content,
    distribution,
    evaluation,
    features,
    models,
    reviews,
    split,
    tables,
)
from critiq.operators.ordered import row_positions
from critiq.operators.sentiment import with_sentiment
from critiq.plans import parameters as P
from critiq.session import remove_path, scratch_path, spread_rows, written
from critiq.sources import artifacts, csv_reviews, jsonl, profile, word_lists
from critiq.streaming import reviews as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# posexplode_outer is used on computed arrays: for the plain form Spark adds a
# filter on the array's size, which would compute the array a second time.


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


# --- Text and speech ---------------------------------------------------------


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_rows(table(spark, folder, "documents"))


def _analysed(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder).withColumn(
        "outside_score", F.col("n_chars") / (F.col("n_chars") + 1000.0)
    )
    return reviews.analyze_reviews(
        documents, "text", P.LEXICON, P.VOCABULARY, transformer_score="outside_score"
    )


@query
def clean_review_text(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", T.clean_review_text(F.col("text")).alias("cleaned_text")
    )


@query
def clean_text(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", T.clean_text(F.col("text"), P.STOP_WORDS).alias("cleaned_text")
    )


def _lemmas(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the benchmark texts that end in s, with the word without it as lemma."""
    words = T.tokens(T.clean_review_text(F.col("text")))
    plurals = table(spark, folder, "benchmark").select(F.explode(words).alias("token"))
    return (
        plurals.filter("token LIKE '__%s'")
        .distinct()
        .withColumn("lemma", F.left("token", F.length("token") - 1))
    )


@query
def clean_text_lemmas(spark, folder):
    return cleaning.clean_texts(
        _documents(spark, folder), ["doc_id"], "text", P.STOP_WORDS, _lemmas(spark, folder)
    )


@query
def clean_text_lemmas_joined(spark, folder):
    """The way for a lemma table too long to write into the plan: broadcast, with the same result."""
    return cleaning.clean_texts(
        _documents(spark, folder),
        ["doc_id"],
        "text",
        P.STOP_WORDS,
        _lemmas(spark, folder),
        literal_entries=0,
    )


@query
def lexicon_sentiment(spark, folder):
    cleaned = _documents(spark, folder).select(
        "doc_id", T.clean_review_text(F.col("text")).alias("cleaned_text")
    )
    scored = with_sentiment(cleaned, lexicon=P.LEXICON)
    names = ("polarity", "neg", "neu", "pos", "compound")
    return scored.select("doc_id", *[F.col(f"sentiment.{name}").alias(name) for name in names])


def _benchmark_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the test items, scored by their length."""
    cleaned = table(spark, folder, "benchmark").select(T.clean_review_text(F.col("text")).alias("t"))
    words = cleaned.select(F.explode_outer(F.split("t", " ")).alias("word")).where("word <> ''").distinct()
    return words.withColumn("score", (F.length("word") % 9 - 4) / 8.0)


def _large_sentiment(spark: SparkSession, folder: str, **options) -> DataFrame:
    cleaned = _documents(spark, folder).select(
        "doc_id", T.clean_review_text(F.col("text")).alias("cleaned_text")
    )
    lexicon = _benchmark_lexicon(spark, folder)
    scored = with_sentiment(cleaned, lexicon=lexicon, **options)
    names = ("polarity", "neg", "neu", "pos", "compound")
    return scored.select("doc_id", *[F.col(f"sentiment.{name}").alias(name) for name in names])


@query
def lexicon_sentiment_large(spark, folder):
    """Every word of the test items as a lexicon."""
    return _large_sentiment(spark, folder)


@query
def lexicon_sentiment_joined(spark, folder):
    """The way for a lexicon too long to write into the plan: broadcast, with the same result."""
    return _large_sentiment(spark, folder, literal_entries=0)


@query
def speech_patterns(spark, folder):
    flags = ("is_sarcastic", "is_exaggerated", "is_personal", "is_recommendation")
    return _analysed(spark, folder).select(
        "doc_id",
        F.col("speech_analysis.emotional_intensity").alias("emotional_intensity"),
        *[F.col(f"speech_analysis.{flag}").alias(flag) for flag in flags],
    )


@query
def speech_patterns_builtin(spark, folder):
    """The built-in vocabulary over every turn of the conversations, on raw text."""
    text = F.col("text")
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        S.is_sarcastic(text).alias("is_sarcastic"),
        S.is_exaggerated(text).alias("is_exaggerated"),
        S.is_personal(text).alias("is_personal"),
        S.is_recommendation(text).alias("is_recommendation"),
    )


@query
def review_anomaly(spark, folder):
    return _analysed(spark, folder).select(
        "doc_id",
        reviews.polarity().alias("polarity"),
        F.col("speech_analysis.is_sarcastic").alias("is_sarcastic"),
        F.col("speech_analysis.is_exaggerated").alias("is_exaggerated"),
        reviews.type_flag("Emotional").alias("is_emotional"),
        "is_anomaly",
    )


@query
def review_report(spark, folder):
    report = reviews.review_report(_analysed(spark, folder))
    return report.withColumn("anomaly_pct", r6("anomaly_pct"))


@query
def type_sentiment_counts(spark, folder):
    return reviews.type_sentiment_counts(_analysed(spark, folder))


@query
def emotion_flow(spark, folder):
    return reviews.emotion_flow(_analysed(spark, folder))


@query
def type_cooccurrence(spark, folder):
    return reviews.type_cooccurrence(_analysed(spark, folder))


@query
def type_term_counts(spark, folder):
    return reviews.type_term_counts(_analysed(spark, folder), k=50, stop_words=P.STOP_WORDS)


@query
def review_timeline(spark, folder):
    times = table(spark, folder, "events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("timestamp")
    )
    timed = reviews.review_timeline(_analysed(spark, folder).join(times, "doc_id", "left"))
    return timed.select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_ts"),
        F.col("sentiment").alias("polarity"),
        "type",
        "is_anomaly",
    )


@query
def review_features(spark, folder):
    featured = reviews.review_features(_analysed(spark, folder))
    return featured.select("doc_id", *[F.col("features")[i].alias(f"f{i}") for i in range(7)])


# --- Word lists --------------------------------------------------------------


def _lists_from_parts(spark: SparkSession, folder: str) -> DataFrame:
    """A large word list: part names, listed by brand, with a severity from their size."""
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("list_name"),
        F.col("p_name").alias("word"),
        F.col("p_type").alias("category"),
        (F.col("p_size") % 5 + 1).cast("int").alias("severity"),
        F.col("p_partkey").alias("position"),
    )


@query
def words_by_list(spark, folder):
    return content.words_by_list(_lists_from_parts(spark, folder), "Brand#3")


@query
def words_by_severity(spark, folder):
    return content.words_by_severity(_lists_from_parts(spark, folder), 2, 4)


@query
def word_list_scan(spark, folder):
    """Parts written as word-list files with comments and bad lines, and read back."""
    path = scratch_path(spark, "lists")
    size = F.col("p_size")
    line = F.concat_ws(" | ", "p_name", "p_type", (size % 5 + 1).cast("string"))
    lines = (
        F.when(size % 11 == 0, F.concat(F.lit("# "), line))
        .when(size % 7 == 0, F.concat(line, F.lit(".5")))
        .when(size % 13 == 0, "")
        .otherwise(line)
    )
    table(spark, folder, "part").select(lines).write.text(path)
    scan = word_lists.read_word_lists(spark, path)
    rejects = scan.rejects.select(F.col("line").alias("word"), "reason")
    return scan.rows.select("word", "category", "severity").unionByName(rejects, allowMissingColumns=True)


@query
def speech_list_matches(spark, folder):
    """The phrases of the built-in speech list that each document holds."""
    phrases = word_lists.speech_patterns(spark).rows
    return content.content_matches(_documents(spark, folder), phrases, ["doc_id"]).select("doc_id", "word", "severity")


@query
def content_matches(spark, folder):
    found = content.content_matches(
        _documents(spark, folder), content.default_word_lists(spark), ["doc_id"]
    )
    return found.drop("position")


@query
def content_matches_joined(spark, folder):
    """The way for word lists too long to write into the plan: one automaton, with the same result."""
    found = content.content_matches(
        _documents(spark, folder), content.default_word_lists(spark), ["doc_id"], literal_entries=0
    )
    return found.drop("position")


@query
def severity_summary(spark, folder):
    return content.severity_summary(
        _documents(spark, folder), content.default_word_lists(spark), ["doc_id"]
    )


@query
def content_check(spark, folder):
    return content.content_check(
        _documents(spark, folder), content.default_word_lists(spark), ["doc_id"]
    )


@query
def content_appropriate(spark, folder):
    return content.content_appropriate(
        _documents(spark, folder), content.default_word_lists(spark), ["doc_id"]
    )


@query
def content_analysis(spark, folder):
    analysed = features.content_analysis(
        _documents(spark, folder),
        content.default_word_lists(spark),
        ["doc_id"],
        stop_words=P.STOP_WORDS,
        top_n=10,
    )
    n_matches = F.aggregate(
        F.map_values("matches"), F.lit(0).cast("long"), lambda n, found: n + F.size(found)
    )
    return analysed.select(
        "doc_id",
        "is_appropriate",
        n_matches.alias("n_matches"),
        F.posexplode_outer("keywords").alias("i", "k"),
    ).filter("k IS NOT NULL").select(
        "doc_id",
        "is_appropriate",
        "n_matches",
        (F.col("i") + 1).alias("rank"),
        F.col("k.keyword").alias("keyword"),
        r6("k.score").alias("score"),
    )


# --- Review tables -----------------------------------------------------------


def _books(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as books."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("asin"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("main_category"),
    )


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as reviews with the category of their part."""
    books = _books(spark, folder)
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("asin"),
        F.col("l_quantity").alias("rating"),
        F.length("l_returnflag").alias("review_length"),
    )
    return tables.merge_books_and_reviews(books, lines).withColumnRenamed(
        "main_category", "category"
    )


@query
def reviews_books_join(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("asin")
    )
    return tables.merge_books_and_reviews(_books(spark, folder), lines)


@query
def reviews_books_join_salted(spark, folder):
    """The way for clusters without adaptive execution, with the same result."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("asin")
    )
    return tables.merge_books_and_reviews(_books(spark, folder), lines, salts=4)


@query
def prepare_reviews(spark, folder):
    """Documents as reviews, dated by the order with the same number."""
    dates = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.date_format("o_orderdate", "MM d, yyyy").alias("reviewTime"),
    )
    raw = _documents(spark, folder).select("doc_id", F.col("text").alias("reviewText"))
    prepared = tables.prepare_for_analysis(raw.join(dates, "doc_id", "left"))
    return prepared.select(
        "doc_id",
        F.date_format("review_time", "yyyy-MM-dd HH:mm:ss").alias("review_time"),
        "review_length",
        "word_count",
    )


def _csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select(
        "doc_id",
        F.col("source").alias("Title"),
        F.col("text").alias("description"),
        F.col("lang").alias("authors"),
        F.col("n_chars").cast("string").alias("ratingsCount"),
    )


#: About so many bytes go into one of the files that a query writes and reads back.
FILE_BYTES = 64 << 20


def _dealt_in_order(rows: DataFrame, key: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Rows in the order of the key, in five partitions at least and more as the table grows."""
    width = sum(
        (F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8) for f in rows.schema),
        F.lit(0).cast("long"),
    )
    total = rows.agg(F.sum(width)).first()[0] or 0
    return rows.repartitionByRange(max(5, -(-total // file_bytes)), key).sortWithinPartitions(key)


@query
def csv_reviews_normalize(spark, folder):
    return csv_reviews.normalize_reviews(_csv_rows(spark, folder), key="doc_id")


@query
def csv_reviews_load(spark, folder):
    """Documents written as CSV files in order and read back as reviews."""
    path = scratch_path(spark, "csv")
    rows = _csv_rows(spark, folder).orderBy("doc_id").drop("doc_id")
    rows.write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return csv_reviews.load_reviews(spark, path, limit=None)


@query
def csv_reviews_first_rows(spark, folder):
    """The first rows of several CSV files, in the order of the files."""
    path = scratch_path(spark, "csv")
    rows = _dealt_in_order(_csv_rows(spark, folder), "doc_id").drop("doc_id")
    rows.write.csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return csv_reviews.load_reviews(spark, path, limit=P.FIRST_ROWS)


@query
def lines_first(spark, folder):
    """The first lines of several JSON files, in the order of the files, profiled by field."""
    path = scratch_path(spark, "lines")
    rows = table(spark, folder, "documents").select("doc_id", "lang", F.when(F.col("n_chars") % 2 == 0, "x").alias("even"))
    lines = _dealt_in_order(rows, "doc_id").select(F.to_json(F.struct("*")))
    lines.write.text(path)
    return profile.json_profile(profile.read_lines(spark, path, P.FIRST_ROWS))


@query
def training_text(spark, folder):
    votes = _documents(spark, folder).select(
        "doc_id",
        F.col("source").alias("title"),
        "text",
        (F.col("n_chars") % 3).alias("helpful_votes"),
    )
    return tables.training_text(votes).select("doc_id", "text", "is_helpful")


@query
def books_scan(spark, folder):
    """Parts written as gzipped JSON lines, some unusable, and read back as books."""
    path = scratch_path(spark, "books")
    size = F.col("p_size")
    lines = table(spark, folder, "part").select(
        F.to_json(
            F.struct(
                F.col("p_partkey").cast("string").alias("parent_asin"),
                F.col("p_name").alias("title"),
                F.when(size % 3 == 0, F.struct(F.col("p_brand").alias("name"))).alias("author"),
                F.when(size % 4 != 0, F.split("p_type", " ")).alias("description"),
                F.array("p_brand", "p_type").alias("categories"),
                F.when(size % 10 == 0, "-")
                .when(size % 2 == 0, F.col("p_retailprice").cast("string"))
                .alias("price"),
                F.col("p_brand").alias("main_category"),
                F.when(size % 5 != 0, F.array("p_type")).alias("images"),
                (size / 10.0).alias("average_rating"),
                size.alias("rating_number"),
            )
        )
    )
    lines.write.text(path, compression="gzip")
    scan = jsonl.read_books(spark, path)
    rejects = scan.rejects.select(F.get_json_object("value", "$.parent_asin").alias("asin"), "reason")
    return scan.rows.select(
        "asin",
        "title",
        "author",
        "description",
        F.array_join("categories", "|").alias("categories"),
        "price",
        "store",
        "main_category",
        "image_url",
        r6("average_rating").alias("average_rating"),
        "rating_count",
        F.size("details").alias("n_details"),
    ).unionByName(rejects, allowMissingColumns=True)


@query
def reviews_scan(spark, folder):
    """Orders written as gzipped JSON lines, some broken, and read back as reviews."""
    path = scratch_path(spark, "reviews")
    key = F.col("o_orderkey")
    since_1970 = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), "o_orderdate")
    record = F.to_json(
        F.struct(
            F.when(key % 11 != 0, F.col("o_custkey").cast("string")).alias("asin"),
            F.concat(F.lit("R"), key).alias("reviewerID"),
            F.col("o_orderpriority").alias("reviewText"),
            F.col("o_totalprice").alias("overall"),
            (key % 2 == 0).alias("verified"),
            F.date_format("o_orderdate", "MM d, yyyy").alias("reviewTime"),
            F.when(key % 3 != 0, since_1970).alias("unixReviewTime"),
            F.when(key % 4 == 0, F.array((key % 9).cast("int"), F.lit(9))).alias("helpful"),
        )
    )
    broken = F.when(key % 13 == 0, F.left(record, F.length(record) - 1)).otherwise(record)
    table(spark, folder, "orders").select(broken).write.text(path, compression="gzip")
    scan = jsonl.read_reviews(spark, path)
    rejects = scan.rejects.select(F.regexp_extract("value", r'"reviewerID":"(R\d+)"', 1).alias("reviewerID"), "reason")
    return tables.prepare_for_analysis(scan.rows).select(
        "asin",
        "reviewerID",
        "review_text",
        "rating",
        "verified",
        F.date_format("review_time", "yyyy-MM-dd").alias("review_date"),
        "unix_review_time",
        F.col("helpful")[0].alias("helpful_votes"),
        F.col("helpful")[1].alias("all_votes"),
        "vote",
        "review_length",
        "word_count",
    ).unionByName(rejects, allowMissingColumns=True)


@query
def rating_summary(spark, folder):
    summary = tables.rating_summary(_rated(spark, folder))
    return summary.withColumns(
        {c: r6(c) for c in ("average_rating", "rating_std", "average_review_length")}
    )


@query
def category_ratings(spark, folder):
    return tables.category_ratings(_rated(spark, folder)).withColumn(
        "avg_rating", r6("avg_rating")
    )


@query
def top_categories(spark, folder):
    return tables.top_categories(_rated(spark, folder)).withColumn("avg_rating", r6("avg_rating"))


@query
def rating_histogram(spark, folder):
    return tables.histogram(table(spark, folder, "lineitem"), "l_quantity", 20)


@query
def rating_box(spark, folder):
    return tables.box_statistics(table(spark, folder, "lineitem"), "l_quantity")


@query
def price_box(spark, folder):
    """Box statistics of a column with many distinct values."""
    box = tables.box_statistics(table(spark, folder, "lineitem"), "l_extendedprice")
    return box.select("n_outliers", *[r6(c).alias(c) for c in box.columns if c != "n_outliers"])


@query
def row_numbers(spark, folder):
    """Position of each order in the order of its key."""
    return row_positions(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey")


@query
def json_profile(spark, folder):
    return profile.json_profile(table(spark, folder, "events"), "props")


@query
def json_value_summary(spark, folder):
    """Documents as JSON records with a list, an object and long strings."""
    records = _documents(spark, folder).select(
        "doc_id",
        F.to_json(
            F.struct(
                "text",
                F.split("text", " ").alias("parts"),
                F.struct("lang", "source").alias("meta"),
                "n_chars",
            )
        ).alias("value"),
    )
    return profile.json_value_summary(records, "value", ("doc_id",))


# --- Behaviour and splits ----------------------------------------------------


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "user_id",
        F.col("ts").alias("timestamp"),
        F.col("value").alias("rating"),
        F.col("props").alias("text"),
        "event_type",
    )


@query
def behavioral_features(spark, folder):
    found = behavior.behavioral_features(_events(spark, folder))
    return found.select(
        "user_id", "review_frequency", *[r6(c).alias(c) for c in found.columns[2:]]
    )


@query
def review_gaps(spark, folder):
    found = behavior.review_gaps(_events(spark, folder))
    return found.select(
        "user_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("review_time"),
        "n_reviews",
        r6("gap_seconds").alias("gap_seconds"),
    )


@query
def behavioral_features_windowed(spark, folder):
    found = behavior.behavioral_features_windowed(_events(spark, folder))
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        "user_id",
        "review_frequency",
        *[r6(c).alias(c) for c in found.columns[3:]],
    )


@query
def train_test_split_exact(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id")
    return split.train_test_split_exact(documents, ["doc_id"], P.TEST_ROWS)


@query
def train_test_split_by_two_columns(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn")
    return split.train_test_split_exact(turns, ["conv_id", "turn"], P.TEST_ROWS)


# --- Evaluation --------------------------------------------------------------


def _insults() -> Column:
    return F.regexp_count(F.lower("text"), F.lit("|".join(P.INSULTS)))


def _scored_by_length(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels with a score that grows with the length of the document."""
    lengths = table(spark, folder, "documents").select("doc_id", "n_chars")
    score = (F.col("n_chars") + 1) / (F.col("n_chars") + 1001.0)
    return (
        table(spark, folder, "labels")
        .join(lengths, "doc_id")
        .select("doc_id", F.col("quality").alias("y_true"), score.alias("y_score"))
        .withColumn("y_pred", (F.col("y_score") > 0.5).cast("int"))
    )


def _scored_by_insults(spark: SparkSession, folder: str) -> DataFrame:
    """Quality labels, predicted 1 where the text has no insult."""
    counted = _documents(spark, folder).select("doc_id", _insults().alias("insults"))
    return (
        table(spark, folder, "labels")
        .join(counted, "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("y_true"),
            (F.col("insults") == 0).cast("int").alias("y_pred"),
            "toxic",
            (F.col("insults") / (F.col("insults") + 1.0)).alias("insult_score"),
        )
    )


@query
def binary_metrics(spark, folder):
    found = evaluation.binary_metrics(_scored_by_length(spark, folder))
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query
def weighted_metrics(spark, folder):
    found = evaluation.weighted_metrics(_scored_by_length(spark, folder))
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query
def classification_report(spark, folder):
    found = evaluation.classification_report(_scored_by_insults(spark, folder))
    return found.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(_scored_by_insults(spark, folder))


@query
def prediction_distribution(spark, folder):
    return evaluation.prediction_distribution(_scored_by_length(spark, folder))


@query
def roc_curve(spark, folder):
    points = evaluation.roc_curve(_scored_by_length(spark, folder))
    return points.select(*[r6(c).alias(c) for c in points.columns])


@query
def roc_auc(spark, folder):
    by_length = evaluation.roc_auc(_scored_by_length(spark, folder))
    by_insults = evaluation.roc_auc(_scored_by_insults(spark, folder), "toxic", "insult_score")
    rows = by_length.withColumn("model", F.lit("length")).unionByName(
        by_insults.withColumn("model", F.lit("insults"))
    )
    return rows.withColumn("roc_auc", r6("roc_auc"))


@query
def evaluate_all(spark, folder):
    """All metrics of the length score in one call."""
    found = evaluation.evaluate_all(_scored_by_length(spark, folder), score="y_score")
    keep = F.col("metric") != "tpr"  # the curve is a query of its own
    return found.where(keep).withColumn("value", r6("value"))


@query
def scored_loss_accuracy(spark, folder):
    p_true = F.when(F.col("y_true") == 1, F.col("y_score")).otherwise(1 - F.col("y_score"))
    found = evaluation.scored_loss_accuracy(
        _scored_by_length(spark, folder).withColumn("p_true", p_true)
    )
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query
def logits_to_predictions(spark, folder):
    logits = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("logits"))
    found = evaluation.logits_to_predictions(logits)
    return found.select("vec_id", "y_pred", r6(F.array_max("probs")).alias("p_max"))


@query
def model_comparison(spark, folder):
    found = evaluation.model_comparison(
        {"length": _scored_by_length(spark, folder), "insults": _scored_by_insults(spark, folder)}
    )
    return found.withColumn("value", r6("value"))


# --- Vectors -----------------------------------------------------------------


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    score = 1 / (1 + F.exp(-8 * F.get("embedding", F.lit(0)).cast("double")))
    return table(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").alias("vec"), "label", score.alias("score")
    )


def _samples(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    vectors = _vectors(spark, folder)
    return vectors.filter("label < 5"), vectors.filter("label >= 5")


def _rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with the mean vector of its label in the place of a reconstruction."""
    vectors = _vectors(spark, folder)
    means = distribution.group_mean_vectors(vectors, "label")
    return distribution.reconstruction_anomaly(
        vectors.join(means, "label"), "vec", "mean_vec", P.RECONSTRUCTION_CUT
    )


@query
def feature_statistics(spark, folder):
    found = distribution.feature_statistics(_vectors(spark, folder))
    return found.select("pos", *[r6(c).alias(c) for c in ("mean", "std", "min", "max")])


@query
def feature_histograms(spark, folder):
    return distribution.feature_histograms(*_samples(spark, folder))


@query
def wasserstein_distance(spark, folder):
    found = distribution.wasserstein_distance(*_samples(spark, folder))
    return found.select(r6("wasserstein_distance").alias("wasserstein_distance"))


@query
def wasserstein_by_feature(spark, folder):
    found = distribution.wasserstein_by_feature(*_samples(spark, folder))
    return found.select("pos", r6("distance").alias("distance"))


@query
def diversity_score(spark, folder):
    found = distribution.diversity_score(_vectors(spark, folder))
    return found.select(r6("diversity_score").alias("diversity_score"))


@query
def two_sample_evaluation(spark, folder):
    found = distribution.two_sample_evaluation(*_samples(spark, folder))
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query
def reconstruction_anomaly(spark, folder):
    return _rebuilt(spark, folder).select("vec_id", r6("error").alias("error"), "is_anomaly")


@query
def error_histogram(spark, folder):
    return tables.histogram(_rebuilt(spark, folder), "error", 50)


@query
def standard_scale(spark, folder):
    scaled = features.standard_scale(_vectors(spark, folder))
    return scaled.select("vec_id", F.posexplode_outer("scaled").alias("pos", "value")).withColumn(
        "value", r6("value")
    )


@query
def combined_features(spark, folder):
    """Counts per event type next to the behaviour of each user."""
    events = _events(spark, folder)
    kinds = events.groupBy("user_id").agg(
        F.array(
            *[
                F.count_if(F.col("event_type") == kind).cast("double")
                for kind in ("click", "view", "error", "purchase", "signup")
            ]
        ).alias("text_features")
    )
    together = features.combine_features(kinds, behavior.behavioral_features(events))
    return together.select("user_id", F.posexplode_outer("features").alias("pos", "value")).withColumn(
        "value", r6("value")
    )


@query
def pca_scores(spark, folder):
    scored = features.pca_scores(_vectors(spark, folder))
    return scored.select("vec_id", F.posexplode_outer("scores").alias("component", "value"))


@query
def pca_reconstruction_anomaly(spark, folder):
    found = features.pca_reconstruction_anomaly(_vectors(spark, folder), k=10, threshold=0.5)
    return found.select("vec_id", "error", "is_anomaly")


def _all_scores(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return written(features.pca_scores(_vectors(spark, folder), k=k).select("vec_id", "scores"), "scores")


@query
def pca_score_lengths(spark, folder):
    """The squared length of the scores of all components, which is that of the centred vector."""
    width = _vectors(spark, folder).select(F.size("vec")).first()[0]
    scores = _all_scores(spark, folder, width)
    square = F.aggregate("scores", F.lit(0.0), lambda total, x: total + x * x)
    return scores.select("vec_id", r6(square).alias("squared_length"))


@query
def pca_component_correlation(spark, folder):
    """The correlation of every two of the first components: none."""
    k = 5
    scores = _all_scores(spark, folder, k)
    cells = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.abs(F.round(F.corr(F.col("scores")[i], F.col("scores")[j]), 6)).alias("r")) for i in range(k) for j in range(k)]
    return scores.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


@query
def pca_variance(spark, folder):
    """The variance of all components together, and whether it falls from one to the next."""
    width = _vectors(spark, folder).select(F.size("vec")).first()[0]
    scores = _all_scores(spark, folder, width)
    spread = scores.agg(F.array(*[F.var_samp(F.col("scores")[i]) for i in range(width)]).alias("v"))
    falls = F.forall(F.sequence(F.lit(1), F.lit(width - 1)), lambda i: F.get("v", i) <= F.get("v", i - 1) + 1e-12)
    return spread.select(r6(F.aggregate("v", F.lit(0.0), lambda total, x: total + x)).alias("total_variance"), falls.alias("falls"))


@query
def projection_lengths(spark, folder):
    """The squared length of all seven projected review features, which is that of the centred features."""
    featured = reviews.review_features(_analysed(spark, folder)).select("doc_id", "features")
    flat = features.pca_scores(written(featured, "features"), "features", 7)
    square = F.aggregate("scores", F.lit(0.0), lambda total, x: total + x * x)
    return flat.select("doc_id", r6(square).alias("squared_length"))


@query
def review_projection(spark, folder):
    """Two components of the seven review features, with the verdict."""
    featured = reviews.review_features(_analysed(spark, folder)).select(
        "doc_id", "features", "is_anomaly"
    )
    flat = features.pca_scores(written(featured, "features"), "features", 2)
    return flat.select(
        "doc_id", F.col("scores")[0].alias("x"), F.col("scores")[1].alias("y"), "is_anomaly"
    )


# --- Text features -----------------------------------------------------------


@query
def tfidf_scores(spark, folder):
    found = features.tfidf_scores(
        _documents(spark, folder), ["doc_id"], stop_words=P.STOP_WORDS
    )
    return found.withColumn("score", r6("score"))


@query
def top_keywords(spark, folder):
    found = features.top_keywords(_documents(spark, folder), stop_words=P.STOP_WORDS)
    return found.withColumn("score", r6("score"))


@query
def scaled_tfidf(spark, folder):
    found = features.scaled_tfidf(
        _documents(spark, folder), ["doc_id"], stop_words=P.STOP_WORDS
    )
    return found.withColumn("value", r6("value"))


@query
def baseline_forest(spark, folder):
    """Report of a forest that predicts toxic labels, on held-out rows."""
    labelled = (
        table(spark, folder, "labels")
        .join(_documents(spark, folder).select("doc_id", "text"), "doc_id")
        .withColumnRenamed("toxic", "y_true")
    )
    predictions = models.baseline_forest(labelled, ["doc_id"], test_size=0.25)
    return evaluation.classification_report(predictions)


# --- Streams -----------------------------------------------------------------


@query
def review_stream(spark, folder):
    """The documents read, scored and written as a stream; the table it wrote."""
    documents = streams.read_review_stream(
        spark,
        folder,
        table(spark, folder, "documents").schema,
        "documents.parquet",
        spark.sparkContext.defaultParallelism,
    )
    scored = streams.score_stream(
        documents, text="text", lexicon=P.LEXICON, vocabulary=P.VOCABULARY
    ).select("doc_id", reviews.polarity().alias("polarity"), "is_anomaly")
    path = scratch_path(spark, "stream")
    streams.write_available(scored, f"{path}/rows", f"{path}/state").awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{path}/rows")


@query
def behavior_stream(spark, folder):
    """Windowed behaviour as a stream with a watermark of a day, in five batches.

    The first four come in the order of arrival, up to twelve hours after the event; the last has a part of
    the events of the first ten days, too late for their windows. What the stream has closed is returned.
    """
    path = scratch_path(spark, "events")
    events = table(spark, folder, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("value").alias("rating"), F.col("props").alias("text")
    )
    start = events.select(F.date_trunc("day", F.min("timestamp"))).scalar()
    days = (F.unix_micros("timestamp") - F.unix_micros(start)) / F.lit(86_400_000_000.0)
    too_late = (F.col("event_id") % 97 == 0) & (days < 10)
    arrival = F.floor((days + (F.col("event_id") % 5) / 8.0) / 8)
    batch = F.when(too_late, 4).otherwise(F.least(arrival, F.lit(3)))
    dealt = written(events.withColumn("batch", batch.cast("int")), "dealt")
    files = spark.sparkContext.defaultParallelism
    for number in range(5):
        dealt.where(F.col("batch") == number).drop("batch").repartition(files).write.mode("append").parquet(f"{path}/in")
    stream = streams.read_review_stream(spark, f"{path}/in", dealt.drop("batch").schema, files_per_batch=files)
    found = streams.windowed_behavior_stream(stream)
    streams.write_available(found, f"{path}/out", f"{path}/state").awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{path}/out")
    return _kept(
        rows.select(
            F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
            "user_id",
            "review_frequency",
            *[r6(c).alias(c) for c in rows.columns[3:]],
        ),
        path,
    )


# --- Files of runs -----------------------------------------------------------


def _kept(result: DataFrame, *paths: str) -> DataFrame:
    """The result in a table of its own, so that the folders it was read from can go."""
    result = written(result, "result")
    for path in paths:
        remove_path(result.sparkSession, path)
    return result


def _histories(spark: SparkSession, folder: str, path: str) -> None:
    """A run for each nation, with the largest balance of eight parts of its customers as the loss of an epoch."""
    epochs = range(8)
    balance, part = F.col("c_acctbal") / 1000.0, F.col("c_custkey") % 8
    largest = [F.max(F.when(part == e, balance)) for e in epochs]
    positive = [F.sum(F.when(part == e, (balance > 0).cast("double"))) for e in epochs]
    of_run = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("run")).agg(
        F.array_compact(F.array(*largest)).alias("train_loss"), F.array_compact(F.array(*positive)).alias("train_acc")
    )
    history = F.struct("train_loss", "train_acc", F.reverse("train_loss").alias("val_loss"), F.array().cast("array<double>").alias("val_acc"))
    of_run.select("run", F.to_json(history, {"pretty": "true"})).write.partitionBy("run").text(path)


def _run() -> Column:
    return F.regexp_extract("checkpoint", "run=(.*)", 1)


@query
def run_histories(spark, folder):
    """Histories written as nested files, one folder a run, and read back with every epoch."""
    path = scratch_path(spark, "runs")
    _histories(spark, folder, path)
    found = artifacts.read_histories(spark, path, "*.txt").select(_run().cast("int").alias("run"), "*")
    epochs = found.select("run", F.posexplode(F.arrays_zip("train_loss", "train_acc", "val_loss")).alias("epoch", "x"), F.size("val_acc").alias("n_val_acc"))
    return _kept(epochs.select("run", "epoch", "x.train_loss", "x.train_acc", "x.val_loss", "n_val_acc"), path)


@query
def history_compare(spark, folder):
    path = scratch_path(spark, "runs")
    _histories(spark, folder, path)
    found = artifacts.history_compare(artifacts.read_histories(spark, path, "*.txt"))
    return _kept(found.select(_run().cast("int").alias("run"), "final_loss", "final_acc"), path)


@query
def run_evaluations(spark, folder):
    """Results per ship mode, with a matrix of counts, written as nested files and read back."""
    path = scratch_path(spark, "runs")
    returned, large = F.col("l_returnflag") == "R", F.col("l_quantity") > 25
    matrix = F.array(*[F.array(*[F.count_if((returned == a) & (large == b)) for b in (False, True)]) for a in (False, True)])
    results = table(spark, folder, "lineitem").groupBy(F.col("l_linenumber").alias("run")).agg(
        F.round(F.avg((returned == large).cast("double")), 6).alias("accuracy"), matrix.alias("confusion_matrix")
    )
    results.select("run", F.to_json(F.struct("accuracy", "confusion_matrix"), {"pretty": "true"})).write.partitionBy("run").text(path)
    found = artifacts.read_evaluations(spark, path, "*.txt")
    cells = [F.col("confusion_matrix")[i][j].alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)]
    return _kept(found.select(_run().cast("int").alias("run"), "accuracy", *cells), path)


@query
def latest_run(spark, folder):
    """The run written last, of one for each region from the last to the first."""
    path = scratch_path(spark, "runs")
    regions = table(spark, folder, "region").orderBy(F.desc("r_regionkey")).limit(100).collect()
    nations = table(spark, folder, "nation")
    for region in regions:
        own = nations.where(F.col("n_regionkey") == region["r_regionkey"]).coalesce(1)
        artifacts.write_json(own, f"{path}/run={region['r_name'].replace(' ', '_')}")
    found = artifacts.latest_artifact(spark, path, "*.json")
    return _kept(found.select(F.replace(F.regexp_extract("folder", "run=([^/]*)", 1), F.lit("_"), F.lit(" ")).alias("run")), path)


@query
def json_report(spark, folder):
    """The ratings of categories written as a report and read back."""
    path = scratch_path(spark, "report")
    report = tables.category_ratings(_rated(spark, folder)).withColumn("avg_rating", r6("avg_rating"))
    artifacts.write_json(report, path)
    return _kept(spark.read.schema(report.schema).json(path), path)


@query
def held_out_rows(spark, folder):
    """The test rows of a split with text and label, written for a later evaluation and read back."""
    path = scratch_path(spark, "held")
    labelled = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    test = split.train_test_split_exact(labelled, ["doc_id"], P.TEST_ROWS).where("split = 'test'")
    artifacts.write_held_out(test.withColumnRenamed("quality", "label"), path)
    held = spark.read.parquet(path)
    return _kept(held.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "label"), path)


@query
def csv_missing_cells(spark, folder):
    """Documents written as CSV with cells that mean 'missing', and read back."""
    path = scratch_path(spark, "csv")
    names = F.array(*map(F.lit, ("NA", "null", "None", "nan", "N/A", "kept")))
    cell = F.get(names, (F.col("n_chars") % 7).cast("int"))
    rows = table(spark, folder, "documents").select("doc_id", cell.alias("cell"), "lang")
    rows.write.csv(path, header=True, escape='"')
    read = csv_reviews.read_csv(spark, path)
    return _kept(read.select(F.col("doc_id").cast("long").alias("doc_id"), "cell", "lang"), path)
