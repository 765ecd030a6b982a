"""Quality rules: fixed text rules, then a log-likelihood ratio of hashed n-grams.

Every document gets counts (words, symbols, repeated lines and windows). A document that
passes the fixed rules is scored, for words and for pairs of words, by the mean over its n-grams of

    log P(n-gram | trusted target) - log P(n-gram | raw corpus)

where both multinomials of an order run over its hash buckets and are counted over all documents.
The means of the orders are added: most pairs of a document stand nowhere else and weigh nothing, so
one mean over all n-grams would be half that of the words. The raw counts are scaled to the size of the
target and both get the same constant added, so buckets of rare n-grams, of which the target has none by
chance, weigh little in a small corpus too. The logarithms are rounded to whole units of 1/10000, so
sums are of whole numbers: the same in any order, on any number of executors.

Counting needs one row per bucket and task to be shuffled; the text of trusted documents is
joined with its ids. The weights (one number per bucket) are sent to the executors as a
constant of the plan; their number is the parameter `buckets` for each order.

Edge cases: a null or blank text has no words and fails the fixed rules. Without any trusted
document no ratio exists and the fixed rules decide alone; a text too short for an order gets nothing
for it. An empty table gives one, and long texts are counted whole. Rows are judged one by one, so
repeated rows and null ids need no key; a null id is never trusted. All other columns of the
input stay as they are; one that has the name of a result is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from critiq.llm.rows import give_back, hold
from critiq.session import spread_rows, written

#: In Java patterns these are exactly the blank and U+0009 to U+000D.
BLANKS = r"\s+"
SYMBOLS = r"[#*$%&|<>]+"
BUCKETS = 1 << 14
ORDERS = (1, 2)
SMOOTHING = 4
UNITS = 10_000
#: What the number of an n-gram is multiplied by before the next word's is added.
STEP = 31
#: Sum of the orders' mean log-likelihood ratios, in units, below which a document is rejected.
THRESHOLD = -2_400
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*COUNTS, "base_failed", "ratio_units", "n_grams", "mean_units", "kept"]


def text_words(text: Column) -> Column:
    """The words between blanks; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def _word_numbers(words: Column, buckets: int) -> Column:
    return F.transform(words, lambda word: (F.crc32(word.cast("binary")) % buckets).cast("int"))


def _with_grams(words: DataFrame, orders: tuple[int, ...], buckets: int) -> DataFrame:
    """Add an array column `grams<k>_` with the buckets of all n-grams of order k to a table with `words_`.

    An n-gram is numbered from the one without its last word and the number of that word.
    """
    words = words.withColumn("grams1_", _word_numbers(F.col("words_"), buckets))
    for order in range(2, max(orders) + 1):
        count = F.greatest(F.size("words_") - (order - 1), F.lit(0))
        shorter, last = F.slice(f"grams{order - 1}_", F.lit(1), count), F.slice("grams1_", F.lit(order), count)
        words = words.withColumn(f"grams{order}_", F.zip_with(shorter, last, lambda a, b: (a * STEP + b) % buckets))
    return words


def text_counts(docs: DataFrame) -> DataFrame:
    """Add word array `words_` and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    to a table with a column `text`.

    Windows of five words are compared by a 64-bit hash within one document: two different
    windows of a document of 500 words pass for equal once in 10^14 documents.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    counted = docs.withColumns({"words_": text_words(F.col("text")), "lines_": lines})
    words = F.col("words_")
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    counted = counted.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "hashes_": F.coalesce(hashes, F.array().cast("array<bigint>")),
        }
    )
    seen_twice = F.size("hashes_") > F.size(F.array_distinct("hashes_"))
    keyed = F.transform("hashes_", lambda x, i: F.struct(x.alias("key"), i.alias("at")))
    counted = counted.withColumn("keyed_", F.when(seen_twice, F.sort_array(keyed)))
    is_key_at = lambda x, k: F.coalesce(x["key"] == F.get("keyed_", k)["key"], F.lit(False))
    repeated = F.filter("keyed_", lambda x, k: is_key_at(x, k - 1) | is_key_at(x, k + 1))
    places = F.sort_array(F.transform(repeated, lambda x: x["at"]))
    counted = counted.withColumn("at_", F.coalesce(places, F.array().cast("array<int>")))
    following = F.concat(F.slice("at_", 2, 2**30), F.array(F.lit(2**30)))
    covered = F.aggregate(
        F.zip_with("at_", following, lambda own, after: F.least(F.lit(WINDOW), after - own)),
        F.lit(0),
        lambda total, x: total + F.coalesce(x, F.lit(0)),
    )
    counted = counted.withColumn(
        "n_repeat_words", F.when(F.size("at_") > 0, covered).otherwise(F.lit(0)).cast("long")
    )
    return counted.drop("lines_", "hashes_", "keyed_", "at_")


def _plus(number: int) -> Callable[[Column], Column]:
    return lambda x: x + number


def _looked_up(table: Column) -> Callable[[Column, Column], Column]:
    """A function that adds the weight of an n-gram to a sum."""
    return lambda total, gram: total + F.get(table, gram)


def _bucket_counts(texts: DataFrame, orders: tuple[int, ...], buckets: int, name: str) -> DataFrame:
    """(bucket, count); the buckets of the k-th order start at k times `buckets`."""
    words = _with_grams(texts.select(text_words(F.col("text")).alias("words_")), orders, buckets)
    numbered = [F.transform(f"grams{order}_", _plus(k * buckets)) for k, order in enumerate(orders)]
    grams = words.select(F.explode_outer(F.concat(*numbered)).alias("bucket"))
    return grams.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias(name))


def gram_weights(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    orders: tuple[int, ...] = ORDERS,
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
) -> list[int]:
    """One log-likelihood ratio per bucket, in units of 1/10000, order after order.

    `trusted_ids` has the ids of the target documents in its only column. The result is
    bounded by `buckets` for each order. It is empty if no target document has an n-gram.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = trusted_ids.toDF("id").distinct().hint("shuffle_hash")  # one way at every size
    raw = _bucket_counts(spread_rows(texts), orders, buckets, "raw")
    target = _bucket_counts(texts.join(chosen, "id"), orders, buckets, "target")
    counts = written(raw.join(target, "bucket", "left").na.fill(0, ["target"]), "gram-counts")
    counts = counts.withColumn("order", F.floor(F.col("bucket") / buckets).cast("int"))
    sums = counts.groupBy("order").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    totals = {row["order"]: (row["raw"], row["target"]) for row in sums.collect()}  # a row for each order
    if not any(target for _, target in totals.values()):
        return []
    shares = [totals[k][1] / totals[k][0] if k in totals else 0.0 for k in range(len(orders))]
    share = F.get(F.array(*map(F.lit, shares)), F.col("order"))
    ratio = F.log((F.col("target") + float(smoothing)) / (F.col("raw") * share + float(smoothing)))
    unseen = 0  # a bucket without any n-gram of the corpus is never looked up
    weights = [unseen] * (buckets * len(orders))
    for row in counts.select("bucket", F.round(ratio * UNITS).cast("long").alias("weight")).collect():
        weights[row["bucket"]] = row["weight"]
    return weights


def score_quality(
    docs: DataFrame,
    trusted_ids: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    orders: tuple[int, ...] = ORDERS,
    buckets: int = BUCKETS,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """All rows and columns of `docs` with the counts, base_failed, ratio_units, n_grams, mean_units and kept.

    `ratio_units` is the sum of the weights of all n-grams, `mean_units` the sum of the orders' means,
    rounded down; a document is kept if it passes the fixed rules and that is not below `threshold`.
    """
    weights = gram_weights(docs, trusted_ids, id_col, text_col, orders, buckets)
    counted = text_counts(hold(spread_rows(docs), text=F.col(text_col)))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    counted = _with_grams(counted.withColumn("failed_", failed), orders, buckets)
    totals = {}
    for k, order in enumerate(orders):
        totals[f"units{order}_"] = F.lit(0).cast("long")
        if weights:
            table = F.from_json(F.lit(json.dumps(weights[k * buckets : (k + 1) * buckets])), "array<int>")
            totals[f"units{order}_"] = F.aggregate(f"grams{order}_", F.lit(0).cast("long"), _looked_up(table))
    scored = counted.withColumns(totals)
    units = [F.col(f"units{order}_") for order in orders]
    sizes = [F.size(f"grams{order}_").cast("long") for order in orders]
    means = [F.coalesce(F.try_divide(u, n), F.lit(0.0)) for u, n in zip(units, sizes)]
    scored = scored.withColumns(
        {
            "ratio_units": reduce(Column.__add__, units),
            "n_grams": reduce(Column.__add__, sizes),
            "mean_units": F.floor(reduce(Column.__add__, means)).cast("long"),
        }
    )
    # a filter on a verdict must not carry all these expressions down: it stops at the row number
    scored = scored.withColumn("row_", F.monotonically_increasing_id())
    scored = scored.withColumn("base_failed", F.col("failed_") & (F.col("row_") >= 0))
    kept = ~F.col("base_failed") & (F.col("mean_units") >= threshold)
    return give_back(scored.withColumn("kept", kept), docs, RESULTS)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids labelled as good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
