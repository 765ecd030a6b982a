"""Book and review files: one JSON object per line, gzip or plain.

Each line is parsed once into a variant. A missing key takes its default, an
explicit null where a number or list is needed makes the line unusable, and a
number may also be written as a string. Of a key that stands twice the last value
counts; NaN, Infinity and -Infinity are numbers. In a line with such a number, text that
looks like one between a colon and a comma gets quotes as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from critiq.session import allow_repeated_keys, spread_rows
from critiq.sources import limits

#: A value that is one of the names Python's JSON writer uses for numbers beyond JSON.
NOT_FINITE = r"([:\[,]\s*)(NaN|-?Infinity)(?=\s*[,\]}])"


class Scan(NamedTuple):
    """Usable rows, and the lines that were not usable with the reason, the file and the number in it, from 1."""

    rows: DataFrame
    rejects: DataFrame


def write_rejects(scan: Scan, path: str, mode: str = "errorifexists") -> None:
    """The rejects as JSON lines, one folder a reason, so that each kind can be mended and read again."""
    scan.rejects.write.mode(mode).partitionBy("reason").json(path)


def _parsed(line: Column) -> Column:
    """The line as a variant; numbers that JSON has no form for are taken from their names."""
    named = F.regexp_replace(line, NOT_FINITE, r'$1"$2"')
    return F.coalesce(F.try_parse_json(line), F.try_parse_json(named))


def _lines(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    """The lines, dealt out: a gzip file is one split, and parsing costs more than dealing."""
    # The limit counts lines in file order, unusable ones included; 0 means all.
    return spread_rows(limits.first_lines(spark, path, limit))


def _located_lines(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    """The same lines with their file and number; what they cost more is paid only where rejects are asked for."""

    def read(paths: Sequence[str]) -> DataFrame:
        return spark.read.text(list(paths))

    scan = read(limits.first_files(spark, path, read, limit))
    lines = limits.file_positions(scan, "_place", located=True)
    return spread_rows(lines.where(F.col("_place") < limit) if limit else lines, scan)


def _items(lines: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The lines with the wanted fields as variants: null if missing, variant null if null."""
    parsed = lines.withColumn("_json", _parsed(F.trim("value")))
    shape = ", ".join(f"{name}: variant" for name in fields)
    taken = parsed.withColumn("_item", F.try_variant_get("_json", "$", f"struct<{shape}>"))
    return taken.select(
        *lines.columns,
        F.col("_json").isNull().alias("_not_json"),
        F.col("_item").isNull().alias("_not_object"),
        *[F.col(f"_item.{name}").alias(name) for name in fields],
    )


def _scan(
    spark: SparkSession,
    path: str,
    limit: int | None,
    fields: Sequence[str],
    reason: Column,
    columns: Sequence[Column],
    otherwise: Column | None = None,
) -> Scan:
    """Usable rows and rejects.

    Each line yields a list of one row or of none. A filter would do, but Spark
    would move it below the parsing and parse every line several times over.
    """
    allow_repeated_keys(spark)
    judged = _items(_lines(spark, path, limit), fields).withColumn("reason", reason)
    usable = F.when(F.col("reason").isNull(), F.array(F.struct(*columns)))
    if otherwise is not None:
        usable = usable.when(F.col("reason") != "not JSON", otherwise)
    located = _items(_located_lines(spark, path, limit), fields).withColumn("reason", reason)
    reject = F.when(F.col("reason").isNotNull(), F.array(F.struct("value", "reason", "file", "line_number")))
    return Scan(judged.select(F.inline(usable)), located.select(F.inline(reject)))


def _kind(name: str) -> Column:
    """The JSON kind of a field, such as STRING, ARRAY or VOID for null; null if missing."""
    return F.regexp_extract(F.schema_of_variant(name), r"^(\w+)", 1)


def _as_text(value: Column) -> Column:
    """A scalar as text, anything nested as JSON, null as null."""
    scalar = F.try_variant_get(value, "$", "string")
    return F.when(~F.is_variant_null(value), F.coalesce(scalar, F.to_json(value)))


def _text(name: str) -> Column:
    return F.when(F.col(name).isNull(), F.lit("")).otherwise(_as_text(F.col(name)))


def _number(name: str, kind: str) -> Column:
    """The number, its default 0 when missing; null when there is none to be had."""
    given = F.try_variant_get(name, "$", kind)
    return F.when(F.col(name).isNull(), F.lit(0).cast(kind)).otherwise(given)


def _strings(name: str) -> Column:
    texts = F.transform(F.try_variant_get(name, "$", "array<variant>"), _as_text)
    return F.when(F.col(name).isNull(), F.array().cast("array<string>")).otherwise(texts)


def _string_map(name: str) -> Column:
    given = F.try_variant_get(name, "$", "map<string,variant>")
    texts = F.transform_values(given, lambda _, value: _as_text(value))
    return F.when(F.col(name).isNull(), F.create_map().cast("map<string,string>")).otherwise(texts)


def _first_reason(reasons: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(failed, F.lit(reason)) for reason, failed in reasons.items()])


def _falsy(name: str) -> Column:
    empty = F.to_json(name).isin("null", "{}", "[]", '""', "0", "0.0", "false")
    return F.coalesce(empty, F.lit(True))


def _characters(name: str) -> Column:
    return F.split(F.try_variant_get(name, "$", "string"), "")


_BOOK_FIELDS = (
    "parent_asin", "title", "subtitle", "author", "description", "categories", "price", "store",
    "main_category", "images", "features", "bought_together", "average_rating", "rating_number",
    "details",
)
_REVIEW_FIELDS = (
    "asin", "reviewerID", "reviewerName", "reviewText", "summary", "overall", "verified",
    "reviewTime", "unixReviewTime", "helpful", "style", "vote",
)


def read_books(spark: SparkSession, path: str, limit: int | None = None) -> Scan:
    """Book metadata with 15 columns; unusable lines go to the rejects.

    A description is a list of strings, or a string that counts as the list of
    its characters; an image is the first of a list or the first character.
    """
    as_list = F.try_variant_get("description", "$", "array<variant>")
    only_strings = F.forall(as_list, lambda part: F.schema_of_variant(part) == "STRING")
    described = F.col("description").isNull() | (_kind("description") == "STRING") | only_strings
    reason = _first_reason(
        {
            "not a JSON object": F.col("_not_object"),
            "author": ~_falsy("author") & (_kind("author") != "OBJECT"),
            "description": ~F.coalesce(described, F.lit(False)),
            "price": _number("price", "double").isNull(),
            "images": ~_falsy("images") & ~_kind("images").isin("ARRAY", "STRING"),
            "average_rating": _number("average_rating", "double").isNull(),
            "rating_number": _number("rating_number", "int").isNull(),
        }
    )
    name = F.try_variant_get("author", "$.name", "variant")
    image_list = F.try_variant_get("images", "$", "array<variant>")
    columns = [
        _text("parent_asin").alias("asin"),
        _text("title").alias("title"),
        _text("subtitle").alias("subtitle"),
        F.when(_falsy("author") | name.isNull(), F.lit("")).otherwise(_as_text(name)).alias("author"),
        F.array_join(
            F.when(_kind("description") == "STRING", _characters("description")).otherwise(
                _strings("description")
            ),
            " ",
        ).alias("description"),
        _strings("categories").alias("categories"),
        _number("price", "double").alias("price"),
        _text("store").alias("store"),
        _text("main_category").alias("main_category"),
        F.when(_kind("images") == "STRING", F.get(_characters("images"), F.lit(0)))
        .otherwise(_as_text(F.get(image_list, F.lit(0))))
        .alias("image_url"),
        _strings("features").alias("features"),
        _strings("bought_together").alias("bought_together"),
        _number("average_rating", "double").alias("average_rating"),
        _number("rating_number", "int").alias("rating_count"),
        _string_map("details").alias("details"),
    ]
    return _scan(spark, path, limit, _BOOK_FIELDS, reason, columns)


def read_reviews(
    spark: SparkSession, path: str, limit: int | None = None, on_bad: str = "fail"
) -> Scan:
    """Reviews with 12 columns.

    Lines that are not JSON go to the rejects. A line whose numbers cannot be
    read stops the job with on_bad='fail' and goes to the rejects with 'drop'.
    """
    if on_bad not in ("fail", "drop"):
        raise ValueError("on_bad is 'fail' or 'drop'")
    reason = _first_reason(
        {
            "not JSON": F.col("_not_json"),
            "not a JSON object": F.col("_not_object"),
            "overall": _number("overall", "double").isNull(),
            "unixReviewTime": _number("unixReviewTime", "long").isNull(),
        }
    )
    helpful = F.when(F.col("helpful").isNull(), F.array(F.lit(0), F.lit(0))).otherwise(
        F.try_variant_get("helpful", "$", "array<int>")
    )
    verified = F.when(F.col("verified").isNull(), F.lit(False)).otherwise(
        F.try_variant_get("verified", "$", "boolean")
    )
    texts = ("asin", "reviewerID", "reviewerName", "reviewText", "summary")
    columns = [
        *[_text(name).alias(name) for name in texts],
        _number("overall", "double").alias("overall"),
        verified.alias("verified"),
        _text("reviewTime").alias("reviewTime"),
        _number("unixReviewTime", "long").alias("unixReviewTime"),
        helpful.alias("helpful"),
        _string_map("style").alias("style"),
        _text("vote").alias("vote"),
    ]
    stop = F.raise_error(F.concat(F.lit("unusable review, "), "reason", F.lit(": "), "value"))
    return _scan(spark, path, limit, _REVIEW_FIELDS, reason, columns, stop if on_bad == "fail" else None)
