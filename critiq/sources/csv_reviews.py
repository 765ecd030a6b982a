"""Review CSV files with whatever columns they have, brought to one shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from critiq import fixed_values as fixed
from critiq.operators.ordered import row_positions
from critiq.sources import limits


def resolve_csv(spark: SparkSession, path: str, fallback_folder: str) -> str:
    """The path if it can be read, else the first CSV file by name in the folder."""
    try:
        spark.read.text(path)
        return path
    except AnalysisException:
        files = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(fallback_folder)
        )
        found = files.agg(F.min("path")).first()[0]
        if found is None:
            raise FileNotFoundError(f"no CSV files in {fallback_folder}") from None
        return found


def _null_missing(rows: DataFrame) -> DataFrame:
    missing = list(fixed.CSV_MISSING)
    return rows.withColumns({c: F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`")) for c in rows.columns if c != "position"})


def _reader(spark: SparkSession, path: str, limit: int | None) -> limits.Reader:
    """Reads CSV files; with a limit the first file names the columns of all."""

    def read(paths: Sequence[str], schema: StructType | None = None) -> DataFrame:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.csv(list(paths), header=True, multiLine=True, escape='"')

    if not limit:
        return read
    files = limits.files_in_order(spark, path)
    schema = read(files[:1] or [path]).schema or read([path]).schema
    return lambda paths: read(paths, schema)


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """All columns as text, quoted line breaks kept, cells that mean 'missing' as null.

    With a limit, the first rows in the order of path and offset; files behind them are not read.
    """
    return _null_missing(limits.first_rows(spark, path, _reader(spark, path, limit), limit))


def _rating(on_bad: str) -> Column:
    number = F.col("rating").try_cast("double")
    filled = F.coalesce(number, F.lit(0.0))
    if on_bad == "zero":
        return filled
    bad = F.col("rating").isNotNull() & number.isNull()
    return F.when(bad, F.raise_error(F.concat(F.lit("rating is no number: "), "rating")).cast("double")).otherwise(filled)


def normalize_reviews(
    rows: DataFrame, key: str | None = None, on_bad: str = "fail", position: str | None = None
) -> DataFrame:
    """Title, text, rating and the generated columns that later steps expect.

    Rows are numbered in the order of `key`, a unique numeric column, or by an
    existing `position` column.
    """
    renames = {old: new for old, new in fixed.CSV_RENAMES.items() if old in rows.columns}
    named = rows.withColumnsRenamed(renames)
    if position is None:
        if key is None:
            raise ValueError("name a unique key or a position column")
        position = "_position"
        named = row_positions(named, key, position)

    def text(column: str) -> Column:
        return F.coalesce(column, F.lit("")) if column in named.columns else F.lit("")

    rating = _rating(on_bad) if "rating" in named.columns else F.lit(0.0)
    number = F.col(position).cast("string")
    return named.select(
        text("title").alias("title"),
        text("text").alias("text"),
        rating.alias("rating"),
        F.concat(F.lit("book_"), number).alias("asin"),
        F.concat(F.lit("book_"), number).alias("parent_asin"),
        F.concat(F.lit("user_"), number).alias("user_id"),
        F.lit(0).alias("helpful_votes"),
        F.lit(0).alias("sort_timestamp"),
        F.lit(False).alias("verified_purchase"),
    )


def load_reviews(
    spark: SparkSession,
    path: str,
    limit: int | None = None,
    fallback_folder: str | None = None,
    on_bad: str = "fail",
) -> DataFrame:
    """Review CSV in the common shape, rows numbered in file order; the first `limit` of them if given."""
    if fallback_folder is not None:
        path = resolve_csv(spark, path, fallback_folder)
    placed = limits.first_positions(spark, path, _reader(spark, path, limit), limit)
    return normalize_reviews(_null_missing(placed), on_bad=on_bad, position="position")
