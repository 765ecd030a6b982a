"""What fields JSON records have and what is in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from critiq.session import allow_repeated_keys
from critiq.sources.limits import first_lines


def read_lines(spark: SparkSession, path: str, sample_size: int | None = None) -> DataFrame:
    """Lines of a file, the first sample_size of them if given."""
    return first_lines(spark, path, sample_size)


def json_fields(records: DataFrame, column: str = "value", key: tuple[str, ...] = ()) -> DataFrame:
    """One row per field of each record that is a JSON object; others are skipped."""
    allow_repeated_keys(records.sparkSession)
    fields = F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>")
    return records.select(*key, F.explode(fields).alias("field", "item"))


def value_kind(item: Column) -> Column:
    """list, dict, string, number, boolean or null."""
    kind = F.schema_of_variant(item)
    return (
        F.when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), "dict")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )


def json_profile(records: DataFrame, column: str = "value") -> DataFrame:
    """Fields in order of name, with how often each kind of value occurs."""
    return (
        json_fields(records, column)
        .groupBy("field", value_kind(F.col("item")).alias("value_kind"))
        .agg(F.count("*").alias("n"))
        .orderBy("field", "value_kind")
    )


def value_summary(item: Column) -> Column:
    """Size of a list or dict, the first 100 characters of a long string, else the value."""
    kind = value_kind(item)
    text = F.try_variant_get(item, "$", "string")
    json = F.to_json(item)
    length = F.json_array_length(json).cast("string")
    keys = F.size(F.json_object_keys(json)).cast("string")
    return (
        F.when(kind == "list", F.concat(F.lit("List with "), length, F.lit(" items")))
        .when(kind == "dict", F.concat(F.lit("Dict with "), keys, F.lit(" keys")))
        .when(
            (kind == "string") & (F.length(text) > 100),
            F.concat(F.left(text, F.lit(100)), F.lit("...")),
        )
        .otherwise(F.coalesce(text, json))
    )


def json_value_summary(
    records: DataFrame, column: str = "value", key: tuple[str, ...] = ()
) -> DataFrame:
    """Each field of each record with a short form of its value."""
    return json_fields(records, column, key).select(
        *key, "field", value_summary(F.col("item")).alias("summary")
    )
