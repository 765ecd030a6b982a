"""Word-list files: `word|category|severity` or `phrase, category, severity` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from critiq import fixed_values as fixed
from critiq.sources.limits import file_positions
from critiq.sources.jsonl import Scan


def read_word_lists(spark: SparkSession, folder: str, pattern: str = "*.txt") -> Scan:
    """Entries of all list files, named after the file; comments and blank lines are skipped.

    A file that uses the bar anywhere is separated by bars, else by commas. Positions follow the
    order of paths and lines, however the files are split.
    """
    raw = spark.read.option("pathGlobFilter", pattern).text(folder)
    named = raw.select("value", F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("list_name"), "_metadata")
    lines = (
        file_positions(named, located=True)
        .select("list_name", "position", F.trim("value").alias("line"), "file", "line_number")
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    )
    separators = lines.groupBy("list_name").agg(
        F.max(F.contains("line", F.lit("|"))).alias("_bars")
    )
    parts = F.transform(
        F.when(F.col("_bars"), F.split("line", r"\|")).otherwise(F.split("line", ",")),
        lambda part: F.trim(part),
    )
    read = lines.join(separators, "list_name").withColumn("_parts", parts).withColumn(
        "severity", F.get("_parts", F.lit(2)).try_cast("int")
    )
    good = F.coalesce((F.size("_parts") == 3) & F.col("severity").isNotNull(), F.lit(False))
    entries = read.filter(good).select(
        "list_name",
        F.get("_parts", F.lit(0)).alias("word"),
        F.get("_parts", F.lit(1)).alias("category"),
        "severity",
        "position",
    )
    reason = F.when(F.size("_parts") != 3, "not three parts").otherwise("severity")
    return Scan(entries, read.filter(~good).select("list_name", "line", reason.alias("reason"), "file", "line_number"))


def speech_patterns(spark: SparkSession, folder: str | None = None, pattern: str = "*.txt") -> Scan:
    """The speech-pattern lists of a folder, or the built-in list."""
    if folder is not None:
        return read_word_lists(spark, folder, pattern)
    lines = [line.split(", ") for line in fixed.SPEECH_PATTERNS.strip().splitlines()]
    rows = [("speech", word, category, int(severity), at) for at, (word, category, severity) in enumerate(lines)]
    kinds = "list_name string, word string, category string, severity int, position long"
    empty = spark.createDataFrame([], "list_name string, line string, reason string, file string, line_number long")
    return Scan(spark.createDataFrame(rows, kinds), empty)


def list_names(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """Names of all list files, also of those without a usable entry."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select(F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1).alias("list_name"))
        .distinct()
    )
