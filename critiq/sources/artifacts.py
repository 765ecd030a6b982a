"""Files that training and evaluation runs leave behind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LISTS = "train_loss array<double>, train_acc array<double>, val_loss array<double>, val_acc array<double>"


def _folder_of(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_histories(spark: SparkSession, folder: str, pattern: str = "training_history.json") -> DataFrame:
    """Training histories, one row per run folder with its lists per epoch."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(folder, schema=_LISTS, multiLine=True)
        .select(_folder_of("_metadata.file_path").alias("checkpoint"), "*")
    )


def history_compare(histories: DataFrame) -> DataFrame:
    """Loss and accuracy after the last epoch of each run."""
    last = lambda name: F.try_element_at(name, F.lit(-1))
    return histories.select(
        "checkpoint", last("train_loss").alias("final_loss"), last("train_acc").alias("final_acc")
    )


def read_evaluations(spark: SparkSession, folder: str, pattern: str = "evaluation_results.json") -> DataFrame:
    """Evaluation results, one row per run folder."""
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .json(folder, multiLine=True)
        .select(_folder_of("_metadata.file_path").alias("checkpoint"), "*")
    )


def latest_artifact(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path and folder of the file changed last; ties go to the larger path."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "modificationTime")
    )
    newest = files.agg(
        F.max_by("path", F.struct("modificationTime", "path")).alias("path")
    )
    return newest.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report, history or result table as JSON lines."""
    df.write.mode(mode).json(path)


def write_held_out(
    df: DataFrame, path: str, columns: Sequence[str] = ("text", "label"), mode: str = "errorifexists"
) -> None:
    """The held-out rows with text and label, for a later evaluation."""
    df.select(*columns).write.mode(mode).parquet(path)
