"""The first rows of many files, without reading the rest of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

#: Above so many scan tasks the table of file blocks is joined instead of broadcast.
BROADCAST_BLOCKS = 100_000
#: Up to so many rows a count stops early in every task; more rows are counted whole.
EARLY_STOP = 1_000_000

Reader = Callable[[Sequence[str]], DataFrame]


def file_positions(rows: DataFrame, name: str = "position", located: bool = False) -> DataFrame:
    """Add the zero-based position of rows as read from files, in the order of path and offset.

    Numbering within a file block comes with the scan; only the block sizes are
    aggregated. With `located`, also the path of the file and the number of the row in it, from 1.
    """
    blocks = rows.rdd.getNumPartitions()  # of a scan: a task reads at least one block
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
    ).withColumn("_id", F.monotonically_increasing_id())
    sizes = placed.groupBy("_path", "_start").agg(
        F.count("*").alias("_rows"), F.min("_id").alias("_first")
    )
    # One row per file block.
    earlier = W.orderBy("_path", "_start").rowsBetween(W.unboundedPreceding, -1)
    of_file = W.partitionBy("_path").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "_path",
        "_start",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.coalesce(F.sum("_rows").over(of_file), F.lit(0)).alias("_before_in_file"),
    )
    # one row per file block: a few bytes for every block of a whole file system directory
    offsets = F.broadcast(offsets) if blocks <= BROADCAST_BLOCKS else offsets
    in_block = F.col("_id") - F.col("_first")
    numbered = placed.join(offsets, ["_path", "_start"]).withColumn(name, in_block + F.col("_before"))
    if located:
        numbered = numbered.withColumns({"file": F.col("_path"), "line_number": in_block + F.col("_before_in_file") + 1})
    return numbered.drop("_path", "_start", "_id", "_first", "_before", "_before_in_file")


def files_in_order(spark: SparkSession, path: str) -> list[str]:
    """The files a path stands for, in the order that positions follow; none of them is opened."""
    listed = spark.read.format("binaryFile").load(path)
    located = listed.select("path", F.col("_metadata.file_path").alias("uri"))
    return [row["path"] for row in located.orderBy("uri").collect()]


def leading_files(files: Sequence[str], read: Reader, limit: int) -> tuple[list[str], str | None, int]:
    """Files whose rows are all among the first `limit`, the file after them, and how many of its rows are.

    Groups of files are counted in order. A group that stays below the limit is taken and the next
    one is twice as large; in one that reaches it, half as many files are looked at, down to
    the one in which the limit falls. So at most about twice the files that are needed are counted,
    and what lies behind them is never opened.
    """
    whole: list[str] = []
    at, step, left = 0, 1, limit
    while at < len(files):
        group = files[at : at + step]
        rows = read(group)
        found = (rows.limit(left) if left <= EARLY_STOP else rows).count()
        if found < left:
            whole += group
            at, step, left = at + len(group), 2 * step, left - found
        elif len(group) == 1:
            return whole, group[0], left
        else:
            step = (len(group) + 1) // 2
    return whole, None, 0


def _first_of_file(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows of one file; a file read by one task is left where the limit is reached."""
    if rows.rdd.getNumPartitions() == 1:
        return rows.limit(limit)
    return file_positions(rows, "_place").where(F.col("_place") < limit).drop("_place")


def first_rows(spark: SparkSession, path: str, read: Reader, limit: int | None) -> DataFrame:
    """The first rows of the files of a path, in the order of path and offset; all for None or 0."""
    if not limit:
        return read([path])
    whole, last, left = leading_files(files_in_order(spark, path), read, limit)
    if last is None:
        return read(whole or [path])
    first = _first_of_file(read([last]), left)
    return read(whole).unionByName(first) if whole else first


def first_files(spark: SparkSession, path: str, read: Reader, limit: int | None) -> list[str]:
    """The files that hold the first rows; the path itself for None or 0."""
    if not limit:
        return [path]
    whole, last, _ = leading_files(files_in_order(spark, path), read, limit)
    return whole + [last] if last else whole or [path]


def first_positions(
    spark: SparkSession, path: str, read: Reader, limit: int | None, name: str = "position"
) -> DataFrame:
    """The first rows of the files of a path with their position; all for None or 0.

    A last file read by one task is left where the limit is reached, however long it is.
    """
    if not limit:
        return file_positions(read([path]), name)
    whole, last, left = leading_files(files_in_order(spark, path), read, limit)
    if last is None:
        return file_positions(read(whole or [path]), name)
    first = read([last])
    if first.rdd.getNumPartitions() == 1:
        first = first.withColumn(name, F.monotonically_increasing_id()).limit(left)  # of one task: 0, 1, ...
    else:
        first = file_positions(first, name).where(F.col(name) < left)
    first = first.withColumn(name, F.col(name) + F.lit(limit - left))
    return file_positions(read(whole), name).unionByName(first) if whole else first


def first_lines(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    """The first lines of text files."""
    return first_rows(spark, path, lambda paths: spark.read.text(list(paths)), limit)
