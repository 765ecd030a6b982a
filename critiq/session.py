"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Of a key that stands twice in a JSON object the last value counts.
REPEATED_KEYS = ("spark.sql.variant.allowDuplicateKeys", "true")


def allow_repeated_keys(spark: SparkSession) -> None:
    """Read JSON alike in every session, also in one that another program has built."""
    spark.conf.set(*REPEATED_KEYS)


def build_session(app_name: str = "critiq", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; other settings from the cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(*REPEATED_KEYS)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a temporary one only in local mode without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="critiq-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for written intermediate tables, in the cluster's shared folder."""
    return os.path.join(_shared_folder(spark), f"critiq-{name}-{uuid.uuid4().hex}")


#: Rows that one range of ordered work holds, about.
ROWS_PER_RANGE = 1_000_000


def range_count(spark: SparkSession, rows: int) -> int:
    """How many ranges ordered work on so many rows is cut into: one per shuffle partition at least."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))


#: An input of fewer splits is dealt out before costly work on its rows.
FEW_SPLITS = 8


def spread_rows(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """Deal the rows of a small or unsplittable input to all cores.

    `scan` is what `df` reads, where more than reading has happened since.

    Work per row on text is worth a shuffle only when the scan would leave
    nearly all cores idle; an input of several splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if (scan or df).rdd.getNumPartitions() >= min(cores, FEW_SPLITS) else df.repartition(cores)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several passes need, and read it from there.

    Costly work on text is then done once, and a lost executor costs no more
    than the passes themselves.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[read] = path
    return read


#: Where the tables lie that `written` has returned.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; others are left alone."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            remove_path(table.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this package's own, in whatever file system it lies."""
    if not os.path.basename(path).startswith("critiq-"):
        raise ValueError(f"not a folder of this package: {path}")
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
