"""Random splits of an exact size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from critiq import fixed_values as fixed

# Hexadecimal digits by which each round looks closer, and rows that are few enough to be ordered.
_DIGITS = 3
_FEW_ROWS = 4096


def train_test_split_exact(
    df: DataFrame, key: Sequence[str], test_size: int, seed: int = fixed.SEED, name: str = "split"
) -> DataFrame:
    """Add 'test' to exactly test_size rows and 'train' to the others.

    `key` identifies a row. Rows are ordered by a hash of seed and key. Each round
    counts rows by the next digits of the hash, at most 16^3 counts, and tells in which of
    them the last test row lies, until few rows are left to be ordered. All rows are
    then decided by comparing their hash with that row's.
    """
    parts = [F.col(k).cast("string") for k in key]
    if len(parts) > 1:  # quoted, so that no two keys look alike; a null part is written as such
        parts = [F.to_json(F.array(*parts))]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    last_test = _kth_hash(df.select(digest.alias("_hash")), test_size)
    if last_test is None:
        return df.withColumn(name, F.lit("test" if test_size > 0 else "train"))
    return df.withColumn(name, F.when(digest <= last_test, "test").otherwise("train"))


def _kth_hash(hashed: DataFrame, k: int) -> str | None:
    """The k-th smallest hash; none if there are fewer or k is 0."""
    if k <= 0:
        return None
    prefix, left = "", k
    while True:
        inside = hashed.where(F.col("_hash").startswith(prefix))
        digits = F.left("_hash", F.lit(len(prefix) + _DIGITS)).alias("_digits")
        counts = inside.groupBy(digits).agg(F.count("*").alias("n")).orderBy("_digits").collect()
        for row in counts:
            if row["n"] >= left:
                break
            left -= row["n"]
        else:
            return None
        prefix = row["_digits"]
        if row["n"] <= _FEW_ROWS or len(prefix) >= 32:
            first = hashed.where(F.col("_hash").startswith(prefix)).orderBy("_hash").limit(left)
            return first.agg(F.max("_hash")).first()[0]
