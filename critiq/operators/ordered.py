"""Running totals, positions and exact quantiles over a whole table.

A window without a partition would sort everything in one task. Here the order
is cut into ranges at approximate quantiles; each range is one window
partition, and the ranges are tied together by a small table of range totals.
The cut points decide only how even the ranges are, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from critiq.session import range_count, written

_RANGE = "_range"


def _with_range(df: DataFrame, order_by: str, ranges: int) -> DataFrame:
    """Add the number of the range a value falls in, by cut points fixed up front."""
    shares = [i / ranges for i in range(1, ranges)]
    accuracy = max(1000, 4 * ranges)  # bounds the sketches that meet in one task
    cuts = df.agg(F.percentile_approx(order_by, shares, accuracy)).first()[0]
    cuts = sorted({float(cut) for cut in cuts or [] if math.isfinite(cut)})
    if not cuts:
        return df.withColumn(_RANGE, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=splits, inputCol=order_by, outputCol=_RANGE).transform(df)


def running_totals(
    df: DataFrame,
    order_by: str,
    totals: Sequence[str],
    within: Sequence[str] = (),
    carry_next: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
    write_first: bool = True,
) -> DataFrame:
    """Add cum_<total> up to and including each row, all_<total> of the whole group, and
    next_<column> of the row after it.

    Expects one row per (within, order_by), and neither nulls nor NaN: count equal values
    together first, so that a frequent value is one row. Works within
    each group of `within`; a large group is cut into ranges like the whole.
    The table is read several times, so it is written first; switch that off
    for a table that is cheap to read as it is.
    """
    df = written(df, "ordered") if write_first else df
    direction = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    at_start = F.max_by if descending else F.min_by
    ranged = _with_range(df, order_by, ranges or range_count(df.sparkSession, df.count()))

    per_range = ranged.groupBy(*within, _RANGE).agg(
        *[F.sum(total).alias(f"_sum_{total}") for total in totals],
        *[at_start(c, order_by).alias(f"_first_{c}") for c in carry_next],
    )
    # One row per range and group: this window stays small whatever the table.
    in_order = W.partitionBy(*within).orderBy(direction(_RANGE))
    before = in_order.rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        *within,
        _RANGE,
        *[
            F.coalesce(F.sum(f"_sum_{total}").over(before), F.lit(0)).alias(f"_before_{total}")
            for total in totals
        ],
        *[F.sum(f"_sum_{total}").over(W.partitionBy(*within)).alias(f"all_{total}") for total in totals],
        *[F.lead(f"_first_{c}").over(in_order).alias(f"_after_{c}") for c in carry_next],
    )

    inside = W.partitionBy(*within, _RANGE).orderBy(direction(order_by))
    so_far = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.select(
        "*",
        *[F.sum(total).over(so_far).alias(f"_in_{total}") for total in totals],
        *[F.lead(c).over(inside).alias(f"_next_{c}") for c in carry_next],
    )
    joined = local.join(offsets, [*within, _RANGE])
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{t}") + F.col(f"_before_{t}")).alias(f"cum_{t}") for t in totals],
        *[f"all_{t}" for t in totals],
        *[F.coalesce(f"_next_{c}", f"_after_{c}").alias(f"next_{c}") for c in carry_next],
    )


def row_positions(df: DataFrame, key: str, name: str = "position") -> DataFrame:
    """Add the zero-based position of each row in the order of a unique numeric key."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    numbered = running_totals(ones, key, ["_one"], write_first=False)
    return numbered.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one", "all__one")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their counts and running counts; nulls and NaN are left out."""
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    counts = df.filter(known).groupBy(value).agg(F.count("*").alias("n"))
    return running_totals(counts, value, ["n"])


def quantile_columns(value: str, probabilities: Sequence[float]) -> list[Column]:
    """Aggregates over value_counts: exact quantiles, linear between neighbouring ranks."""

    def at_rank(rank: Column) -> Column:
        return F.min(F.when(F.col("cum_n") > rank, F.col(value)))

    columns = []
    for p in probabilities:
        place = (F.col("all_n") - 1) * F.lit(float(p))
        low, high = at_rank(F.floor(place)), at_rank(F.ceil(place))
        columns.append(low + (high - low) * F.max(place - F.floor(place)))
    return columns
