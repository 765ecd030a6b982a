"""Size checks that come before anything small is put into a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

# A vocabulary up to this many entries becomes a literal of the plan; a larger
# one is joined instead.
LITERAL_ENTRIES = 1000


def rows_if_small(df: DataFrame, bound: int = LITERAL_ENTRIES) -> list[Row] | None:
    """All rows when there are at most `bound`, else None; never fetches more than bound + 1."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None
