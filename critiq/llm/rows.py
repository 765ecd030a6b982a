"""Keeping a caller's columns apart from an operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a missing id where ids are ordered: before all others.
NO_ID = -(2**63)


def hold(docs: DataFrame, **named: Column) -> DataFrame:
    """All columns of the caller under hidden names, beside the named columns."""
    kept = [F.col(f"`{c}`").alias(f"held_{i}_") for i, c in enumerate(docs.columns)]
    return docs.select(*kept, *[c.alias(n) for n, c in named.items()])


def give_back(held: DataFrame, docs: DataFrame, results: list[str]) -> DataFrame:
    """The caller's columns and the results; a result takes the place of a column of the same name."""
    taken = {c.lower() for c in results}
    kept = [
        F.col(f"held_{i}_").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken
    ]
    return held.select(*kept, *results)
