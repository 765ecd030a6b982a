"""Functions over arrays of numbers: logits, vectors, bins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def argmax(logits: Column) -> Column:
    """Zero-based index of the largest value; the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    """Class probabilities; the largest value is subtracted first, so no overflow."""
    # A one-element array binds the value computed inside it for repeated use.
    powers = F.transform(
        F.array(F.array_max(logits)),
        lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top.cast("double"))),
    )[0]
    return F.transform(
        F.array(powers),
        lambda p: F.transform(F.array(array_sum(p)), lambda total: F.transform(p, lambda x: x / total)),
    )[0][0]


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def mean_squared_difference(left: Column, right: Column) -> Column:
    """Mean of squared element differences, the reconstruction error of a row."""
    squares = F.zip_with(
        left, right, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0))
    )
    return array_sum(squares) / F.size(left)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Zero-based bin of equal width between low and high; the last bin is closed.

    Division can land one bin off at an edge, so the edges themselves decide.
    """
    width = (high - low) / bins
    guess = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    below = (value < low + guess * width).cast("long")
    above = ((guess < bins - 1) & (value >= low + (guess + 1) * width)).cast("long")
    return F.when(high == low, F.lit(0)).otherwise(guess - below + above).cast("int")
