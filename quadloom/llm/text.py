"""Column expressions on words, all inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, although body may use it often or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column, zero: Column | None = None) -> Column:
    return F.aggregate(values, F.lit(0.0) if zero is None else zero, lambda a, x: a + x)


def words(text: Column) -> Column:
    """Words of a text in order: maximal runs of anything but ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def upto(n: Column) -> Column:
    """0 to n - 1; empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
