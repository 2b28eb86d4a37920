"""Steps for ``View.eduction``: each makes a function from DataFrame to DataFrame.

Positions travel along as hidden columns, so sampled and filtered rows keep
their original index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = ("_index", "_file", "_part")
Step = Callable[[DataFrame], DataFrame]


def _carried(df: DataFrame) -> list[str]:
    return [c for c in HIDDEN if c in df.columns]


def map_(*columns: Column) -> Step:
    """Each record to new columns, or to one value."""
    named = columns if len(columns) > 1 else None
    return lambda df: df.select(*(named or [columns[0].alias("value")]), *_carried(df))


def map_records(*columns: Column) -> Step:
    return lambda df: df.select(*columns, *_carried(df))


def filter_(condition: Column) -> Step:
    return lambda df: df.where(condition)


def remove(condition: Column) -> Step:
    return lambda df: df.where(~F.coalesce(condition, F.lit(False)))


def keep(value: Column) -> Step:
    """Values of an expression, nulls left out."""
    return lambda df: df.select(value.alias("value"), *_carried(df)).where("value is not null")


def cat(column: str = "value") -> Step:
    """Elements of a repeated value; null and empty ones give none."""
    return lambda df: df.select(F.explode(column).alias("value"), *_carried(df))


def mapcat(value: Column) -> Step:
    return lambda df: df.select(F.explode(value).alias("value"), *_carried(df))


def take(n: int) -> Step:
    return lambda df: df.limit(n)


def distinct() -> Step:
    return lambda df: df.drop(*HIDDEN).distinct()


def frequencies(column: str = "value") -> Step:
    return lambda df: df.groupBy(column).agg(F.count("*").alias("n"))
