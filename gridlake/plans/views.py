"""Flat, engine-neutral output for queries whose result is compared or exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _plain(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DecimalType):
        return column.cast("double").alias(field.name)
    if isinstance(field.dataType, T.DateType):
        return column.cast("string").alias(field.name)
    if isinstance(field.dataType, (T.ShortType, T.IntegerType)):
        return column.cast("bigint").alias(field.name)
    return column


def plain(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, dates as text and whole numbers as 64 bit."""
    return rows.select(*[_plain(f) for f in rows.schema.fields])


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value.cast("double"), digits)


def stats_columns(struct: str, prefix: str) -> list[Column]:
    """The fields of a descriptive-statistics struct as ``prefix_*`` columns at six digits."""
    fields = ("mean", "median", "stddev", "minimum", "maximum", "q1", "q3", "iqr")
    return [
        F.col(f"{struct}.sample_size").cast("bigint").alias(f"{prefix}_n"),
        *[rounded(F.col(f"{struct}.{f}")).alias(f"{prefix}_{f}") for f in fields],
    ]


def joined(values: Column) -> Column:
    """A list as comma-separated text."""
    return F.array_join(values.cast("array<string>"), ",")
