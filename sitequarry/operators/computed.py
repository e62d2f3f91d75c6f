"""Columns computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with further columns, none of which exists yet.

    A filter on a plain computed column moves below it with the whole expression in place of the
    name, which for parsed JSON means another parse per mention. Here the columns come from a
    one-row generator, and filters stay above it.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return frame.select("*", F.inline_outer(F.array(row)))
