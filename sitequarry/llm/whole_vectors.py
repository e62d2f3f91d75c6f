"""Vectors as rows of whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_vectors(vectors: DataFrame, scale: int, shift: int = 0, limit: float = 2.0**53, **columns: Column) -> tuple[DataFrame, int]:
    """x, an array of floor(scale * component) + shift, and `columns`, for the rows whose vector is usable; and the length of x.

    Not usable: null, empty, with a null or non-finite component, or with one that reaches `limit` once scaled, beyond which
    whole numbers would not be exact. Vectors can only be compared with those of their length: if lengths differ, the rows of the commonest one
    stay (of the longest, if several are equally common).
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda c: c.isNotNull() & (F.abs(c * scale) < limit))
    rows = vectors.select(v.alias("v"), *(c.alias(k) for k, c in columns.items())).where((F.size("v") > 0) & fine)
    # a row per length
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 1
    x = F.transform("v", lambda c: F.floor(c * scale) + F.lit(shift).cast("long"))
    return rows.where(F.size("v") == d).select(x.alias("x"), *columns), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
