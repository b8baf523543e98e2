"""Integer vectors for the embedding operators, scaled in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled entries of this size and more end the job with an error: sums of
#: their squares would not fit the 64-bit results.
MOST = float(1 << 40)


def whole(vec: Column) -> Column:
    """True for arrays that have entries, all of them finite numbers."""
    finite = F.forall(vec, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite, F.lit(False))


def scaled(vec: Column, factor: int, shift: int = 0) -> Column:
    """floor(factor * entry) + shift of each entry, as bigint."""
    def one(c):
        x = c.cast("double") * factor
        return F.when(F.abs(x) < MOST, F.floor(x) + F.lit(shift).cast("bigint")).otherwise(
            F.raise_error(F.lit(f"an embedding entry times {factor} exceeds {MOST:.0f}")).cast("bigint"))
    return F.transform(vec, one)


def common_length(df: DataFrame, col: str) -> int:
    """The most frequent length (the larger of ties), 0 for an empty table."""
    n = df.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return n["d"] if n else 0


def matrix(column, dims: int):
    """A list column of one length as an int64 matrix."""
    import numpy as np

    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dims)
