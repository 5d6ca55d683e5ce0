"""A bounded sample of rows by a hash, the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest(df: DataFrame, hashed: str, most: int, *ties: str) -> DataFrame:
    """The ``most`` different rows of ``df`` with the smallest long in column ``hashed``; all where there are fewer.

    Only rows below a bound are ordered, so what tasks send to the driver does not grow with their
    number. The bound starts at about four times ``most`` of the rows and is raised eightfold until
    enough different rows are below it, so rows that repeat cannot starve the sample.
    """
    df = df.distinct()
    share = 4 * most / max(df.count(), 1)
    while share < 1:
        below = df.where(F.col(hashed) < F.lit(-(1 << 63) + int(share * (1 << 64))))
        if below.limit(most).count() == most:
            return below.orderBy(hashed, *ties).limit(most)
        share *= 8
    return df.orderBy(hashed, *ties).limit(most)
