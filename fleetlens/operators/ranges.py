"""Open-interval range filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_range(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Rows strictly between two times; both bounds reach the scan as pushed filters."""
    kind = dict(df.dtypes)[col]
    return df.filter((F.col(col) > F.lit(lo).cast(kind)) & (F.col(col) < F.lit(hi).cast(kind)))
