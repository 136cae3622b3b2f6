"""Order-dependent work without one task per key.

A window over a whole key (a log file, an instance) puts that key in one task. The
helpers here split a key by a *bucket*: a column that is a pure function of the row and
never decreases along the order (``line_no`` div N, the hour of a timestamp). Windows run
inside (key, bucket); one summary row per bucket carries what crosses a border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOMENT = ("instance", "snapshot_ts")


def moment_keys(*frames: DataFrame) -> list[str]:
    """The part of (instance, snapshot_ts) that all of the frames carry."""
    return [k for k in MOMENT if all(k in f.columns for f in frames)]


def exclusive_prefix(totals: DataFrame, keys: Sequence[str], bucket: str,
                     sums: Sequence[str]) -> DataFrame:
    """Per (keys, bucket): the sums of all earlier buckets of the key.

    ``totals`` holds one row per bucket, so the window sorts bucket rows, not data rows.
    """
    earlier = (Window.partitionBy(*keys).orderBy(bucket)
               .rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(*keys, bucket, *[
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("bigint").alias(c) for c in sums])


def bucketed_offset(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
                    cols: dict[str, str], lead: bool = False) -> DataFrame:
    """``lag`` (or ``lead``) of ``cols`` (source -> new name) by ``order`` within ``keys``.

    Equal to a window over the whole key, but the largest sort is one (key, bucket). The
    neighbour of a bucket's first row is the last row of the key's previous bucket. The
    edges join on the partitioning the window has already made. Keys are not NULL.
    """
    part = [*keys, bucket]
    by = [F.col(c).desc() for c in order] if lead else [F.col(c).asc() for c in order]
    inside = Window.partitionBy(*part).orderBy(*by)
    payload = F.struct(*cols)
    edge_of = F.min_by if lead else F.max_by
    edges = df.groupBy(*part).agg(edge_of(payload, F.struct(*order)).alias("_edge"))
    buckets = Window.partitionBy(*keys).orderBy(
        F.col(bucket).desc() if lead else F.col(bucket).asc())
    edges = edges.select(*part, F.lag("_edge").over(buckets).alias("_edge"))
    rows = df.withColumn("_near", F.lag(payload).over(inside))
    near = F.coalesce(F.col("_near"), F.col("_edge"))
    return rows.join(edges, part, "left").select(
        *df.columns, *[near[c].alias(name) for c, name in cols.items()])
