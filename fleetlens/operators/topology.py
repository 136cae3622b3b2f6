"""Replication trees from an edge table, in a number of joins that grows with log(depth).

Every node holds a pointer up, the distance it spans and the names on the way. One round
joins each pointer with the node it points to and doubles it, so depth 1,000 takes ten
rounds. Rounds end in ``checkpoint()`` in the shared folder; no level is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ensure_checkpoint_dir


def _climb(instances: DataFrame, scope: Sequence[str], node: str, parent: str) -> DataFrame:
    """Per node: ``state`` (done, orphan, cycle), root, level and path from the root."""
    ensure_checkpoint_dir(instances.sparkSession)
    scope = list(scope)
    instances = instances.groupBy(*scope, F.col(node).alias(node)).agg(
        F.min(parent).alias(parent))
    known = instances.select(*scope, F.col(node).alias("_parent"),
                             F.lit(True).alias("_known"))
    nodes = (instances.select(*scope, F.col(node).alias("node"),
                              F.col(parent).alias("_parent"))
             .join(known, [*scope, "_parent"], "left"))
    is_root = F.col("_parent").isNull()
    lost = ~is_root & F.col("_known").isNull()
    step = nodes.select(
        *scope, "node",
        F.when(~is_root & ~lost, F.col("_parent")).alias("up"),
        F.when(is_root, 0).otherwise(1).cast("bigint").alias("level"),
        F.array("node").alias("path"), lost.alias("lost")).checkpoint()
    open_nodes = step.filter("up is not null").count()
    while open_nodes:
        above = step.select(*scope, F.col("node").alias("up"), F.col("up").alias("_up"),
                            F.col("level").alias("_level"), F.col("path").alias("_path"),
                            F.col("lost").alias("_lost"))
        moving = step.filter("up is not null").join(above, [*scope, "up"])
        moved = moving.select(
            *scope, "node", F.col("_up").alias("up"),
            (F.col("level") + F.col("_level")).alias("level"),
            F.concat("_path", "path").alias("path"), F.col("_lost").alias("lost"))
        step = step.filter("up is null").unionByName(moved).checkpoint()
        left = step.filter("up is not null").count()
        if left == open_nodes:
            break                     # a round that frees no node leaves only cycles
        open_nodes = left
    return step


def replication_tree(instances: DataFrame, scope: Sequence[str] = ("cluster",),
                     node: str = "ip", parent: str = "master_ip") -> DataFrame:
    """Level and path of each instance under its root; sorting by (scope, path) gives
    depth-first order. A root has no master ('' or NULL). Keys are (scope, node), so equal
    addresses in two clusters stay apart; orphans and cycles are in ``tree_anomalies``. Rows
    that repeat a node are one, below the smallest master named; instances that share an
    address need a ``node`` column that tells them apart, such as address and port."""
    climbed = _climb(_rooted(instances, parent), scope, node, parent)
    return climbed.filter("up is null and not lost").select(
        *scope, F.col("node").alias(node), "level",
        F.element_at("path", 1).alias("root"), "path")


def tree_anomalies(instances: DataFrame, scope: Sequence[str] = ("cluster",),
                   node: str = "ip", parent: str = "master_ip") -> DataFrame:
    """Instances in no tree: ``orphan`` (some master above is unknown) or ``cycle`` (on a
    cycle or below one); and nodes with rows that name different masters (``masters``)."""
    rooted = _rooted(instances, parent)
    climbed = _climb(rooted, scope, node, parent)
    named = F.coalesce(F.col(parent).cast("string"), F.lit(""))
    torn = rooted.groupBy(*scope, F.col(node).alias(node)).agg(
        F.min(named).alias("_low"), F.max(named).alias("_high")).filter("_low <> _high")
    return climbed.filter("up is not null or lost").select(
        *scope, F.col("node").alias(node),
        F.when(F.col("lost"), "orphan").otherwise("cycle").alias("anomaly")).unionByName(
        torn.select(*scope, node, F.lit("masters").alias("anomaly")))


def _rooted(instances: DataFrame, parent: str) -> DataFrame:
    if dict(instances.dtypes)[parent] != "string":
        return instances
    return instances.withColumn(parent, F.when(F.col(parent) != "", F.col(parent)))


def depth_first(tree: DataFrame, scope: Sequence[str] = ("cluster",)) -> DataFrame:
    """The tree in printing order."""
    return tree.orderBy(*scope, "path")
