"""Tables with one version per batch of a stream.

A batch reads the newest version before its own and replaces its own, so a batch that is run again
gives the same tables. Versions before the last two may be deleted at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def all_versions(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The table with its versions as ``batch``; empty before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, batch bigint")
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/{name}")


def newest(spark: SparkSession, folder: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """The newest version, or the newest one before a batch."""
    versions = all_versions(spark, folder, name, schema)
    if before is not None:
        versions = versions.filter(F.col("batch") < before)
    last = versions.agg(F.max("batch")).first()[0]
    return versions.filter(F.col("batch") == F.lit(last)).drop("batch")


def write(df: DataFrame, folder: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
