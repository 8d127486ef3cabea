"""Tables: load, replace, append runs once, default columns, absent tables."""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_table(spark: SparkSession, path: str, where: Column | None = None,
               columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table; the filter and the column list reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def tasks(df: DataFrame) -> int:
    """Tasks for CPU-heavy work on shuffled rows: a few for each core, at least the session's number of shuffle partitions."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a scanned table over all cores before CPU-heavy text work.

    Only for a table read as fewer splits than there are cores (a few small files); otherwise unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write the rows beside the table, then swap the folders; ``df`` may read the table that it replaces.

    Until the swap the old table is whole, and a failure between the two renames leaves it under ``.old``.
    """
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(staged)
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(context._jsc.hadoopConfiguration())
    had = files.exists(at(path))
    if had and not files.rename(at(path), at(old)) or not files.rename(at(staged), at(path)):
        raise OSError(f"could not put {staged} in the place of {path}")
    if had:
        files.delete(at(old), True)


def optional_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one with the declared schema when it does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)


def not_yet_run(items: DataFrame, runs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items without a stored run under the key. Null-safe, unlike NOT IN."""
    return items.join(runs.select(*key).distinct(), list(key), "left_anti")


def append_runs(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append rows whose key is not stored yet; of several new rows with one key, one is kept."""
    fresh = df.dropDuplicates(list(key))
    stored = optional_table(df.sparkSession, path, df.schema)
    not_yet_run(fresh, stored, key).write.mode("append").parquet(path)


def add_column_default(df: DataFrame, name: str, default) -> DataFrame:
    """Add a column old files lack; rows written before it read as the default."""
    value = F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    return df.withColumn(name, value)


def load_evolved(spark: SparkSession, path: str, name: str, default) -> DataFrame:
    """A table whose newer files carry one more column."""
    return add_column_default(spark.read.option("mergeSchema", "true").parquet(path), name, default)
