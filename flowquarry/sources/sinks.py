"""Outputs: prepared feature sets, metric tables and the analysis history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowquarry.schema import HISTORY_TYPE
from flowquarry.sources.params import child_names, is_complete, move_path, remove_path


def materialize_features(df: DataFrame, path: str, partition_by: str | None = None, replace: bool = False) -> int:
    """Write a prepared data set once; a complete one is kept. Returns its row count.

    The rows are written beside the target, which gets its name when they are complete. A folder with files but without the
    mark of completion may be another writer's, so it is refused unless ``replace`` is set. Of two jobs at once the
    first one's rows stay.
    """
    spark = df.sparkSession
    if not is_complete(spark, path):
        if child_names(spark, path) and not replace:
            raise FileExistsError(f"{path} has files but is not marked as complete")
        aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(aside)
        if not is_complete(spark, path):
            remove_path(spark, path)
            move_path(spark, aside, path)
        remove_path(spark, aside)
    return spark.read.parquet(path).count()


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric, sweep and comparison tables (short by construction) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_history(analyses: DataFrame, path: str) -> None:
    """Append one record per analysed capture; fields outside the history record are dropped."""
    analyses.select(*[f.name for f in HISTORY_TYPE.fields]).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HISTORY_TYPE).parquet(path)


def clear_history(spark: SparkSession, path: str) -> None:
    """Empty the history, keeping the folder readable."""
    spark.createDataFrame([], HISTORY_TYPE).write.mode("overwrite").parquet(path)
