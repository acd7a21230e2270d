"""Joins whose broadcast side is proven small first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_CELLS = 4_000_000  # about 32 MB of doubles


def fixed_rows(spark, rows, schema: str) -> DataFrame:
    """A dimension stated in code; its size never depends on data."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def join_null_safe(df: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null: a group without a name is a group."""
    held = dim.withColumnsRenamed({k: f"__key{i}" for i, k in enumerate(on)})
    same = [df[f"`{k}`"].eqNullSafe(held[f"__key{i}"]) for i, k in enumerate(on)]
    return df.join(held, same, how).drop(*[f"__key{i}" for i in range(len(on))])


def join_dimension(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left",
                   rows: int | None = None, null_safe: bool = False, width: int | None = None) -> DataFrame:
    """Join ``dim`` to ``df``, broadcasting it only if its counted size is below the bound.

    ``null_safe`` lets null keys match null keys.

    ``rows`` passes a row count the caller already knows, ``width`` the cells of a row whose columns hold arrays. Beyond the bound the join shuffles
    both sides and adaptive execution splits the partitions of hot keys.
    """
    width = max(width or len(dim.columns), 1)
    bound = BROADCAST_CELLS // width
    if rows is None:
        rows = dim.limit(bound + 1).count()
    side = F.broadcast(dim) if rows <= bound else dim
    return join_null_safe(df, side, on, how) if null_safe else df.join(side, on, how)
