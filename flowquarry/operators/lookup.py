"""Dimension lookups; every dimension is a fixed table stated in ``schema``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.text import quoted
from flowquarry.operators.clean import q
from flowquarry.plans.joins import fixed_rows, join_dimension
from flowquarry.schema import (KNOWN_CLASSES, LABEL, LABEL_IDS, PORT_SERVICES, PROTOCOLS,
                               SERVED_CLASSES, UNKNOWN, UNMAPPED)


def map_labels(df: DataFrame, label: str = LABEL, out: str = "class_id") -> DataFrame:
    """Trimmed raw label to class id; unmapped spellings get -1."""
    dim = fixed_rows(df.sparkSession, list(LABEL_IDS.items()), "__label string, __id int")
    return (df.join(dim, F.trim(q(label)) == F.col("__label"), "left")
            .withColumn(out, F.coalesce("__id", F.lit(UNMAPPED))).drop("__label", "__id"))


def remap_known(df: DataFrame, known: Sequence[int] = KNOWN_CLASSES, col: str = "class_id",
                out: str = "y") -> DataFrame:
    """Keep known classes and number them by their position in the list."""
    dim = fixed_rows(df.sparkSession, [(c, i) for i, c in enumerate(known)],
                     "__id int, __pos int")
    return (df.join(dim, q(col) == F.col("__id"), "inner")
            .withColumn(out, F.col("__pos")).drop("__id", "__pos"))


def class_name(df: DataFrame, col: str = "class_id", out: str = "prediction",
               names: Sequence[str] = SERVED_CLASSES) -> DataFrame:
    """Class id to name, ``Unknown`` for anything else."""
    dim = fixed_rows(df.sparkSession, list(enumerate(names)), "__id int, __name string")
    return (df.join(dim, q(col) == F.col("__id"), "left")
            .withColumn(out, F.coalesce("__name", F.lit(UNKNOWN))).drop("__id", "__name"))


def _named(table: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{k}, {quoted(v)}" for k, v in table.items()) + ")")


def service_of(port: Column) -> Column:
    """Service name of a port, ``port N`` for others."""
    return F.coalesce(F.try_element_at(_named(PORT_SERVICES), port.try_cast("int")),
                      F.concat(F.lit("port "), port.cast("string")))


def protocol_of(number: Column) -> Column:
    """Protocol name, the number as text for others."""
    return F.coalesce(F.try_element_at(_named(PROTOCOLS), number.try_cast("int")),
                      number.cast("string"))


def port_service(df: DataFrame, col: str = "port", out: str = "service") -> DataFrame:
    return df.withColumn(out, service_of(q(col)))


def protocol_name(df: DataFrame, col: str = "protocol", out: str = "protocol_name") -> DataFrame:
    return df.withColumn(out, protocol_of(q(col)))


def parameter_grid(spark, **axes: Sequence) -> DataFrame:
    """Cross product of short parameter lists, in axis order."""
    grid = spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(f"__{k}")
                                   for k, vs in axes.items()])
    for k in axes:
        rest = [c for c in grid.columns if c != f"__{k}"]
        grid = grid.select(*rest, F.explode(f"__{k}").alias(k))
    return grid.select(*axes)


def known_unknown_split(df: DataFrame, known: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose class is listed in ``known`` and rows whose class is not."""
    dim = known.select(q(col)).distinct()
    return (join_dimension(df, dim, [col], "left_semi"),
            join_dimension(df, dim, [col], "left_anti"))


def zero_filled_counts(df: DataFrame, col: str, members: Sequence[str],
                       out: str = "n") -> DataFrame:
    """Count per listed member, 0 where none occurs; values outside the list are ignored."""
    dim = fixed_rows(df.sparkSession, list(enumerate(members)), f"pos int, {col} string")
    counted = df.where(q(col).isin(list(members))).groupBy(col).count()
    return (dim.join(counted, col, "left")
            .select("pos", col, F.coalesce("count", F.lit(0)).alias(out)))
