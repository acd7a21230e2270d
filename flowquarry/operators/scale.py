"""Min-max scaling with stored parameters."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.operators.clean import q


def _span(span: float) -> float:
    """Range to divide by; one that is no more than rounding noise counts as constant."""
    return 1.0 if span < 10 * sys.float_info.epsilon else span


@dataclass
class Scaler:
    """Fitted minima and maxima, one pair per feature."""

    features: list[str]
    mins: list[float]
    maxs: list[float]
    low: float = 0.0
    high: float = 1.0

    def transform_expr(self, i: int, c):
        """Scaled cell; a constant feature divides by 1, and nothing is clipped."""
        span = self.maxs[i] - self.mins[i]
        factor = (self.high - self.low) / _span(span)
        return c * F.lit(factor) + F.lit(self.low - self.mins[i] * factor)

    def linear(self) -> tuple[list[float], list[float]]:
        """Factor and shift of every feature."""
        factors = [(self.high - self.low) / _span(b - a) for a, b in zip(self.mins, self.maxs)]
        return factors, [self.low - a * f for a, f in zip(self.mins, factors)]


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, pos, min, max): one pass, combined map-side; null and NaN cells are ignored."""
    def cell(c):
        v = q(c).cast("double")
        return F.when(~F.isnan(v), v)
    wide = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.min(cell(c)).alias(f"lo{i}"), F.max(cell(c)).alias(f"hi{i}"))])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"),
                 F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)])))


def fit_minmax_imputed(df: DataFrame, cols: Sequence[str],
                       by: str = "source_file") -> tuple[DataFrame, tuple[int, int]]:
    """Scaler table of the data as it will be after median imputation, and the file sizes.

    A median lies between the minimum and maximum of its file, so filling gaps cannot widen a
    range; only a column without any value in some file adds the 0 that fills it. One pass over
    the data gives the same table as imputing first.
    """
    ends = [(e, i) for i in range(len(cols)) for e in ("lo", "hi")]
    per_file = df.groupBy(q(by).alias("__by")).agg(
        F.count("*").alias("rows"),
        *[(F.min if e == "lo" else F.max)(q(cols[i])).alias(f"{e}{i}") for e, i in ends])
    got = per_file.select("rows", *[F.coalesce(f"{e}{i}", F.lit(0.0)).alias(f"{e}{i}")
                                    for e, i in ends]).agg(
        F.count("*").alias("files"), F.max("rows").alias("largest"),
        *[(F.min if e == "lo" else F.max)(f"{e}{i}").alias(f"{e}{i}") for e, i in ends]).first()
    table = df.sparkSession.createDataFrame(
        [(c, i, got[f"lo{i}"], got[f"hi{i}"]) for i, c in enumerate(cols)],
        "feature string, pos int, min double, max double")
    return table, (got["files"], got["largest"] or 0)


def merge_scalers(*tables: DataFrame) -> DataFrame:
    """Combine partial scaler tables; features missing from one of them are dropped."""
    n = len(tables)
    every = tables[0].withColumn("part", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        every = every.unionByName(t.withColumn("part", F.lit(i)))
    return (every.groupBy("feature")
            .agg(F.min_by("pos", "part").alias("pos"), F.min("min").alias("min"),
                 F.max("max").alias("max"), F.count("*").alias("parts"))
            .where(F.col("parts") == n).drop("parts"))


def load_scaler(table: DataFrame, feature_range: tuple[float, float] = (0.0, 1.0)) -> Scaler:
    """Scaler table (one row per feature) to the driver-side object."""
    rows = table.orderBy("pos").collect()
    zero = lambda x: 0.0 if x is None else float(x)
    return Scaler([r["feature"] for r in rows], [zero(r["min"]) for r in rows],
                  [zero(r["max"]) for r in rows], *map(float, feature_range))


def apply_minmax(df: DataFrame, scaler: Scaler, single: bool = False) -> DataFrame:
    """Scale the scaler's columns in place; ``single`` keeps float32 precision."""
    at = {f: i for i, f in enumerate(scaler.features)}
    def cell(c):
        out = scaler.transform_expr(at[c], q(c).cast("double"))
        return out.cast("float") if single else out
    return df.select(*[cell(c).alias(c) if c in at else q(c) for c in df.columns])


def scale_vector(df: DataFrame, scaler: Scaler, vec: str = "features") -> DataFrame:
    """Scale a packed vector whose cells follow the scaler's feature order."""
    scaled = F.array(*[F.get(q(vec), F.lit(i)) * F.lit(f) + F.lit(c) for i, (f, c) in enumerate(zip(*scaler.linear()))])
    return df.withColumn(vec, F.when(q(vec).isNotNull(), scaled))


def to_vector(df: DataFrame, names: Sequence[str], out: str = "features",
              keep: Sequence[str] | None = None) -> DataFrame:
    """Pack ordered columns into one array column."""
    rest = [c for c in df.columns if c not in set(names)] if keep is None else list(keep)
    return df.select(*[q(c) for c in rest], F.array(*[q(n).cast("double") for n in names]).alias(out))
