"""Projection, filtering and imputation of raw flow rows.

Order matters: medians depend on which rows are present, so label filters are applied before or
after :func:`impute_median` exactly where a caller writes them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.numeric import null_if_not_finite, to_number
from flowquarry.plans.joins import join_dimension
from flowquarry.plans.ranks import grouped_percentiles
from flowquarry.schema import (BENIGN, CRITICALITIES, IDENTITY_COLUMNS, LABEL, RENAMES,
                               ZERO_FEATURES, ZONES)


def q(name: str) -> Column:
    """Column by exact name, dots and slashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """Abbreviated names to canonical ones; other names pass."""
    return df.toDF(*[RENAMES.get(c, c) for c in df.columns])


def split_label(df: DataFrame, keep: bool = True) -> DataFrame:
    """Move ``Label`` to a ``label`` column (null if absent), or leave it out altogether."""
    rest = [q(c) for c in df.columns if c != LABEL]
    if not keep:
        return df.select(*rest)
    label = q(LABEL).cast("string") if LABEL in df.columns else F.lit(None).cast("string")
    return df.select(*rest, label.alias("label"))


def missing_features(df: DataFrame, names: Sequence[str]) -> dict:
    """How many wanted features a layout lacks, and the first five of them."""
    lost = [n for n in names if n not in df.columns]
    return {"count": len(lost), "first": lost[:5]}


def select_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exact ordered feature list, absent columns as 0.0; ``keep`` columns go first."""
    return df.select(*[q(k) for k in keep],
                     *[q(n) if n in df.columns else F.lit(0.0).alias(n) for n in names])


def lock_features(df: DataFrame, names: Sequence[str] | None,
                  keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """First call (``names=None``) fixes the list; later data sets are cut to it or refused."""
    if names is None:
        names = [c for c in df.columns if c != LABEL and c not in keep]
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"missing features: {lost}")
    return df.select(*[q(k) for k in keep], *[q(n) for n in names]), list(names)


def drop_non_features(df: DataFrame) -> DataFrame:
    """Drop label, always-zero features and identity columns that are present."""
    gone = {LABEL, *ZERO_FEATURES, *IDENTITY_COLUMNS}
    return df.select(*[q(c) for c in df.columns if c not in gone])


def map_columns(df: DataFrame, cols: Sequence[str], fn) -> DataFrame:
    chosen = set(cols)
    return df.select(*[fn(q(c)).alias(c) if c in chosen else q(c) for c in df.columns])


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to double; unparsable cells become null. Columns that are numeric already pass."""
    typed = set(numeric_columns(df))
    return map_columns(df, [c for c in cols if c not in typed], to_number)


def null_non_finite(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinite cells become null."""
    return map_columns(df, numeric_columns(df) if cols is None else cols,
                       lambda c: null_if_not_finite(c.cast("double")))


def filter_benign(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.where(q(label) == BENIGN)


def filter_known(df: DataFrame, classes: Sequence[int], col: str = "class_id") -> DataFrame:
    return df.where(q(col).isin(list(classes)))


def filter_unknown(df: DataFrame, classes: Sequence[int], col: str = "class_id") -> DataFrame:
    """Rows of the held-out classes."""
    return df.where(q(col).isin(list(classes)))


def drop_incomplete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Infinite cells count as missing; rows with any missing cell go."""
    clean = null_non_finite(df, cols)
    keep = F.lit(True)
    for c in cols:
        keep = keep & q(c).isNotNull()
    return clean.where(keep)


def null_inf_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: null (or NaN) and infinite cells; a single scan."""
    wide = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.count_if(q(c).isNull() | F.isnan(q(c).cast("double"))).alias(f"n{i}"),
        F.count_if(F.abs(q(c).cast("double")) == float("inf")).alias(f"i{i}"))])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("nulls"),
                 F.col(f"i{i}").alias("infs")) for i, c in enumerate(cols)])))


def file_medians(df: DataFrame, cols: Sequence[str], by: str = "source_file") -> DataFrame:
    """Exact median of each column per file."""
    return grouped_percentiles(df, cols, [by], 0.5)


def impute_median(df: DataFrame, cols: Sequence[str], by: str = "source_file",
                  medians: DataFrame | None = None) -> DataFrame:
    """Null cells take the median of their own file; all-null columns stay null.

    ``medians`` passes a table of :func:`file_medians` that was computed before.
    """
    cols = list(cols)
    if medians is None:
        medians = file_medians(df, cols, by)
    med = medians.select(q(by), *[q(c).alias(f"__m{i}") for i, c in enumerate(cols)])
    joined = join_dimension(df, med, [by])
    fill = {c: f"__m{i}" for i, c in enumerate(cols)}
    return joined.select(*[F.coalesce(q(c), F.col(fill[c])).alias(c) if c in fill else q(c)
                           for c in df.columns])


def impute_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return map_columns(df, cols, lambda c: F.coalesce(c, F.lit(0.0)))


def validate_findings(df: DataFrame) -> DataFrame:
    """Add ``errors``: every broken rule of a findings record with its context."""
    attack = F.col("status") == "abnormal"
    rules = [
        ("status", ~F.coalesce(F.col("status").isin("normal", "abnormal"), F.lit(False))),
        ("confidence", ~F.coalesce(F.col("confidence").between(0, 1), F.lit(False))),
        ("flow_count", ~F.coalesce(F.col("flow_count") >= 0, F.lit(False))),
        ("attack_detected", attack & F.col("attack_detected").isNull()),
        ("attack_type", attack & F.col("attack_type").isNull()),
        ("attack_ratio", attack & ~F.coalesce(F.col("attack_ratio"), F.lit(0.0)).between(0, 1)),
        ("networkZone", ~F.coalesce(F.col("networkZone").isin(ZONES), F.lit(False))),
        ("assetCriticality",
         ~F.coalesce(F.col("assetCriticality").isin(CRITICALITIES), F.lit(False))),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules])))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without errors, quarantined records with their errors)."""
    checked = validate_findings(df)
    return (checked.where(F.size("errors") == 0).drop("errors"),
            checked.where(F.size("errors") > 0))
