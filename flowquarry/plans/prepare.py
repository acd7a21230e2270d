"""Cleaning workflows: serving-side preprocessing and training-side feature sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions import vectors as V
from flowquarry.functions.numeric import null_if_not_finite, to_number
from flowquarry.operators import clean, lookup, scale
from flowquarry.operators.clean import q
from flowquarry.plans.joins import join_dimension
from flowquarry.plans.ranks import vector_percentiles, wide
from flowquarry.plans.storage import materialize
from flowquarry.schema import FEATURES, GRID_CELLS, GRID_SIDE, KNOWN_CLASSES, LABEL, MODEL_FEATURES
from flowquarry.session import compile_wide_plans
from flowquarry.sources.flows import dedupe_header, normalize_headers


def tidy(df: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Headers, names, ordered ``features`` in one array of doubles, with null for anything not finite."""
    compile_wide_plans(df.sparkSession)
    df = clean.canonicalize_columns(dedupe_header(normalize_headers(df)))
    df = clean.select_features(df, names, keep=keep)
    return df.select(*[q(k) for k in keep], F.array(*[null_if_not_finite(to_number(q(n))) for n in names]).alias("features"))


def impute_vector(rows: DataFrame, medians: DataFrame, names: Sequence[str], by: str, vec: str = "features") -> DataFrame:
    """Fill null cells of packed vectors with the file's median, then with 0."""
    med = medians.select(q(by), F.array(*[q(n).cast("double") for n in names]).alias("__med"))
    joined = join_dimension(rows, med, [by], width=len(names) + 1)
    filled = F.array(*[F.coalesce(F.get(q(vec), F.lit(i)), F.get("__med", F.lit(i)), F.lit(0.0)) for i in range(len(names))])
    return joined.withColumn(vec, filled).drop("__med")


def fit_cleaning(df: DataFrame, names: Sequence[str], by: str = "source_file",
                 feature_range=(0.0, 1.0)) -> tuple[DataFrame, scale.Scaler]:
    """Per-file medians and the scaler of the imputed data, from the same histograms.

    A median lies between the ends of its file, so filling gaps can't widen a range; only a column without any value in
    some file adds the 0 that fills it.
    """
    found = materialize(vector_percentiles(tidy(df, names, [by]), "features", [by], 0.5))
    ends = found.groupBy("item").agg(F.min(F.coalesce("lo", F.lit(0.0))).alias("min"), F.max(F.coalesce("hi", F.lit(0.0))).alias("max"))
    at = {r["item"]: r for r in ends.collect()}  # one row a feature
    scaler = scale.Scaler(list(names), [at[i]["min"] if i in at else 0.0 for i in range(len(names))],
                          [at[i]["max"] if i in at else 0.0 for i in range(len(names))], *map(float, feature_range))
    return wide(found, names, [by]), scaler


def _vectors(df: DataFrame, scaler: scale.Scaler, names: Sequence[str], by: str,
             keep: Sequence[str], medians: DataFrame | None) -> DataFrame:
    rows = tidy(df, names, [by, *keep])
    if medians is None:
        medians = wide(vector_percentiles(rows, "features", [by], 0.5), names, [by])
    return scale.scale_vector(impute_vector(rows, medians, names, by), scaler)


def preprocess(df: DataFrame, scaler: scale.Scaler, names: Sequence[str] = FEATURES,
               by: str = "source_file", keep: Sequence[str] = (),
               medians: DataFrame | None = None) -> DataFrame:
    """Scaled feature vector and label of every flow: per-file medians, then 0, then min-max.

    Cells are packed into one array early, so the plan stays small however many features there
    are. The scaler must list ``names`` in order. ``medians`` reuses a stored table.
    """
    label = [LABEL] if LABEL in df.columns else []
    return clean.split_label(_vectors(df, scaler, names, by, [*keep, *label], medians))


def preprocess_counts(df: DataFrame, by: str = "source_file",
                      names: Sequence[str] = FEATURES) -> DataFrame:
    """Row and feature counts per capture; needs no feature column at all."""
    return df.groupBy(by).agg(F.count("*").alias("row_count")).withColumn(
        "feature_count", F.lit(len(names)).cast("long"))


def prepare_train(df: DataFrame, names: Sequence[str], by: str = "source_file",
                  feature_range=(0.0, 1.0)) -> tuple[DataFrame, scale.Scaler]:
    """Benign rows first, then medians of those rows, then a scaler fitted on them."""
    benign = clean.filter_benign(df)
    medians, scaler = fit_cleaning(benign, names, by, feature_range)
    return _vectors(benign, scaler, names, by, [], medians), scaler


def prepare_labelled(df: DataFrame, scaler: scale.Scaler, names: Sequence[str] = MODEL_FEATURES,
                     known: Sequence[int] | None = KNOWN_CLASSES, by: str = "source_file",
                     keep: Sequence[str] = (), pad: int = GRID_CELLS,
                     medians: DataFrame | None = None) -> DataFrame:
    """Padded vectors with class ids: medians of the whole file before any class filter."""
    rows = _vectors(df, scaler, names, by, [*keep, LABEL], medians)
    rows = lookup.map_labels(rows.withColumn("features", V.pad_to(F.col("features"), pad)))
    return lookup.remap_known(rows, known) if known is not None else rows.withColumn(
        "y", F.col("class_id"))


def serving_vectors(df: DataFrame, scaler: scale.Scaler, names: Sequence[str] = MODEL_FEATURES,
                    keep: Sequence[str] = ("source_file",), pad: int = GRID_CELLS) -> DataFrame:
    """Model input of raw flows: missing cells are 0 (no medians), also after scaling; made in Arrow batches."""
    width, (factors, shifts) = len(names), map(np.array, scaler.linear())

    @F.arrow_udf("array<double>")
    def served(vectors: pa.Array) -> pa.Array:
        cells = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        scaled = np.where(np.isfinite(cells), cells, 0.0) * factors + shifts
        out = np.zeros((len(scaled), pad))
        out[:, :width] = np.where(np.isfinite(scaled), scaled, 0.0)[:, :pad]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, pad), pa.int32()), pa.array(out.reshape(-1)))
    return tidy(df, names, keep).withColumn("features", served("features"))


def named_vectors(df: DataFrame, wanted: Sequence[str] = MODEL_FEATURES, values: str = "values",
                  names: str = "names", pad: int = GRID_CELLS) -> DataFrame:
    """Model input of already scaled (values, names) arrays; nothing is scaled again."""
    return df.withColumn("features", V.pad_to(V.pick_by_name(q(values), q(names), wanted), pad))


def as_grid(df: DataFrame, vec: str = "features", out: str = "grid",
            reshape: Callable[[Column], Column] | None = None) -> DataFrame:
    """Square grid of a padded vector, or any caller-supplied reshape."""
    fn = reshape or (lambda v: V.to_grid(v, GRID_SIDE, GRID_SIDE))
    return df.withColumn(out, fn(q(vec)))
