"""Captures to findings to verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.operators import clean, decision, findings, openmax
from flowquarry.operators.scale import Scaler
from flowquarry.plans import prepare
from flowquarry.plans.joins import join_dimension
from flowquarry.schema import FEATURES, GRID_CELLS, MODEL_FEATURES
from flowquarry.sources.flows import dedupe_header, normalize_headers
from flowquarry.sources.params import OpenMaxParams

Scorer = Callable[[DataFrame], DataFrame]


def classify(vectors: DataFrame, scorer: Scorer, params: OpenMaxParams,
             alpha: int | None = None) -> DataFrame:
    """Vectors to per-flow class, name and confidence."""
    return findings.per_flow_predictions(openmax.openmax(scorer(vectors), params, alpha))


def predict_flows(flows: DataFrame, scaler: Scaler, scorer: Scorer, params: OpenMaxParams,
                  names: Sequence[str] = MODEL_FEATURES, by: str = "source_file",
                  position: str | None = None, pad: int = GRID_CELLS) -> DataFrame:
    """Findings with traffic profile per capture, from one read of raw flows.

    ``pad`` is the width the model expects: the grid for an image model, the feature count for a
    linear one.
    """
    raw = clean.canonicalize_columns(dedupe_header(normalize_headers(flows)))
    raw = raw.withColumn("__cells", findings.profile_cells(raw))
    keep = [by, *([position] if position else []), "__cells"]
    scored = classify(prepare.serving_vectors(raw, scaler, names, keep, pad), scorer, params)
    top = F.element_at("probabilities", F.col("class_id") + 1)
    return findings.capture_summary(scored.withColumn("__conf", top), by, confidence="__conf", position=position, cells="__cells")


def predict_features(rows: DataFrame, scorer: Scorer, params: OpenMaxParams,
                     wanted: Sequence[str] = MODEL_FEATURES, by: str = "source_file",
                     position: str | None = None, pad: int = GRID_CELLS) -> DataFrame:
    """Findings from already scaled (values, names) rows; no traffic profile."""
    scored = classify(prepare.named_vectors(rows, wanted, pad=pad), scorer, params)
    top = F.element_at("probabilities", F.col("class_id") + 1)
    return findings.capture_findings(scored.withColumn("__conf", top), by,
                                     confidence="__conf", position=position)


def with_counts(found: DataFrame, context: DataFrame, by: str = "source_file") -> DataFrame:
    """Findings with their context and the counts of the preprocessing step.

    Every row of a capture is one flow, so its row count is the flow count of the findings and costs no scan of its own.
    """
    counted = found.withColumns({"row_count": F.col("flow_count"), "feature_count": F.lit(len(FEATURES)).cast("long")})
    return join_dimension(counted, context, [by], "left", width=4)


def analyze(flows: DataFrame, context: DataFrame, find: Callable[[DataFrame], DataFrame],
            by: str = "source_file", rule: decision.SeverityRule = decision.ratio_rule) -> DataFrame:
    """One verdict row per capture: counts, findings from the raw flows, context, verdict.

    ``find`` turns flows into findings (for example :func:`predict_flows` with its models bound).
    ``context`` has one row per capture.
    """
    return decision.verdict(with_counts(find(flows), context, by), rule)


def judge(found: DataFrame, context: DataFrame, by: str = "source_file",
          rule: decision.SeverityRule = decision.ratio_rule) -> tuple[DataFrame, DataFrame]:
    """Verdicts of the findings that pass validation, and the others with what is wrong with them.

    Findings or contexts that break a rule get no verdict; they are kept for inspection instead.
    """
    valid, quarantine = clean.split_valid(with_counts(found, context, by))
    return decision.verdict(valid, rule), quarantine


def to_history(analyses: DataFrame, timestamp, by: str = "source_file") -> DataFrame:
    """Verdict rows as history records; the id is a hash of capture and time."""
    ts = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return analyses.select(
        F.sha2(F.concat_ws("|", F.col(by), ts), 256).alias("id"), ts.alias("timestamp"),
        F.col(by).alias("filename"), F.struct("networkZone", "assetCriticality").alias("context"),
        F.struct("verdict", "summary", "explanation", "inferredAttack", "recommendedActions",
                 "alertsTriggered").alias("verdict"),
        F.struct("status", "attack_detected", "attack_type", "confidence", "attack_ratio",
                 "flow_count", "class_distribution", "traffic_profile").alias("modelFindings"),
        F.struct("row_count", "feature_count").alias("preprocessMeta"))
