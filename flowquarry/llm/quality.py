"""Quality classifier by compression with two dictionaries.

One zstandard dictionary is built from good labelled texts and one from bad ones. A text is compressed
with either; the difference of the two sizes over their sum says which kind it resembles. A logistic curve
through the labelled texts turns the difference (and the ratio of compressed to plain size, which tells
texts that repeat themselves) into a score between 0 and 1.

Only fitting is bounded: at most ``sample_rows`` labelled ids of each class, those with the smallest hash
(of repeated ids the smallest text), half of them for the dictionaries and half for the curve. Scoring reads every whole text.
Nulls count as empty texts, which get the curve's value at zero difference. Without any labelled row of one
class the score is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import workers_find_package

SAMPLE_ROWS, DICT_BYTES, LEVEL = 1500, 112_640, 3
KEEP_FROM = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # bias, size difference, compressed share, log of length

    def scorer(self):
        """Function from text to score with the dictionaries loaded."""
        sizes = _sizer(self.good, self.bad)

        def score(text: str | None) -> float:
            z = float(np.dot(self.weights, _features(text, sizes)))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return score


def _sizer(good: bytes, bad: bytes):
    packers = [zstandard.ZstdCompressor(
        level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(d) if d else None) for d in (good, bad)]
    return lambda data: tuple(len(p.compress(data)) for p in packers)


def _features(text: str | None, sizes) -> tuple[float, ...]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return (1.0, 0.0, 0.0, 0.0)
    g, b = sizes(data)
    return (1.0, (b - g) / (b + g) * 10, (b + g) / (2 * len(data)), math.log1p(len(data)) / 10)


def _dictionary(texts: list[str]) -> bytes:
    """Dictionary content from whole texts: trained where there is enough of them, else the texts themselves."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts if t]
    try:
        return zstandard.train_dictionary(DICT_BYTES, data).as_bytes()
    except zstandard.ZstdError:
        return b"".join(data)[-DICT_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Model from documents (doc_id, text) and labels (doc_id, quality); null ids and labels are ignored."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality")
    chosen = None
    for label in (0, 1):
        part = (usable.where(F.col("quality") == label).distinct()
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    good, bad = ([r.text or "" for r in rows if r.quality == label] for label in (1, 0))
    counts = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    n_good, n_bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        share = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(b"", b"", (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    dict_good, dict_bad = _dictionary(good[::2]), _dictionary(bad[::2])
    sizes = _sizer(dict_good, dict_bad)
    rest = [(t, 1) for t in good[1::2] or good] + [(t, 0) for t in bad[1::2] or bad]
    x = np.array([_features(t, sizes) for t, _ in rest])
    y = np.array([label for _, label in rest], float)
    seen_good, seen_bad = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, n_good / seen_good, n_bad / seen_bad)
    return QualityModel(dict_good, dict_bad, tuple(map(float, _logistic(x, y, weight / weight.mean()))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps that are halved until the loss falls."""
    w = np.zeros(x.shape[1])
    ridge = np.array([1e-9] + [1e-2] * (x.shape[1] - 1))

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(weight @ (np.logaddexp(0, z) - y * z) + (ridge * v) @ v / 2)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), grad)
        part = 1.0
        while part > 1e-6 and loss(w - part * step) > now - 1e-4 * part * (grad @ step):
            part /= 2
        w = w - part * step
        before, now = now, loss(w)
        if abs(before - now) <= 1e-10 * (1 + abs(now)):
            break
    return w


def score(docs: DataFrame, model: QualityModel, text: Column | str = "text") -> Column:
    """Column with the score of every whole text."""
    workers_find_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = shared.value.scorer()
        for texts in parts:
            yield pd.Series([fn(t) for t in texts], dtype="float64")
    return scored(F.col(text) if isinstance(text, str) else text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text divisible by 5 (null ids: all)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
