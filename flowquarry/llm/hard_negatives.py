"""Hard negatives by shared candidate lists of anchor clusters.

Anchors are clustered by direction. For a cluster with axis c whose members lie within the angle t of c, no member u can
have a product with a row v above |u| |v| cos(max(0, angle(v, c) - t)). The rows are sorted by |v| cos(..) once per
cluster; every member walks that one list and stops where the bound falls below what it still needs: the k-th best
score it has, or the lower end of its window. That is a certificate, so results are those of a full comparison.

Two walks: the best rows of the anchor's own label (positives), then for every positive the best rows of other labels whose score
is between ``low`` and ``high`` hundredths of the positive's. Rows are dealt to slabs, anchors to blocks; a task holds one slab and one
block, both of bounded size, walks all clusters of the block, and keeps the few best rows of every anchor. The bests of all slabs
are merged by anchor. So neither rows nor anchors ever stand in one place, and a hot label or vector has no partition of its own.

Scores are exact integers: components are limited to a size at which 100 times a product fits 64 bits (over 2^23 up to 512
dimensions). Rows without label or vector take no part; a shorter vector is continued with zeros, an empty one scores 0. An
anchor's "others" are rows with another vec_id. Null ids come last among equal scores; a row with a null id can be
listed, but is no anchor. Repeated rows are listed as often as they occur; equal anchors give their result once. Without anchors the
result is empty. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_paths, parallelism, workers_find_package, written

CLUSTERS, FIT_ROWS = 64, 50_000  # clusters at most; anchors that the clustering is fitted on, a sample of more
SLAB_BYTES, BLOCK_BYTES = 16 << 20, 8 << 20
_STEP, _LAST = 256, np.iinfo(np.int64).max


class Best:
    """The best rows of many searches: largest score first, then smallest id."""

    def __init__(self, searches: int, k: int):
        self.k = k
        self.kth = np.full(searches, -np.inf)  # score that a new row has to reach
        self.search, self.score, self.tie, self.row = (np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64))

    def add(self, search: np.ndarray, score: np.ndarray, tie: np.ndarray, row: np.ndarray) -> None:
        if not len(search):
            return
        s, v, t, r = (np.concatenate(x) for x in ((self.search, search), (self.score, score.astype(np.int64)), (self.tie, tie), (self.row, row)))
        order = np.lexsort((t, -v, s))
        s = s[order]
        first = np.searchsorted(s, s)
        keep = order[np.arange(len(s)) - first < self.k]
        self.search, self.score, self.tie, self.row = (np.concatenate(x)[keep] for x in (
            (self.search, search), (self.score, score.astype(np.int64)), (self.tie, tie), (self.row, row)))
        n = np.bincount(self.search, minlength=len(self.kth))
        last = np.cumsum(n) - 1
        full = n == self.k
        self.kth[full] = self.score[last[full]]


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    sizes = np.asarray(pa.compute.list_value_length(column))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


class Slab:
    """Candidates of a task, with exact products and the angular bound of a cluster."""

    def __init__(self, vectors: np.ndarray):
        self.norm = np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1))
        self.unit = vectors / np.maximum(self.norm, 1e-300)[:, None]
        self._exact = vectors
        self._float = vectors.astype(np.float64)
        self._most = int(np.abs(vectors).max(initial=0))

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if self._most * int(np.abs(anchors).max(initial=0)) * anchors.shape[1] < 2**53:
            return anchors.astype(np.float64) @ self._float[rows].T
        return anchors @ self._exact[rows].T

    def shared_list(self, anchors: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows by descending bound on the product with a unit vector of the cluster, and the bounds."""
        units = anchors / np.maximum(norms, 1e-300)[:, None]
        axis = units.sum(axis=0)
        axis /= max(np.linalg.norm(axis), 1e-300)
        lengths = norms > 0
        widest = np.arccos(np.clip(units[lengths] @ axis, -1, 1)).max() if lengths.any() else 0.0
        angle = np.arccos(np.clip(self.unit @ axis, -1, 1))
        bound = self.norm * (np.cos(np.clip(angle - widest, 0, np.pi)) + 1e-7)  # beyond any rounding of the angles
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


def _walk(slab: Slab, anchors: np.ndarray, needed, seen) -> None:
    """Give ``seen`` (members, rows, scores) step by step down the shared list, until no member's bound reaches ``needed()``."""
    norms = np.sqrt(np.square(anchors.astype(np.float64)).sum(axis=1))
    order, bound = slab.shared_list(anchors, norms)
    at, step = 0, _STEP
    while at < len(order):
        active = np.flatnonzero(norms * bound[at] + 1e-6 >= needed())
        if not len(active):
            return
        rows = order[at:at + step]
        seen(active, rows, slab.scores(anchors[active], rows))
        at, step = at + step, min(2 * step, 16 * _STEP)


def nearest_of_label(slab: Slab, ids, labels, anchors, anchor_ids, anchor_labels, k: int) -> Best:
    """The k best rows of its own label for every anchor of one cluster."""
    best = Best(len(anchors), k)

    def seen(active, rows, scores):
        fits = (labels[rows][None, :] == anchor_labels[active][:, None]) & (ids[rows][None, :] != anchor_ids[active][:, None])
        m, c = np.nonzero(fits & (scores >= best.kth[active][:, None]))
        best.add(active[m], scores[m, c], ids[rows[c]], rows[c])
    _walk(slab, anchors, lambda: best.kth, seen)
    return best


def windows_below(slab: Slab, ids, labels, anchors, anchor_labels, scores_of: np.ndarray, valid: np.ndarray, k: int, low: int, high: int) -> Best:
    """For every anchor and each of its positives' scores, the k best rows of other labels within the window; searches count anchors x positives."""
    p = scores_of.shape[1]
    least, most = low * scores_of, high * scores_of
    open_ = valid & (least <= most)
    best = Best(len(anchors) * p, k)

    def needed():
        each = np.where(open_, np.maximum(best.kth.reshape(-1, p), least / 100), np.inf)
        return each.min(axis=1)

    def seen(active, rows, scores):
        other = labels[rows][None, :] != anchor_labels[active][:, None]
        hundred = scores * 100
        for j in range(p):
            kth = best.kth.reshape(-1, p)[active, j]
            fits = other & open_[active, j][:, None] & (hundred >= least[active, j][:, None]) & (hundred <= most[active, j][:, None])
            m, c = np.nonzero(fits & (scores >= kth[:, None]))
            best.add(active[m] * p + j, scores[m, c], ids[rows[c]], rows[c])
    _walk(slab, anchors, needed, seen)
    return best


def _clustered(anchors: DataFrame, n: int, dim: int) -> DataFrame:
    """``anchors`` with ``cluster``, by direction."""
    k = min(CLUSTERS, max(1, isqrt(n)))
    if k == 1 or dim == 0:
        return anchors.withColumn("cluster", F.lit(0))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    padded = F.concat(F.col("vector"), F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("vector")))
    unit = F.transform(padded, lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(F.lit(0.0)))
    told = anchors.withColumn("norm", norm).withColumn("unit", array_to_vector(unit))
    sample = told if n <= FIT_ROWS else told.sample(FIT_ROWS / n, seed=3)
    model = KMeans(k=k, maxIter=4, initSteps=1, seed=3, featuresCol="unit", predictionCol="cluster").fit(sample.select("unit"))
    return model.transform(told).drop("norm", "unit")


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label and ``vector``, an array of integers without nulls; ``is_anchor`` is a condition on them.
    """
    spark = rows.sparkSession
    workers_find_package(spark)
    valid = rows.where("label IS NOT NULL AND vector IS NOT NULL").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
    size = valid.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    dim = size.dim or 0
    limit = isqrt((2**56) // max(dim, 1))
    valid = valid.withColumn("vector", F.transform("vector", lambda x: F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))))
    anchors, _ = written(valid.where(is_anchor & F.col("vec_id").isNotNull()).distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n = anchors.count()
    width = 8 * max(dim, 1)
    slabs = max(2 * parallelism(spark), -(-size.n * width // SLAB_BYTES))
    blocks = max(1, -(-2 * n * width // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int").alias("block")
    grouped, grouped_path = written(_clustered(anchors, n, dim).withColumn("block", block), "anchor-clusters")
    # rows are dealt by their place, as a third of them may be equal
    dealt = valid.withColumn("slab", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slabs)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every_slab = F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab")

    def searched(side: DataFrame, fn, schema: str) -> DataFrame:
        return dealt.groupBy("slab", "block").cogroup(side.select("*", every_slab).groupBy("slab", "block")).applyInArrow(fn, schema)

    def per_cluster(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        left, right = left.combine_chunks(), right.combine_chunks()
        column = lambda t, c: t.column(c).combine_chunks()
        slab, ids, labels = Slab(_matrix(column(left, "vector"), dim)), _ids(column(left, "vec_id")), column(left, "label").to_numpy()
        vectors, cluster = _matrix(column(right, "vector"), dim), column(right, "cluster").to_numpy()
        for c in np.unique(cluster) if len(ids) else ():
            yield slab, ids, labels, vectors, np.flatnonzero(cluster == c)

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for slab, ids, labels, vectors, at in per_cluster(left, right):
            best = nearest_of_label(slab, ids, labels, vectors[at], right.column("vec_id").to_numpy()[at], right.column("label").to_numpy()[at], positives)
            out.append((right.column("anchor").to_numpy()[at[best.search]], best.row, best.score))
        return _table(left, out, ["anchor", "positive_id", "positive_score"])

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        lists = right.column("scores").combine_chunks()
        count = np.asarray(pa.compute.list_value_length(lists))
        scores = _matrix(lists, positives)
        for slab, ids, labels, vectors, at in per_cluster(left, right):
            best = windows_below(slab, ids, labels, vectors[at], right.column("label").to_numpy()[at], scores[at],
                                 np.arange(positives)[None, :] < count[at][:, None], negatives, low, high)
            out.append((right.column("anchor").to_numpy()[at[best.search // positives]], best.row, best.score, best.search % positives + 1))
        return _table(left, out, ["anchor", "negative_id", "negative_score", "place"])

    first = W.partitionBy("anchor").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    ranked = searched(grouped, best_positives, "anchor long, positive_id long, positive_score long").withColumn("place", F.row_number().over(first))
    chosen, _ = written(ranked.where(F.col("place") <= positives), "positives")
    lists = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    told = grouped.join(lists, "anchor").withColumn("scores", F.transform("p", lambda x: x["positive_score"])).drop("p")
    told, told_path = written(told, "anchor-windows")
    best = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = searched(told, best_negatives, "anchor long, negative_id long, negative_score long, place int").withColumn("rank", F.row_number().over(best))
    found, _ = written(found.where(F.col("rank") <= negatives), "negatives")
    drop_paths(spark, [grouped_path, told_path])
    named = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return (found.join(chosen, ["anchor", "place"]).join(named, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def _table(left: pa.Table, found: list[tuple], names: list[str]) -> pa.Table:
    """Found (anchor, row, score, ..) as a table with the rows' ids."""
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * len(names)
    ids = left.column("vec_id").combine_chunks().take(pa.array(columns[1]))
    return pa.table([pa.array(columns[0], pa.int64()), ids, pa.array(columns[2], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[3:]]], names=names)
