"""Exact order statistics without sorting a whole group in one task.

* ``running_totals`` - cumulative sums along an ordered column, per group. Values are
  pre-aggregated and written once (``score_table``), cut into ranges by a sketch of the distinct values, summed inside
  each range in parallel, and every range gets the total of the ranges before it (``totals_along``).
* ``grouped_percentiles`` - exact, linearly interpolated percentiles of many columns per group, by
  histograms that are refined around the wanted rank.
* ``row_positions`` - 0-based position of each row within its group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from flowquarry.plans.joins import join_dimension, join_null_safe
from flowquarry.plans.storage import materialize

PARTS = 64
_BUCKET = "__range"


def _parts(df: DataFrame, parts: int | None) -> int:
    """Ranges of a group: at least as many as the session's shuffles have partitions."""
    return parts or max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with_ranges(df: DataFrame, value: str, parts: int | None) -> DataFrame:
    """Add the range number of ``value``; cut points are at most ``parts`` numbers.

    The cuts only balance work, they never change a result, so a mergeable sketch of the values is enough.
    """
    parts = _parts(df, parts)
    probs = [i / parts for i in range(1, parts)]
    number = F.col(value).cast("double")
    sketch = df.where(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))).agg(
        F.kll_sketch_agg_double(number).alias("k"), F.count("*").alias("n"))
    cuts = sketch.where("n > 0").select(F.kll_sketch_get_quantile_double("k", F.lit(probs).cast("array<double>")).alias("c")).first() if probs else None
    inner = sorted(set(cuts["c"])) if cuts else []
    if not inner:
        return df.withColumn(_BUCKET, F.lit(0))
    splits = [float("-inf"), *inner, float("inf")]
    cutter = Bucketizer(splits=splits, inputCol="__v", outputCol=_BUCKET, handleInvalid="keep")
    return (cutter.transform(df.withColumn("__v", number))
            .drop("__v").withColumn(_BUCKET, F.col(_BUCKET).cast("int")))


def _add_offsets(rows: DataFrame, by: list[str], sums: list[str], descending: bool) -> DataFrame:
    """``rows`` carry a range number; add ``before_*`` and ``total_*`` per (group, range)."""
    cells = rows.groupBy(*by, _BUCKET).agg(*[F.sum(s).alias(s) for s in sums])
    order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    earlier = (W.partitionBy(*by).orderBy(order)
               .rowsBetween(W.unboundedPreceding, -1))
    whole = W.partitionBy(*by)
    offsets = cells.select(
        *by, _BUCKET,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"before_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"total_{s}") for s in sums],
    )
    return join_null_safe(rows, offsets, [*by, _BUCKET])


def score_table(df: DataFrame, value: str, sums: dict[str, Column], by: Sequence[str] = (),
                parts: int | None = None) -> DataFrame:
    """One row per (group, distinct value) with ``sums`` and a range number: all that is ever read of ``df``.

    The table is written once. Totals along any of its groupings (:func:`totals_along`), and all curves made of them, come from it.
    Rows of a null group are a group of their own; null values are left out.
    """
    keep = df.where(F.col(value).isNotNull())
    rows = keep.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return _with_ranges(materialize(rows), value, parts)


def totals_along(table: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (),
                 descending: bool = False) -> DataFrame:
    """One row per (group, distinct value) of a :func:`score_table`: ``s``, ``cum_s`` (inclusive) and ``total_s``.

    Ranges are summed on their own; each gets the totals of the ranges before it, at most as many rows a group as there are ranges.
    """
    by, names = list(by), list(sums)
    rows = table.groupBy(*by, value, _BUCKET).agg(*[F.sum(n).alias(n) for n in names])
    return with_totals(rows, value, names, by, descending).drop(_BUCKET)


def with_totals(rows: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``rows``, one a group and value, with ``cum_s`` and ``total_s``; other columns stay."""
    by, names, others = list(by), list(sums), rows.columns
    rows = _add_offsets(rows, by, names, descending)
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (W.partitionBy(*by, _BUCKET).orderBy(order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.select(
        *others,
        *[(F.col(f"before_{n}") + F.sum(n).over(inside)).alias(f"cum_{n}") for n in names],
        *[F.col(f"total_{n}") for n in names],
    )


def with_totals_of_all(rows: DataFrame, table: DataFrame, value: str, name: str) -> DataFrame:
    """``rows``, those of a :func:`score_table` with more columns, with the sum of ``name`` over all rows below their value, at it, and of the whole table.

    Columns ``below_``, ``at_`` and ``total_``; every row is sorted once, in its range, and joined with nothing but range totals.
    """
    inside = W.partitionBy(_BUCKET).orderBy(value)
    rows = rows.select("*", F.sum(name).over(inside.rangeBetween(W.unboundedPreceding, W.currentRow)).alias("__up_to"),
                        F.sum(name).over(inside.rangeBetween(W.currentRow, W.currentRow)).alias(f"at_{name}"))
    cells = table.groupBy(_BUCKET).agg(F.sum(name).alias("__n"))
    every = W.partitionBy()
    earlier = W.orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select(_BUCKET, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
                           F.sum("__n").over(every).alias(f"total_{name}"))  # as many rows as there are ranges
    joined = join_null_safe(rows, F.broadcast(offsets), [_BUCKET])
    return joined.withColumn(f"below_{name}", F.col("__before") + F.col("__up_to") - F.col(f"at_{name}")).drop("__before", "__up_to")


def running_totals(df: DataFrame, value: str, sums: dict[str, Column], by: Sequence[str] = (),
                   descending: bool = False, parts: int | None = None) -> DataFrame:
    """One row per (group, distinct value) with ``s``, ``cum_s`` (inclusive) and ``total_s``, from one read of ``df``."""
    return totals_along(score_table(df, value, sums, by, parts), value, list(sums), by, descending)


def row_positions(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str,
                  parts: int | None = None) -> DataFrame:
    """0-based position of each row in its group, ordered by ``order`` (first column numeric)."""
    by, order = list(by), list(order)
    rows = _with_ranges(df.withColumn("__one", F.lit(1)), order[0], parts)
    rows = _add_offsets(rows, by, ["__one"], descending=False)
    inside = W.partitionBy(*by, _BUCKET).orderBy(*order)
    return (rows.withColumn(out, (F.col("before___one") + F.row_number().over(inside) - 1)
                            .cast("long"))
            .drop(_BUCKET, "__one", "before___one", "total___one"))


_FINE, BLOCK_CELLS = 1 << 16, 1 << 20


def _counter(by: Sequence[str], needed: Sequence[int] | None = None):
    """Task side of :func:`vector_percentiles`: batches of cells to counts of bins, as a closure that Spark ships with the task.

    Cells are of the items ``needed``, with the ranges that are divided as triples of place, lo and hi; or of all items.
    """
    refine, names = needed is not None, np.array(needed or [], np.int64)
    nan_bin, fine, block, by = 1 << 20, _FINE, BLOCK_CELLS, list(by)

    def group_codes(table: pa.Table) -> np.ndarray:
        codes = np.zeros(len(table), np.int64)
        for name in by:
            column = table[name].combine_chunks()
            if pa.types.is_nested(column.type):
                column = pa.array([repr(v) for v in column.to_pylist()], pa.string())
            column = pc.dictionary_encode(column, null_encoding="encode")
            codes = codes * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
            codes = np.unique(codes, return_inverse=True)[1]
        return codes

    def runs(keys: np.ndarray, values: np.ndarray, items: np.ndarray, kept: np.ndarray):
        """Runs of equal keys inside every row of sorted values, of which the first ``kept`` count: item, bin, n, lo, hi."""
        width, length = values.shape
        starts = np.ones(values.shape, bool)
        starts[:, 1:] = keys[:, 1:] != keys[:, :-1]
        starts &= np.arange(length) < kept[:, None]
        at = np.flatnonzero(starts)
        row = at // length
        end = np.minimum(np.append(at[1:], values.size), row * length + kept[row]) if len(at) else at
        flat = values.reshape(-1)
        return items[row], keys.reshape(-1)[at], end - at, flat[at], flat[end - 1]

    def first_bins(cells: np.ndarray, missing: np.ndarray | None, ranges):
        """Sixteenths of a doubling are the first bits of a number, turned so that they rise with it."""
        width, length = cells.shape
        items = np.arange(width)
        nulls = missing.sum(axis=1) if missing is not None else np.zeros(width, np.int64)
        cells = np.sort(cells, axis=1)  # NaN, and with it what is missing, comes last
        kept = length - np.isnan(cells).sum(axis=1)
        bits = cells.view(np.int64)
        yield runs((bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)) >> 48, cells, items, kept)
        odd = length - kept - nulls
        for bin_, n, which in ((nan_bin, odd, odd > 0), (None, 0 * odd, nulls > 0)):
            if which.any():
                end = np.full(int(which.sum()), np.nan if bin_ else 0.0)
                yield items[which], bin_, n[which], end, end

    def fine_bins(cells: np.ndarray, missing: np.ndarray | None, ranges):
        places, lo, hi = ranges.reshape(-1, 3).T
        places = places.astype(np.int64)
        cells, items = cells[places], names[places]
        lo, hi = lo[:, None], hi[:, None]
        found = (cells >= lo) & (cells <= hi)
        cells = np.sort(np.where(found, cells, np.nan), axis=1)
        kept = found.sum(axis=1)
        most = int(kept.max(initial=0))
        if most:
            cells = np.ascontiguousarray(cells[:, :most])
            with np.errstate(invalid="ignore"):
                at = np.floor((cells - lo) / (hi - lo) * fine)
            yield runs(np.where(np.isnan(at), 0, at).astype(np.int64), cells, items, kept)

    def blocks(batches):
        held, cells = [], 0
        for batch in batches:
            held.append(batch)
            cells += len(batch.column("__cells").flatten())
            if cells >= block:
                yield pa.Table.from_batches(held)
                held, cells = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def out(table: pa.Table, rows, item, bin_, n, lo, hi):
        size = len(rows)
        null = bin_ is None
        count = lambda v: pa.nulls(size, pa.int64()) if v is None else pa.array(np.asarray(v, np.int64))
        end = lambda v: pa.nulls(size, pa.float64()) if null else pa.array(np.asarray(v, np.float64))
        taken = table.select(by).take(pa.array(rows)).combine_chunks()
        bins = count(None) if null else count(np.broadcast_to(bin_, size))
        arrays = [taken[c].combine_chunks() for c in by]
        return pa.RecordBatch.from_arrays([*arrays, count(item), bins, count(n), end(lo), end(hi)],
                                          names=[*by, "item", "bin", "n", "lo", "hi"])

    def count(batches):
        for table in blocks(batches):
            codes = group_codes(table)
            vectors = table["__cells"].combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            for width in np.unique(lengths):
                rows = np.flatnonzero(lengths == width)
                rows = rows[np.argsort(codes[rows], kind="stable")]
                edges = np.flatnonzero(np.diff(codes[rows], prepend=-1))
                if width == 0:
                    if not refine:
                        yield out(table, rows[edges], None, None, np.zeros(len(edges)), None, None)
                    continue
                flat = vectors.take(pa.array(rows)).flatten()
                cells = flat.to_numpy(zero_copy_only=False).reshape(len(rows), width).T + 0.0  # both zeros are one
                missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(len(rows), width).T if flat.null_count else None
                parts, firsts = [], []
                for start, end in zip(edges, np.append(edges[1:], len(rows))):
                    ranges = None
                    if refine:
                        ranges = table["__ranges"][int(rows[start])].values.to_numpy(zero_copy_only=False)
                    for part in (fine_bins if refine else first_bins)(
                            cells[:, start:end], missing[:, start:end] if missing is not None else None, ranges):
                        if part[1] is None:
                            yield out(table, np.full(len(part[0]), rows[start]), *part)
                        else:
                            parts.append([part[0], np.broadcast_to(part[1], part[0].shape), *part[2:]])
                            firsts.append(np.full(len(part[0]), rows[start]))
                if parts:
                    yield out(table, np.concatenate(firsts), *[np.concatenate(p) for p in zip(*parts)])
    return count


def _chosen(hist: DataFrame, by: list[str], at: DataFrame | None, p: float) -> DataFrame:
    """The bin that holds the wanted rank, for every (group, item): lo, hi, below, first, last, share, a and b.

    ``hist`` has by, item, bin, n, lo, hi. first and last are the ranks between which is interpolated, share the second one's
    weight. a and b are the values at these ranks as soon as they are known: a when its bin has one value, b also when its
    rank is the first of the next bin.
    """
    group = W.partitionBy(*by, "item")
    ordered = group.orderBy("bin")
    ends = hist.select(*by, "item", "n", "lo", "hi", F.sum("n").over(ordered).alias("end"),
                       F.sum("n").over(group).alias("total"), F.lead("lo").over(ordered).alias("next"))
    if at is None:
        rank = (F.col("total") - 1) * F.lit(p)
        ends = ends.select("*", F.lit(0).cast("long").alias("base"), F.floor(rank).alias("first"), F.ceil(rank).alias("last"),
                           (rank - F.floor(rank)).alias("share"), F.lit(None).cast("double").alias("b"))
    else:
        ends = join_null_safe(ends, at.select(*by, "item", F.col("below").alias("base"), "first", "last", "share", "b"), [*by, "item"])
    end = F.col("base") + F.col("end")
    start = end - F.col("n")
    whole = F.col("lo").eqNullSafe(F.col("hi"))
    b = F.coalesce("b", F.when(F.col("last") >= end, F.col("next")).when(whole, F.col("lo")))
    return (ends.where((start <= F.col("first")) & (F.col("first") < end))
            .select(*by, "item", "lo", "hi", start.alias("below"), "first", "last", "share", F.when(whole, F.col("lo")).alias("a"), b.alias("b")))


def vector_percentiles(rows: DataFrame, vec: str, by: Sequence[str], p: float) -> DataFrame:
    """Exact interpolated ``p`` percentile of every cell of array column ``vec`` per group: by, item, v, lo, hi.

    Nulls are ignored, NaN is the largest value; v and the ends lo and hi are null where a group has no value. Values are counted
    in bins, all cells in one pass: a task sorts blocks of ``BLOCK_CELLS`` cells in Arrow batches and hands on the counts and
    the ends of their bins, never values. The bin that holds the wanted rank is then divided into ``_FINE`` finer ones, for the rows inside it
    alone, until it holds a single value. The first bins are sixteenths of a doubling, so that two passes
    suffice for most data and five for any doubles, whatever the size or skew of a group.
    """
    by = list(by)
    cells = rows.select(*by, F.col(vec).cast("array<double>").alias("__cells"))
    counted = T.StructType([*cells.select(*by).schema.fields, *[T.StructField(n, t) for n, t in (
        ("item", T.LongType()), ("bin", T.LongType()), ("n", T.LongType()), ("lo", T.DoubleType()), ("hi", T.DoubleType()))]])
    totals = [F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    bins = materialize(cells.mapInArrow(_counter(by), counted).groupBy(*by, "item", "bin").agg(*totals))
    done, at = [], materialize(_chosen(bins.where("bin IS NOT NULL"), by, None, p))
    while True:
        done.append(at.where("a IS NOT NULL"))
        at = at.where("a IS NULL")
        if at.isEmpty():
            break
        needed = sorted(r["item"] for r in at.select("item").distinct().collect())  # at most one row a cell of a vector
        place = F.array_position(F.array(*[F.lit(i).cast("long") for i in needed]), F.col("item")) - 1
        ranges = at.groupBy(*by).agg(F.flatten(F.collect_list(F.array(place.cast("double"), "lo", "hi"))).alias("__ranges"))
        some = cells.select(*by, F.array(*[F.get("__cells", F.lit(i)) for i in needed]).alias("__cells"))
        placed = join_dimension(some, ranges, by, "inner", null_safe=True, width=3 * len(needed))
        inside = placed.select(*by, "__cells", "__ranges").mapInArrow(_counter(by, needed), counted)
        at = materialize(_chosen(inside.groupBy(*by, "item", "bin").agg(*totals), by, at, p))
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    found = every.select(*by, "item", _between(F.col("a"), F.col("b"), F.col("share")).alias("v"))
    return join_null_safe(bins.groupBy(*by, "item").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), found, [*by, "item"], "left")


def wide(found: DataFrame, cols: Sequence[str], by: Sequence[str], value: str = "v") -> DataFrame:
    """One row per group, a column for every item."""
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("item") == i, F.col(value))).alias(c) for i, c in enumerate(cols)])


def grouped_percentiles(df: DataFrame, cols: Sequence[str], by: Sequence[str], p: float) -> DataFrame:
    """Exact interpolated ``p`` percentile of each column per group (:func:`vector_percentiles`)."""
    rows = df.select(*by, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("__cells"))
    return wide(vector_percentiles(rows, "__cells", by, p), cols, by)


def _between(a: Column, b: Column, w: Column) -> Column:
    """Interpolated value; the value itself where both ends are equal, infinite or not."""
    return F.when((a == b) | (w == 0), a).otherwise((1 - w) * a + w * b)
