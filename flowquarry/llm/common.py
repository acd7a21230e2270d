"""Helpers of the operators in this folder: written tables, blocks of ids, files, Arrow maps."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
NO_ID = -(2**63)
MOST_BITS = 1 << 24


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers of a session that was not given ``--py-files`` import this package."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet below the shared folder and read back, with its path.

    The files outlive any executor, so later stages never recompute what stands above.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def some_hit(df: DataFrame, keys: DataFrame, key: str, hit: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key``, a hash, may be one of ``keys``; with ``hit`` false those whose key is none of them.

    A bitmap of the hashes, about 16 bits a key and at most ``MOST_BITS``, is broadcast whatever the number of keys, so that rows that an
    exact join would drop are not shuffled. With more keys more other rows get through.
    """
    bits = min(MOST_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
    at = F.pmod(F.col(key), F.lit(bits).cast("long"))
    ones = keys.select(F.shiftright(at, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(`{key}`, {bits}L) & 63 as int))").alias("ones"))
    none = df.sparkSession.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("ones"))
    words = ones.unionByName(none).groupBy("word").agg(F.bit_or("ones").alias("ones"))
    bitmap = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "ones"))), lambda w: w["ones"]).alias("_bitmap"))
    is_set = F.expr(f"bit_get(_bitmap[cast(shiftright(pmod(`{key}`, {bits}L), 6) as int)], cast(pmod(`{key}`, {bits}L) & 63 as int)) = 1")
    return df.join(F.broadcast(bitmap), is_set, "left_semi" if hit else "left_anti")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    workers_find_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def id_blocks(df: DataFrame, key: str = "doc_id", per_partition: int = 4) -> DataFrame:
    """Add ``_id`` (null ids sort first) and ``_block``: consecutive ranges of ids, ascending.

    The cut points are approximate quantiles of the ids alone (one pruned scan); how even the blocks
    are depends on them, which block order stands for which id order doesn't. There are several blocks
    to a shuffle partition, so that dealing blocks by hash stays even.
    """
    n = parallelism(df.sparkSession) * per_partition
    with_id = df.withColumn("_id", F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))
    cuts = with_id.select("_id").agg(F.percentile_approx(
        "_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("c")).first().c or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) == 2:
        return with_id.withColumn("_block", F.lit(0).cast("long"))
    return (Bucketizer(splits=splits, inputCol="_as_double", outputCol="_bucket")
            .transform(with_id.withColumn("_as_double", F.col("_id").cast("double")))
            .withColumn("_block", F.col("_bucket").cast("long")).drop("_as_double", "_bucket"))


def in_blocks(df: DataFrame, *order: Column) -> DataFrame:
    """Every block in one partition, blocks one after the other, rows in ``order``."""
    return (df.repartition(parallelism(df.sparkSession), "_block")
            .sortWithinPartitions(F.col("_block"), *order))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for executors that write or read files of their own format."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (
        pafs.LocalFileSystem(), uri)


class CommittedFile:
    """A file that appears under its name only when it is complete.

    Each attempt of a task writes beside the target and renames at the end, so a lost or repeated attempt
    leaves no half-written file; attempts write the same bytes, so it doesn't matter which one is last.
    """

    def __init__(self, uri: str):
        self._fs, self._path = locate(uri)
        self._fs.create_dir(self._path.rpartition("/")[0], recursive=True)
        self._aside = f"{self._path}.{uuid.uuid4().hex}.tmp"
        self._out = self._fs.open_output_stream(self._aside)

    def write(self, data: bytes) -> None:
        self._out.write(data)

    def commit(self) -> None:
        self._out.close()
        self._fs.move(self._aside, self._path)

    def abort(self) -> None:
        self._out.close()
        self._fs.delete_file(self._aside)


class KnownIds:
    """Token ids of strings met before: the strings as one Arrow array, their ids one after the other.

    A string takes its own bytes, its ids and three numbers, no Python objects. Past ``limit`` strings, or ``limit`` times
    ``_MEAN_BYTES`` bytes of them, those not asked for the longest are forgotten.
    """

    _MEAN_BYTES = 32

    def __init__(self, limit: int):
        self._limit = limit
        self._forget()

    def _forget(self) -> None:
        self._keys = pa.array([], pa.large_string())
        self._sizes, self._used, self._call = np.empty(0, np.int64), np.empty(0, np.int64), 0
        self.ids = np.empty(0, "<u4")

    def __len__(self) -> int:
        return len(self._keys)

    def _keep(self, rows: np.ndarray) -> None:
        starts = np.cumsum(self._sizes) - self._sizes
        self.ids = self.ids[spans(starts[rows], self._sizes[rows])]
        self._keys, self._sizes, self._used = self._keys.take(pa.array(rows)), self._sizes[rows], self._used[rows]

    def look_up(self, keys: pa.Array, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``ids`` those of each of the distinct ``keys`` (large strings) start, and how many they are.

        ``make`` gives ids and their numbers for keys that aren't known.
        """
        self._call += 1
        if len(self) > self._limit or self._keys.nbytes > self._limit * self._MEAN_BYTES:
            latest = np.flatnonzero(self._used > np.median(self._used))
            small = self._keys.take(pa.array(latest)).nbytes <= self._limit * self._MEAN_BYTES // 2
            if len(latest) and small:
                self._keep(latest)
            else:
                self._forget()
        at = pc.index_in(keys, value_set=self._keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            lacking = keys.take(pa.array(new))
            ids, sizes = make(lacking)
            at[new] = len(self) + np.arange(len(new))
            self._keys = pa.concat_arrays([self._keys, lacking])
            self._sizes = np.concatenate([self._sizes, np.asarray(sizes, np.int64)])
            self._used = np.concatenate([self._used, np.zeros(len(new), np.int64)])
            self.ids = np.concatenate([self.ids, ids])
        self._used[at] = self._call
        return (np.cumsum(self._sizes) - self._sizes)[at], self._sizes[at]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes of text, at least one row each."""
    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(total, size + (total[start - 1] if start else 0), "right")))
        yield start, end
        start = end
