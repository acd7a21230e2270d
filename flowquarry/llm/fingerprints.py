"""Document fingerprints by context-triggered piecewise hashing.

A hash over a window of eight bytes rolls over the text. Where its low k bits are zero a chunk of
block size 2^k ends, so boundaries move with the content; a chunk also ends after four block sizes
without one (else a text that repeats itself would be one chunk). Every chunk gives a 12-bit symbol.
The fingerprint holds the signatures of three block sizes, from the smallest one at which the whole
text has at most 64 chunks. Two fingerprints are compared at the smallest block size they share, by
the edit distance with insertions and deletions, 1 - distance / (both lengths).

Nulls count as empty texts. Two empty texts have likeness 1, an empty and a non-empty one 0, and so
have fingerprints without a common block size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_blocks, in_blocks, map_arrow

MAX_CHUNKS, LEVELS, LONGEST = 64, 3, 4
_B1, _B2, _B4 = np.uint32(0x9E3779B1), np.uint32(0x9E3779B1**2 % 2**32), np.uint32(0x9E3779B1**4 % 2**32)
_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolled(data: bytes) -> np.ndarray:
    """Mixed hash of the eight bytes that end at each position (zeros stand before the text)."""
    d = np.zeros(len(data) + 7, np.uint32)
    d[7:] = np.frombuffer(data, np.uint8)
    two = d[1:] + d[:-1] * _B1
    four = two[2:] + two[:-2] * _B2
    h = four[4:] + four[:-4] * _B4
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _signature(data: bytes, natural: list[int], longest: int) -> str:
    """Two characters for every chunk; chunks end at the natural ends, at ``longest``, and with the text."""
    start, out = 0, []
    for end in (*natural, len(data)):
        while start < end:
            stop = min(end, start + longest)
            c = zlib.crc32(data[start:stop])
            out.append(_DIGITS[c & 63] + _DIGITS[c >> 6 & 63])
            start = stop
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """``level:signature:signature:signature``; two characters stand for one chunk."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return "0:::"
    h = _rolled(data)
    level = max(0, (n // (LONGEST * MAX_CHUNKS)).bit_length() - 1)
    ends = np.flatnonzero((h & np.uint32((1 << level) - 1)) == 0)
    tails = h[ends]
    ends += 1
    sides: list[str] = []
    while len(sides) < LEVELS:
        natural = ends[(tails & np.uint32((1 << level) - 1)) == 0]
        if sides or len(natural) <= MAX_CHUNKS:
            side = _signature(data, natural.tolist(), LONGEST << level)
            if sides or len(side) <= 2 * MAX_CHUNKS:
                sides.append(side)
        level += 1
    return f"{level - LEVELS}:" + ":".join(sides)


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & at.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    (la, *sa), (lb, *sb) = a.split(":"), b.split(":")
    if not sa[0] or not sb[0]:
        return 0.0
    level = max(int(la), int(lb))
    ia, ib = level - int(la), level - int(lb)
    if ia >= LEVELS or ib >= LEVELS:
        return 0.0
    x, y = ([s[i:i + 2] for i in range(0, len(s), 2)] for s in (sa[ia], sb[ib]))
    return 2 * _common(x, y) / (len(x) + len(y))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text; any column named ``out`` is replaced."""
    from .common import workers_find_package
    workers_find_package(docs.sparkSession)
    print_of = F.udf(fingerprint, "string", useArrow=True)
    return docs.withColumn(out, print_of(F.col(text)))


def edited(text: str, other: str) -> str:
    """The last half of ``text`` replaced by as many first code points of ``other``, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come block after block, ids descending, the lent first row of the next block last."""
    held: tuple | None = None

    def result(row: tuple, after: tuple) -> tuple:
        _, doc, text, mark, _ = row
        new = edited(text, after[2])
        new_mark = mark if new == text else fingerprint(new)
        return (doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), mark, new_mark,
                likeness(mark, new_mark), likeness(mark, after[3]))

    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        rows = []
        for block, doc, text, lent in zip(*(batch.column(c).to_pylist() for c in ("_block", "doc_id", "text", "_lent"))):
            if held and held[0] == block and held[4]:
                continue  # of several lent rows with one id the first counts
            row = (block, doc, text or "", fingerprint(text), lent)
            if held and held[0] == block:
                rows.append(result(held, row))
            held = row
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text and of the next document, and their likeness.

    Documents stand in descending doc_id (nulls last, equal ids by the hash of their texts); after the last
    comes the first. Ids are cut into blocks; each block is one sorted run, and only the first row of a block is
    sent to a second place, the end of the block before it. So texts move once and nothing is gathered.
    An empty table gives no rows, other columns are ignored, repeated rows each give a row.
    """
    spark = docs.sparkSession
    rows = id_blocks(docs.select("doc_id", "text"))
    firsts = [(r["_block"], r["first"]) for r in
              rows.groupBy("_block").agg(F.max("_id").alias("first")).orderBy("_block").collect()]
    above = [b for b, _ in firsts[1:]] + [b for b, _ in firsts[:1]]
    lend = spark.createDataFrame([(i, b) for (_, i), b in zip(firsts, above)], "_id long, _to long")
    dealt = (rows.join(F.broadcast(lend), "_id", "left")
             .withColumn("_dest", F.explode(F.expr(
                 "CASE WHEN _to IS NULL THEN array(struct(_block AS b, false AS l)) "
                 "ELSE array(struct(_block AS b, false AS l), struct(_to AS b, true AS l)) END")))
             .select("doc_id", "text", "_id", F.col("_dest.b").alias("_block"), F.col("_dest.l").alias("_lent")))
    order = (F.col("_lent"), F.col("_id").desc(), F.xxhash64("text"))
    return map_arrow(in_blocks(dealt, *order), _compare_neighbours, _SCHEMA)
