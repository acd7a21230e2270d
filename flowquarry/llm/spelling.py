"""Spelling variants: frequent words that differ by one letter, found by PartEnum signatures.

A word's letters are a multiset, written as a binary vector over (letter, occurrence). One replaced letter changes
two entries of that vector, one inserted or deleted letter changes one. The entries are dealt to ``PARTS`` parts. Two words
of one length that differ by a replacement agree outside some two parts, and a word agrees with one that has a letter
more outside some one part; so the hash of all entries but those of every choice of parts is an exact signature, and an
equi-join on signatures misses nothing. One changed letter also leaves one half of the word as it is; the text of
that half belongs to the signature, which keeps permutations of the same letters apart. Candidates are verified by edit
distance.

Members of a signature with more than ``CLOSED`` words are not paired with each other: each is listed under what is left of it
without its i-th letter (and as it is, for a longer word), and only words that meet there are paired. Such a meeting
place holds at most one word a letter of the alphabet and position, whatever the input, so no pair is lost and none multiplies.

All joins ask for a merge: their tables grow with the vocabulary, and files and columns say little of their size in memory, least of all
after an explode, so that Spark would broadcast some of them.

Words are runs of ``LETTERS`` with A-Z lower-cased, at least ``LEAST_LENGTH`` code points long and found ``LEAST_COUNT``
times in all texts. Null and empty texts have none; a null doc_id counts as an empty id text; repeated rows count as often as
they occur. An empty table gives no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_paths, map_arrow, written

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
PARTS, CLOSED = 5, 256
SAME, SHORTER, LONGER = 0, 1, 2  # how a word stands to the words it may meet under a signature
_ODD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def without_one_letter(run: Column, doc_id: Column, one_in: int) -> Column:
    """``run``, less a letter where ``one_in`` divides the checksum of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(h, F.length(run)).cast("int")
    return F.when(F.pmod(h, F.lit(one_in)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, one_in: int | None = None, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n over all texts. With ``one_in``, about one run in so many of a document loses a letter first."""
    pattern = f"[{LETTERS}]{{{least_length},}}"  # shorter runs can't give a word
    runs = docs.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run")).where("run IS NOT NULL")
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    word = without_one_letter(F.col("run"), F.col("doc_id"), one_in) if one_in else F.col("run")
    return (runs.select(word.alias("word")).where(F.length("word") >= least_length)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count))


class PartEnum:
    """Signatures of letter multisets, over whole columns of words."""

    def __init__(self, parts: int = PARTS):
        self.parts = parts

    def _sums(self, letters: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """For every part and word the sum of the hashes of its entries (letter, occurrence)."""
        order = np.lexsort((letters, owner))
        letters, owner = letters[order], owner[order]
        first = np.ones(len(letters), bool)
        first[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
        at = np.arange(len(letters))
        occurrence = at - np.maximum.accumulate(np.where(first, at, 0))
        entry = _mixed((letters.astype(np.uint64) << np.uint64(32)) + occurrence.astype(np.uint64) + _ODD)
        part = ((entry >> np.uint64(40)) % np.uint64(self.parts)).astype(np.int64)
        sums = np.zeros(self.parts * n, np.uint64)
        np.add.at(sums, part * n + owner, _mixed(entry + _ODD))
        return sums.reshape(self.parts, n)

    @staticmethod
    def _ranges(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the letters from start to stop of every word, in order."""
        place = np.arange(len(values), dtype=np.uint64)
        power = np.cumprod(np.full(len(values) + 1, _ODD, np.uint64)) if len(values) else np.ones(1, np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(values * power[place.astype(np.int64)], dtype=np.uint64)])
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        back = np.cumprod(np.full(len(values) + 1, inverse, np.uint64))
        return _mixed((total[stop] - total[start]) * back[np.minimum(start, len(values))])

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Signatures (one row a word, one column a signature) and the role of every column."""
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        parts = self._sums(letters, np.repeat(np.arange(len(words)), size), len(words))
        whole = parts.sum(axis=0, dtype=np.uint64)
        values = _mixed(letters.astype(np.uint64) + np.uint64(1))

        def halves(length: np.ndarray, skipped: int) -> list[np.ndarray]:
            """The first half, and all after it but so many letters."""
            middle = start + length // 2
            return [self._ranges(values, start, middle), self._ranges(values, middle + skipped, start + size) + _M1]
        columns, roles = [], []
        for role, length, left_out, skipped in ((SAME, size, 2, 0), (SHORTER, size, 1, 0), (LONGER, size - 1, 1, 1)):
            for half in halves(length, skipped):
                tag = _mixed(half + length.astype(np.uint64) * _ODD + np.uint64(role == SAME))
                for k, out in enumerate(combinations(range(self.parts), left_out)):
                    rest = whole - sum((parts[p] for p in out), np.zeros(len(words), np.uint64))
                    columns.append(_mixed(rest + tag + np.uint64(k)))
                    roles.append(role)
        return np.stack(columns, axis=1).view(np.int64), np.array(roles, np.int8)


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """sig, role and word, a row for every signature of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = PartEnum(parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                column = batch.column("word").slice(at, 4096)
                sigs, roles = sign(column.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs.ravel()), pa.array(np.tile(roles, len(column))),
                     column.take(pa.array(np.repeat(np.arange(len(column)), len(roles))))], names=["sig", "role", "word"])
    return map_arrow(words.select("word"), run, "sig long, role byte, word string")


def _meetings(large: DataFrame) -> DataFrame:
    """The members of large groups under what is left without a letter: ``sig`` then stands for group, rest and position."""
    n = F.length("word")
    rest = lambda i: F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, n))
    at = F.sequence(F.lit(0), n - 1)
    places = (F.when(F.col("role") == SAME, F.transform(at, lambda i: F.xxhash64("sig", rest(i), i)))
              .when(F.col("role") == LONGER, F.transform(at, lambda i: F.xxhash64("sig", rest(i), F.lit(-1))))
              .otherwise(F.array(F.xxhash64("sig", "word", F.lit(-1)))))
    return large.select(F.explode_outer(F.array_distinct(places)).alias("sig"), "role", "word")


def near_pairs(words: DataFrame, parts: int = PARTS, closed: int | None = None) -> DataFrame:
    """Pairs (a, b) of words that differ by exactly one inserted, deleted or replaced code point, each once."""
    signed = signatures(words, parts)
    sizes, sizes_path = written(signed.groupBy("sig").agg(F.count("*").alias("members")).where("members > 1"), "signature-sizes")
    groups, groups_path = written(signed.join(sizes.hint("merge"), "sig").select("sig", "role", "word", "members"), "signature-groups")
    bound = CLOSED if closed is None else closed
    small = groups.where(F.col("members") <= bound).select("sig", "role", "word")
    met = small.unionByName(_meetings(groups.where(F.col("members") > bound)))
    left = met.where(F.col("role") != LONGER).withColumnsRenamed({"word": "a", "role": "ra"})
    right = met.where(F.col("role") != SHORTER).withColumnsRenamed({"word": "b", "role": "rb"})
    longer = F.length("b") - F.length("a")
    fits = (((F.col("ra") == SAME) & (F.col("rb") == SAME) & (F.col("a") < F.col("b")) & (longer == 0))
            | ((F.col("ra") == SHORTER) & (F.col("rb") == LONGER) & (longer == 1)))
    found = left.join(right.hint("merge"), "sig").where(fits).where(F.levenshtein("a", "b", 1) == 1)
    pairs, _ = written(found.select("a", "b").distinct(), "near-words")
    drop_paths(words.sparkSession, [sizes_path, groups_path])
    return pairs


def variants(docs: DataFrame, one_in: int | None = None, times: int = TIMES, least_length: int = LEAST_LENGTH,
             least_count: int = LEAST_COUNT) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the first in code-point order), if that is at least ``times`` the word's
    own n. Forms grow by that factor, so chains are short; root is the end of a word's chain, found by doubling steps.
    """
    words, _ = written(count_words(docs, one_in, least_length, least_count), "words")
    pairs = near_pairs(words)
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = near.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")).hint("merge"), "near")
    best = (counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
            .join(words.hint("merge"), "word").withColumn("form_n", -F.col("top.less")))
    chosen = F.col("form_n") >= times * F.col("n")
    best, _ = written(best.select("word", "n_near", F.when(chosen, F.col("top.near")).alias("form"), F.when(chosen, F.col("form_n")).alias("form_n")), "word-forms")
    roots, path = written(best.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if roots.join(step.select("root").hint("merge"), "root", "left_semi").isEmpty():
            break
        further, further_path = written(roots.join(step.hint("merge"), "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "word-roots")
        drop_paths(docs.sparkSession, [path])
        roots, path = further, further_path
    return (words.join(best.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
