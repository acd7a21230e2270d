"""Repeated passages, found by content-defined chunks of lines.

A text is split at line ends. A chunk ends after a line where a hash rolling over the hashes of two lines is
divisible by ``MEAN_LINES``, between lines that differ in how many documents have them, and around every
line of at least ``PASSAGE_WORDS`` words (the hash starts anew after the latter two). All of this depends on the lines themselves, so inserted or
deleted lines shift no later boundary. A chunk that occurs in several documents stays in the one with the
smallest doc_id (null ids last) and is removed from the others, if it has several lines, or if it and the
removed chunks next to it have at least ``PASSAGE_WORDS`` words. Single short lines stay.

Bytes are compared before anything is removed: lines are grouped by their whole texts, and a hash that two
different lines share is never taken for a repeated line; chunks are equal if the hashes of all their lines are.
Words are counted as spaces and one. Rows with one doc_id count as one document. A text may become empty;
rows are never dropped. Nulls stay null. Only line hashes are shuffled, besides distinct lines and the texts to be cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_paths, written
from .decontaminate import with_keys

MEAN_LINES, PASSAGE_WORDS = 4, 50
_LAST = 2**63 - 1


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    """First 60 bits of the MD5 digest."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def _n_words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Hashes (h) of the lines that several documents have, byte for byte, and how many (df); hashes of two lines are left out."""
    each = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.explode_outer(F.array_distinct(lines_of(F.col("text")))).alias("line")).where("line IS NOT NULL")
    same = each.groupBy("line").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("df"))
    return (same.select(line_hash(F.col("line")).alias("h"), F.when(F.col("least") < F.col("most"), F.col("df")).alias("df"))
            .groupBy("h").agg(F.count("*").alias("n"), F.max("df").alias("df")).where("n = 1 AND df > 1").select("h", "df"))


def _ends(lines: Column) -> Column:
    """Positions of the last lines of all chunks, from all lines (pos, h, words, df) of a document in order."""
    n = F.size(lines)
    x = lambda i: F.pmod(lines[i]["h"], F.lit(1 << 20))
    long = lambda i: lines[i]["words"] >= PASSAGE_WORDS
    prev = lambda i: F.greatest(i - 1, F.lit(0))
    goes_on = lambda i: (i > 0) & (lines[prev(i)]["df"] == lines[i]["df"]) & ~long(prev(i))
    rolled = lambda i: F.pmod(F.when(goes_on(i), x(prev(i))).otherwise(0) * 31 + x(i), F.lit(MEAN_LINES))
    nxt = lambda i: F.least(i + 1, n - 1)
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (lines[i]["df"] != lines[nxt(i)]["df"])
                    | long(i) | long(nxt(i)) | (rolled(i) == 0))


def removable(docs: DataFrame) -> DataFrame:
    """Line ranges to remove: k1, k2 and ``cut``, an ordered array of (start, n); ``docs`` has doc_id, text, k1, k2."""
    spark = docs.sparkSession
    known, known_path = written(repeated_lines(docs), "repeated-lines")
    each = (docs.select("k1", "k2", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.posexplode_outer(lines_of(F.col("text"))).alias("pos", "line"))
            .where("pos IS NOT NULL").select("k1", "k2", "doc", "pos", line_hash(F.col("line")).alias("h"), _n_words(F.col("line")).alias("words")))
    marked = each.join(known.hint("merge"), "h", "left").fillna(0, ["df"])
    arrays = (marked.groupBy("k1", "k2", "doc").agg(F.array_sort(F.collect_set(F.struct("pos", "h", "words", "df"))).alias("lines"))
              .where(F.exists("lines", lambda x: x["df"] > 0)))
    ended = arrays.withColumn("ends", _ends(F.col("lines")))
    first = lambda i: F.when(i > 0, F.col("ends")[F.greatest(i - 1, F.lit(0))] + 1).otherwise(0)
    chunked = ended.select("k1", "k2", "doc", F.explode_outer(F.transform("ends", lambda end, i: F.slice(
        F.col("lines"), first(i) + 1, end - first(i) + 1))).alias("part"))
    chunks, chunks_path = written(
        chunked.where(F.col("part")[0]["df"] > 0)
        .select("k1", "k2", "doc", F.col("part")[0]["pos"].alias("start"), F.size("part").alias("n"),
                F.aggregate("part", F.lit(0), lambda a, x: a + x["words"]).alias("words"),
                F.transform("part", lambda x: x["h"]).alias("seq")), "line-chunks")
    firsts, firsts_path = written(chunks.groupBy("seq").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
                                  .where("least < most").select("seq", "least"), "first-chunks")
    again = chunks.join(firsts.hint("merge"), "seq").where("doc > least").select("k1", "k2", "start", "n", "words").distinct()
    of_doc = W.partitionBy("k1", "k2").orderBy("start")
    island = F.col("start") - F.coalesce(F.sum("n").over(of_doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    passages = again.withColumn("island", island).withColumn("in_all", F.sum("words").over(W.partitionBy("k1", "k2", "island")))
    cuts, _ = written(passages.where((F.col("n") > 1) | (F.col("in_all") >= PASSAGE_WORDS))
                      .groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("cut")), "line-cuts")
    drop_paths(spark, [known_path, chunks_path, firsts_path])
    return cuts


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and n_removed, the number of lines removed."""
    keyed = with_keys(docs)
    cuts = removable(keyed.select("doc_id", "text", "k1", "k2"))
    lines, cut = lines_of(F.col("text")), F.col("cut")
    m = F.size(cut)
    kept = F.transform(F.sequence(F.lit(0), m), lambda j: F.struct(
        F.when(j > 0, cut[F.greatest(j - 1, F.lit(0))]["start"] + cut[F.greatest(j - 1, F.lit(0))]["n"]).otherwise(0).alias("a"),
        F.when(j < m, cut[F.least(j, m - 1)]["start"]).otherwise(F.col("n_lines")).alias("b")))
    joined = keyed.join(cuts.hint("merge"), ["k1", "k2"], "left")
    whole = joined.withColumn("lines", F.when(cut.isNotNull(), lines)).withColumn("n_lines", F.size("lines"))
    shorter = F.array_join(F.flatten(F.transform(kept, lambda r: F.slice(F.col("lines"), r["a"] + 1, r["b"] - r["a"]))), "\n")
    removed = F.coalesce(F.aggregate(cut, F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    return whole.select(*[F.when(cut.isNotNull(), shorter).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)
                          for c in docs.columns if c != "n_removed"], removed.alias("n_removed"))
