"""Benchmark passages in documents, by a prefix-filtered set join over word windows.

Every benchmark item is cut into windows of ``window`` consecutive words (an item with fewer words is
one window). A window is a set of shingles of up to ``SHINGLE`` words; all of them must be in a document that contains
the window, so one necessary shingle is enough to find candidates: the one that the fewest document
positions have (the prefix of the set in order of rarity, counted over all documents). A document position
with that shingle fixes where the window would start; windows that would begin before or end after the document
are out, the others are compared word by word. Matching needs no shuffle of texts: only hits are grouped.

The benchmark side is broadcast in blocks of at most ``BLOCK_ROWS`` rows; a larger benchmark takes several
passes over the documents. Null texts have no words. Repeated rows each get a row; a null item id counts
as a hit, but is not listed. An empty benchmark hits nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

WINDOW, SHINGLE, BLOCK_ROWS = 10, 3, 200_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of the text, A-Z lower-cased."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _shingles(words: Column, sizes: list[int]) -> Column:
    """Array of (pos, gram): hashes of all runs of so many words."""
    n = F.size(words)

    def runs(k: int) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.lit(k), *[words[i + j] for j in range(k)]).alias("gram")))
        return F.when(n >= k, made).otherwise(F.array().cast("array<struct<pos:int,gram:bigint>>"))
    return F.concat(*[runs(k) for k in sizes])


def _blocks(side: DataFrame, rows: int) -> list[DataFrame]:
    """Parts of the benchmark side that may be broadcast, cut by gram."""
    parts = -(-rows // BLOCK_ROWS)
    return [F.broadcast(side if parts == 1 else side.where(F.pmod(F.hash("gram"), F.lit(parts)) == p)) for p in range(parts)]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win, width) of all items."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("width", F.least(F.size("words"), F.lit(window)))
    return (items.select("item_id", "words", "width", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("width") + 1)).alias("at"))
            .select("item_id", F.slice("words", F.col("at"), F.col("width")).alias("win"), "width").distinct())


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences of windows: (k1, k2) of ``docs``, start, width, item_id; ``docs`` has k1, k2 and text."""
    spark = docs.sparkSession
    wins, _ = written(windows_of(benchmark, window), "benchmark-windows")
    sizes = sorted({min(SHINGLE, r.width) for r in wins.select("width").distinct().collect()})
    if not sizes:
        return spark.createDataFrame([], "k1 long, k2 long, start int, width int, item_id long")
    own = F.lit(None).cast("array<struct<pos:int,gram:bigint>>")
    for k in sizes:
        own = F.when(F.least(F.col("width"), F.lit(SHINGLE)) == k, _shingles(F.col("win"), [k])).otherwise(own)
    placed = wins.select("*", F.explode_outer(own).alias("g")).select("item_id", "win", "width", "g.pos", "g.gram")
    grams, _ = written(placed.select("gram").distinct(), "benchmark-grams")
    at = (docs.select("k1", "k2", words_of(F.col("text")).alias("words"))
          .withColumn("grams", _shingles(F.col("words"), sizes)))
    # explode_outer: an inner one makes the optimizer test the array's size below, where its words would be made anew
    each = at.select("k1", "k2", "words", F.explode_outer("grams").alias("g"))
    counts, _ = written(_union([each.select(F.col("g.gram").alias("gram")).join(b, "gram").groupBy("gram").count()
                                for b in _blocks(grams, grams.count())]), "benchmark-rarity")
    rarest = (placed.join(counts, "gram", "left").fillna(0, ["count"])
              .groupBy("item_id", "win", "width").agg(F.min(F.struct("count", "gram", "pos")).alias("r")).where("r.count > 0")
              .select("item_id", "win", "width", F.col("r.gram").alias("gram"), F.col("r.pos").alias("offset")))
    rarest, _ = written(rarest, "benchmark-prefixes")
    n = rarest.count()
    if n == 0:
        return spark.createDataFrame([], "k1 long, k2 long, start int, width int, item_id long")
    start = F.col("g.pos") - F.col("offset")
    return _union([each.join(b, F.col("g.gram") == b["gram"])
                   .where((start >= 0) & (start + F.col("width") <= F.size("words")))
                   .where(F.slice("words", start + 1, F.col("width")) == F.col("win"))
                   .select("k1", "k2", start.alias("start"), "width", "item_id") for b in _blocks(rarest, n)])


def with_keys(docs: DataFrame) -> DataFrame:
    """``k1``, ``k2``: hashes that stand for a document (id and text) in joins without its text."""
    return docs.withColumn("k1", F.xxhash64("doc_id", "text")).withColumn("k2", F.xxhash64(F.lit(1), "text", "doc_id"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the keys k1, k2."""
    keyed = with_keys(docs.select("doc_id", "text"))
    found = (hits(keyed, benchmark, window).groupBy("k1", "k2")
             .agg(F.array_sort(F.collect_set(F.struct("start", "width"))).alias("spans"),
                  F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["width"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), s["start"] + s["width"] - F.greatest(a["end"], s["start"]))).alias("n")), lambda a: a["n"])
    found = found.select("k1", "k2", covered.alias("n_hit"), "items")
    found, _ = written(found, "contaminated")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (keyed.select("doc_id", "k1", "k2", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
            .join(found, ["k1", "k2"], "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
                    (n_hit > 0).alias("contaminated"), "k1", "k2"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents in which no benchmark window occurs, with all their columns."""
    keyed = with_keys(docs)
    bad, _ = written(hits(keyed.select("k1", "k2", "text"), benchmark, window).select("k1", "k2").distinct(), "contaminated")
    return keyed.join(bad, ["k1", "k2"], "left_anti").select(*docs.columns)
