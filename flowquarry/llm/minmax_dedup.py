"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles. Under each hash function both the smallest and the largest value
are kept, so a signature of 2 m entries takes m evaluations of every shingle; either end agrees for two
sets with probability J, their Jaccard similarity, and as the ends of one function vary in opposite
directions the agreement varies less. Bands of ``ROWS`` entries name buckets. There are as many bands as
bring the chance to miss a pair at the threshold below ``MISS``.

Equal sets form one class, so copies are never compared. Every other pair of a bucket that is similar gets linked or connected
otherwise, without expanding a large bucket into its pairs:

1. A bucket with few members (``CLOSED``) is compared in full. In a larger one all members are compared with one centre, the member
   that shares buckets with most others; a centre that is a member of a bucket with a greater one gives way to it, so this is about
   one comparison a member. Links are confirmed on full sets and joined to components. Pairs whose sets can't be similar by
   the first 16 bits of their elements, which bound what they share from above, are left out before full sets are fetched.
2. Around a centre c only pairs of different components are open; one of the two, x, is not similar to c. For members near c (``RING``)
   the differences from c matter: |x ^ y| = |dx| + |dy| - 2 |dx & dy|, and as x is far from c, a similar y must share more than
   about half of dy with dx. So the beginnings of both differences, in one order, must meet (prefix filter). What many
   members differ in stands last in that order; edits add shingles of their own, which come first and meet nothing. Members far from c are compared by
   the beginnings of their whole sets, with what c lacks first. Distances of sets obey the triangle
   inequality, so that with overlapping rings no similar pair is divided.
3. Members that meet under (centre, ring, element) are few (``LATER``) and compared in full, or many and treated as in 1.

Later groups are parts of one earlier group without its centre, and groups within one component are dropped, so the turns end; one or two are usual,
whatever the size of a group. Components are joined on roots: known ones are never walked again.

A document with fewer words than a shingle is one shingle of all of them. Without words (or text) it has an
empty set and no links. Rows with one doc_id are documents of their own with that id; the component's id is
the smallest doc_id (nulls are ignored unless all are null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_paths, map_arrow, some_hit, written
from .decontaminate import with_keys

ROWS, MISS, CLOSED, LATER, RING, SEEN, CLIMBS = 6, 1e-7, 32, 1024, 0.5, 256, 2
FEW_EDGES = 200_000  # links that one task may join
_PIECE = 1 << 10
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; words are lower-cased (A-Z) and parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i:len(h) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(_mixed(total))


class MinMax:
    """Signatures of ``bands`` bands of ``rows`` entries."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows = bands, rows
        m = -(-bands * rows // 2)
        rng = np.random.default_rng(seed)
        self._a = rng.integers(0, 2**63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._b = rng.integers(0, 2**63, m, dtype=np.uint64)

    def buckets(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit bucket for each band."""
        least = np.full(len(self._a), np.uint64(2**64 - 1))
        most = np.zeros(len(self._a), np.uint64)
        for at in range(0, len(shingles), _PIECE):
            values = self._a[:, None] * shingles[None, at:at + _PIECE] + self._b[:, None]
            np.minimum(least, values.min(axis=1), out=least)
            np.maximum(most, values.max(axis=1), out=most)
        entries = np.concatenate([least, most])[:self.bands * self.rows].reshape(self.rows, self.bands)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for row in entries:
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + row)
        return out.view(np.int64)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(threshold, 1 - 1e-12)**rows)))


def signatures(docs: DataFrame, k: int, bands: int) -> DataFrame:
    """doc_id, k1, k2, node (128-bit hash of the set), n_shingles and buckets of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinMax(bands)
        for batch in batches:
            nodes, sizes, buckets = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                nodes.append(xxhash.xxh128_digest(s.tobytes()))
                sizes.append(len(s))
                buckets.append(hasher.buckets(s) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(nodes, pa.binary()),
                 pa.array(sizes, pa.int64()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["doc_id", "k1", "k2", "node", "n_shingles", "buckets"])
    keyed = with_keys(docs.select("doc_id", "text")).selectExpr("CAST(doc_id AS bigint) AS doc_id", "text", "k1", "k2")
    return map_arrow(keyed, run, "doc_id long, k1 long, k2 long, node binary, n_shingles long, buckets array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, n, shingles (array of long) and ``print``, the distinct first 16 bits of those, for ``wanted`` (node, k1, k2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(map(len, sets), pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                 pa.array([np.unique((s >> np.uint64(48)).astype(np.uint16)).view(np.int16) for s in sets], pa.list_(pa.int16()))],
                names=["node", "n", "shingles", "print"])
    found = some_hit(with_keys(docs.select("doc_id", "text")), wanted, "k1")
    # one row of those that repeat id and text; the join has dealt them by these keys
    rows = found.join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    return map_arrow(rows.select("node", "text"), run, "node binary, n int, shingles array<long>, print array<short>")


class _Scratch:
    """Written tables of one run, dropped when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self._spark, self._paths = spark, []

    def __call__(self, df: DataFrame, label: str) -> DataFrame:
        out, path = written(df, label)
        self._paths.append(path)
        return out

    def drop(self) -> None:
        drop_paths(self._spark, self._paths)
        self._paths = []


def _fewer_centres(large: DataFrame, centres: DataFrame, keep: _Scratch) -> DataFrame:
    """grp and b: of the ``centres`` (grp, met, b) those that are members of a group with a greater one give way to it."""
    above = (large.select("grp", "node").join(centres.select("grp", "met", F.col("b").alias("top")), "grp")
             .join(centres.select(F.col("b").alias("node")).distinct(), "node")
             .groupBy("node").agg(F.max(F.struct("met", "top")).alias("most")).select(F.col("node").alias("b"), F.col("most.top").alias("top")))
    for _ in range(CLIMBS):
        above = keep(above, "centres-above")
        above = above.join(above.select(F.col("b").alias("top"), F.col("top").alias("beyond")), "top").select("b", F.col("beyond").alias("top"))
    return centres.join(above, "b").select("grp", F.col("top").alias("b"))


def _pairs(groups: DataFrame, percent: int, merge: bool, keep: _Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, star) to compare, and the members (key, a) of large groups with their centre b.

    ``groups`` has grp, node, root, probe, index, n, rest, need: pairs are those of a probe and an index member with different roots, of sizes
    n that can be similar, where the elements of either from the one they meet under on (``rest``) are as many as the two need in common.
    With ``merge``, groups that have one centre become one.
    """
    count = lambda c: F.sum(F.col(c).cast("long"))
    sizes = keep(groups.groupBy("grp").agg(F.count("*").alias("members"), (count("probe") * count("index") <= (CLOSED if merge else LATER)**2).alias("few")), "group-sizes")
    small = groups.join(sizes.where("few").select("grp"), "grp")
    left = small.where("probe").selectExpr("grp", "node AS x", "root AS rx", "n AS nx", "rest AS rest_x", "need AS need_x", "index AS index_x")
    right = small.where("index").selectExpr("grp", "node AS y", "root AS ry", "n AS ny", "rest AS rest_y", "need AS need_y", "probe AS probe_y")
    closed = (left.join(right, "grp").where("rx <> ry AND (x > y OR NOT (index_x AND probe_y)) AND least(rest_x, rest_y) >= need_x + need_y - 1e-6")
              .where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent)
              .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"), F.lit(False).alias("star")))
    large = keep(groups.join(sizes.where("NOT few").select("grp", "members"), "grp").select("grp", "node", "members"), "large-groups")
    met = large.groupBy("node").agg(F.sum("members").alias("met"))
    centres = large.join(met, "node").groupBy("grp").agg(F.max(F.struct("met", "node")).alias("top")).select("grp", "top.met", F.col("top.node").alias("b"))
    if merge:
        centres = _fewer_centres(large, keep(centres, "centres"), keep)
    key = F.xxhash64("b") if merge else F.col("grp")
    stars = keep(large.join(centres, "grp").where("node <> b").select(key.alias("key"), F.col("node").alias("a"), "b").distinct(), "stars")
    both = closed.unionByName(stars.select("a", "b", F.lit(True).alias("star")))
    return keep(both.groupBy("a", "b").agg(F.max("star").alias("star")), "pairs"), stars


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` but those whose prints show that they aren't similar: what is missing in the other's print is missing in its set."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("print").alias("pa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("print").alias("pb"))
    most = F.least(F.col("na") - F.size(F.array_except("pa", "pb")), F.col("nb") - F.size(F.array_except("pb", "pa")))
    return (pairs.where("NOT star").join(right, "b").join(left, "a").withColumn("most", most)
            .where(F.col("most") * 100 >= (F.col("na") + F.col("nb") - F.col("most")) * percent)
            .select("a", "b", "star").unionByName(pairs.where("star").select("a", "b", "star")))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, keep: _Scratch) -> DataFrame:
    """Similar pairs and stars of ``pairs``: the sizes na and nb, similar, and for stars both (size of the intersection), and in order the
    shingles that only a has (more), only b (lack) and, of members far from the centre, both of them (shared)."""
    pairs = keep(_likely(pairs, sets, percent), "likely-pairs")
    named = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "compared-nodes")
    mine = sets.join(named, "node", "left_semi")
    left = mine.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.size("shingles").alias("na"))
    right = mine.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.size("shingles").alias("nb"))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    found = (pairs.join(right, "b").join(left, "a").where(F.col("star") | near)
             .withColumn("more", F.array_except("sa", "sb")).withColumn("both", F.col("na") - F.size("more")))
    similar = F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent
    star = F.col("star")
    return (found.select("a", "b", "star", "na", "nb", "both", similar.alias("similar"), F.when(star, F.col("more")).alias("more"),
                         F.when(star & _near(percent), F.array_except("sb", "sa")).alias("lack"),
                         F.when(star & _far(percent), F.array_intersect("sa", "sb")).alias("shared"))
            .where("similar OR star"))


def _near(percent: int) -> Column:
    return F.col("both") >= RING * (F.col("na") + F.col("nb") - F.col("both"))


def _far(percent: int) -> Column:
    """Overlaps the near ring by the largest distance of similar sets."""
    return F.col("both") <= (RING + 1 - percent / 100 + 1e-6) * (F.col("na") + F.col("nb") - F.col("both"))


def _open_groups(stars: DataFrame, compared: DataFrame, labels: DataFrame, percent: int, keep: _Scratch) -> DataFrame:
    """Groups (grp, node, root, probe, index, n, rest, need) of members around a centre that may be similar and have different roots.

    ``rest`` counts the elements of a member's order from the shared one on. As the first element two members share has all others they
    share after it, it leads only to those whose rests reach what they need in common, the sum of their ``need``.
    """
    root = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    rooted = keep(stars.join(root("a"), "a").join(root("b"), "b").select("key", "a", "b", "ra", (F.col("ra") != F.col("rb")).alias("probe")), "rooted-stars")
    some = rooted.groupBy("key").agg(F.max("probe").alias("some")).where("some").select("key")
    live = keep(rooted.join(some, "key").join(compared.where("star").drop("star", "similar"), ["a", "b"]), "open-stars")
    # what many members have in common stands last, by how many of a few members have it: any order will do, a good one saves pairs
    sizes = live.groupBy("key").agg(F.count("*").alias("members"))
    some = live.join(sizes, "key").where(F.pmod(F.xxhash64("a"), F.col("members")) < SEEN)
    counts = some.select("key", F.explode(F.concat("more", F.coalesce("lack", F.array().cast("array<bigint>")))).alias("t")).groupBy("key", "t").agg(F.count("*").alias("df"))
    often = (counts.where("df > 2").groupBy("key")
             .agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda e: e["t"]).alias("often")))
    live = live.join(keep(often, "common-elements"), "key", "left").withColumn("often", F.coalesce("often", F.array().cast("array<bigint>")))
    ordered = lambda elements: F.concat(F.array_except(elements, "often"), F.array_intersect("often", elements))
    t, slack = percent / 100, 1e-9
    # an element more or less in a beginning costs time only, so that rounding errs to the longer one
    beginning = lambda elements, least: F.slice(elements, 1, F.greatest(F.size(elements) - F.greatest(least, F.lit(1)) + 1, F.lit(0)).cast("int"))
    # columns of their own, as an expression would be worked out anew for every element
    live = live.withColumn("apart", ordered(F.concat("more", "lack"))).withColumn("whole", F.concat(ordered(F.col("more")), "shared"))
    apart, whole = F.col("apart"), F.col("whole")
    far = F.ceil(F.size(apart) - F.col("na") * ((1 - t) / t) - slack)
    half = F.floor((F.size(apart) + (F.col("nb") - F.col("na")) * ((1 - t) / (1 + t))) / 2 - slack) + 1
    apart_need = (F.size(apart) - F.col("na") * ((1 - t) / (1 + t))) / 2
    whole_need = F.col("na") * (t / (1 + t))
    listed = lambda ring, elements, least, need, probe, index: F.transform(beginning(elements, least), lambda e, i: F.struct(
        F.lit(ring).alias("ring"), e.alias("t"), probe.alias("probe"), F.lit(index).alias("index"), (F.size(elements) - i).alias("rest"), need.alias("need")))
    none = F.array().cast("array<struct<ring:int,t:bigint,probe:boolean,index:boolean,rest:int,need:double>>")
    yes = F.lit(True)
    spots = F.concat(F.when(_near(percent) & F.col("probe"), listed(0, apart, far, apart_need, yes, False)).otherwise(none),
                     F.when(_near(percent), listed(0, apart, half, apart_need, F.lit(False), True)).otherwise(none),
                     F.when(_far(percent), listed(1, whole, F.ceil(F.col("na") * t - slack), whole_need, F.col("probe"), True)).otherwise(none))
    placed = live.select("key", "a", "ra", "na", F.explode(spots).alias("e"))
    parts = keep(placed.select(F.xxhash64("key", "e.ring", "e.t").alias("grp"), F.col("a").alias("node"), F.col("ra").alias("root"), F.col("na").alias("n"),
                               "e.probe", "e.index", "e.rest", "e.need")
                 .groupBy("grp", "node", "root", "n").agg(*[F.max(c).alias(c) for c in ("probe", "index", "rest")], F.min("need").alias("need")), "group-parts")
    still = (parts.groupBy("grp").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.max("probe").alias("p"), F.max("index").alias("i"))
             .where("r0 <> r1 AND p AND i").select("grp"))
    return parts.join(still, "grp")


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        top = x
        while above[top] != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top
    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            above.setdefault(u, u)
            above.setdefault(v, v)
            a, b = root(u), root(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], names=["node", "root"])


def connected(edges: DataFrame) -> DataFrame:
    """node and root of every node of ``edges`` (a, b); the root is the smallest node of its component.

    At most ``FEW_EDGES`` edges (counted) are joined by one task. More are by alternating large-star and small-star steps: each
    joins edges with one minimum per node; edges of a node with very many neighbours are plain rows that adaptive execution can split.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if now.count() <= FEW_EDGES:
        return map_arrow(now.coalesce(1), _union_find, "node binary, root binary")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large, large_path = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = lambda x: F.struct(F.col(x).alias("u"), F.col("m").alias("v"))
        small = large.join(least, "u").select(F.explode(F.array(pair("u"), pair("v"))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt, nxt_path = written(small, "edges")
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_paths(spark, [path, large_path])
        now, path = nxt, nxt_path
        if state == seen:
            break
        state = seen
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after further links (a, b), of which only those between different roots are walked."""
    root = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    new, path = written(links.join(root("a"), "a").join(root("b"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "root-links")
    if new.isEmpty():
        drop_paths(labels.sparkSession, [path])
        return labels
    moved = connected(new).select(F.col("node").alias("root"), F.col("root").alias("now"))
    out, _ = written(labels.join(moved, "root", "left").select("node", F.coalesce("now", "root").alias("root")), "labels")
    drop_paths(labels.sparkSession, [path])
    return out


def linked(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node and root for the members of ``groups`` (grp, node and the size n of its set), by links between sets that share a group."""
    labels, _ = written(groups.select("node").distinct().withColumn("root", F.col("node")), "labels")
    groups = groups.select("grp", "node", "n", F.col("node").alias("root"), F.lit(True).alias("probe"), F.lit(True).alias("index"),
                           F.col("n").cast("int").alias("rest"), F.lit(0.0).alias("need"))
    held = _Scratch(groups.sparkSession)
    first = True
    while first or not groups.isEmpty():
        keep = _Scratch(groups.sparkSession)
        pairs, stars = _pairs(groups, percent, first, keep)
        compared = keep(_compared(pairs, sets, percent, keep), "compared")
        labels = _joined(labels, compared.where("similar").select("a", "b"))
        if stars.isEmpty():
            keep.drop()
            break
        first, nxt = False, _Scratch(groups.sparkSession)
        groups = nxt(_open_groups(stars, compared, labels, percent, keep), "groups")
        keep.drop()
        held.drop()
        held = nxt
    held.drop()
    return labels


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept and the keys k1, k2.

    ``percent`` is the Jaccard similarity, in hundredths, from which documents are linked; ``k`` the words of a shingle.
    """
    keep = _Scratch(docs.sparkSession)
    signed, _ = written(signatures(docs, k, bands_for(percent / 100)), "signatures")
    classes = keep(signed.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc"), F.min(F.struct("k1", "k2")).alias("key"), F.first("buckets").alias("buckets"), F.first("n_shingles").alias("n")), "set-classes")
    every = classes.select("node", "n", F.explode("buckets").alias("grp"))
    shared = keep(every.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1").select("grp"), "shared-buckets")
    groups = keep(some_hit(every, shared, "grp").join(shared, "grp"), "groups")
    wanted = keep(groups.select("node").distinct().join(classes, "node").select("node", "key.k1", "key.k2"), "wanted-documents")
    sets = keep(_sets(docs, wanted, k), "compared-sets")
    labels = linked(groups, sets, percent)
    rooted = keep(classes.select("node", "doc").join(labels, "node", "left").select("node", "doc", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    final, _ = written(rooted.join(least, "root").select("node", "component_id"), "components")
    keep.drop()
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (signed.select("doc_id", "k1", "k2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
            .join(final, "node", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "k1", "k2"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of every group, the one with the smallest doc_id, and all documents without words.

    If that id is repeated in the group, one of its texts stays; rows that repeat id and text are one document.
    """
    every = components(docs, k, percent)
    found = every.where("kept")
    of_group = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("k1", "k2")).alias("key")).select("key.*")
    chosen, _ = written(of_group.unionByName(found.where("n_shingles = 0").select("k1", "k2").distinct()), "kept-documents")
    dropped, _ = written(every.select("k1", "k2").distinct().join(chosen, ["k1", "k2"], "left_anti"), "dropped-documents")
    rows, keys = with_keys(docs), ["k1", "k2"]
    if chosen.count() < dropped.count():
        rows = some_hit(rows, chosen, "k1").join(chosen, keys, "left_semi")
    else:  # texts that no dropped key can hit stay where they are
        rows = some_hit(rows, dropped, "k1", False).unionByName(some_hit(rows, dropped, "k1").join(dropped, keys, "left_anti"))
    return rows.select(*docs.columns)
