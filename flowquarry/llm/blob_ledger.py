"""Secrets in versioned texts, scanned once per content and rule version.

Every version of every path is named by the SHA-256 of its text (the blob). A ledger below a folder says which
pairs of blob and rule version were scanned and what was found. A scan takes the pairs that the ledger lacks, reads the text of one
path of each such blob, adds the result to the ledger as a new batch, and joins findings back to all paths. New
versions of old texts, copies and unchanged rules cost no matching; a rule with a new version is matched against every blob again.

A batch counts when its mark stands, which is written last; what a broken run leaves is not read. Two runs at once
may scan a pair twice; equal findings of a pair count once.

Rows are joined by blob and a hash of the path's columns, so copies of one text don't meet in one partition. All matching is done by SQL functions.
A null text is an empty one. Repeated rows each get their findings. Columns of the versions are kept, whatever their
names, but for ``text``; a column called ``findings`` is replaced. An empty table leaves the ledger as it is.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_paths, written


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` whose ``group`` has at least ``least`` code points; a change needs a new version."""
    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


_KEY = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE = [
    Rule("assign", 1, _KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),  # the same as longer runs of which the short ones are dropped
    Rule("hex", 1, "[0-9a-f]{24,}"),
]
ADDED = [
    Rule("pem", 1, r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("basic", 1, r"[a-z]+://[A-Za-z0-9_.-]+:[A-Za-z0-9_.-]+@"),
]
_SCANNED, _FOUND = "blob binary, rule string, version int", "blob binary, rule string, version int, start long, end long"
_MARK = "_COMPLETE"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _batches(spark: SparkSession, ledger: str) -> list[str]:
    fs, marks = _folder(spark, f"{ledger}/batch-*/{_MARK}")
    return sorted(str(s.getPath().getParent()) for s in fs.globStatus(marks) or [])


def _table(spark: SparkSession, ledger: str, name: str, schema: str) -> DataFrame:
    paths = [f"{b}/{name}" for b in _batches(spark, ledger)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def scanned(spark: SparkSession, ledger: str) -> DataFrame:
    """Pairs in the ledger: blob, rule, version."""
    return _table(spark, ledger, "scanned", _SCANNED)


def found(spark: SparkSession, ledger: str) -> DataFrame:
    """Findings in the ledger: blob, rule, version, start, end (code points, end exclusive)."""
    return _table(spark, ledger, "found", _FOUND)


def _named(rules: list[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])


def unseen(paths: DataFrame, rules: list[Rule], ledger: str) -> DataFrame:
    """Of every blob with pairs that the ledger lacks: blob, row (of one path) and ``open``, the array of (rule, version)."""
    spark = paths.sparkSession
    blobs = paths.groupBy("blob").agg(F.min("row").alias("row"))
    if not _batches(spark, ledger):
        return blobs.withColumn("open", _named(rules))
    pairs = blobs.select("blob", "row", F.explode(_named(rules)).alias("r")).select("blob", "row", "r.rule", "r.version")
    return (pairs.join(scanned(spark, ledger), ["blob", "rule", "version"], "left_anti")
            .groupBy("blob", "row").agg(F.collect_set(F.struct("rule", "version")).alias("open")))


def _matches(rule: Rule) -> Column:
    """Lengths of what stands before each match, of the match and of its group; null without a match."""
    pattern, text = F.lit(rule.pattern), F.col("text")
    # the texts between matches and the matches give all positions; the last text has no match after it
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"))
    lengths = F.transform(parts, lambda x: F.struct(*[F.length(x[c]).cast("long").alias(c) for c in ("gap", "hit", "part")]))
    wanted = F.exists("open", lambda o: (o["rule"] == rule.name) & (o["version"] == rule.version))
    return F.when(wanted & F.regexp_like(text, pattern), lengths)


def findings(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """blob, rule, version, start, end of all matches in ``texts`` (blob, text, open)."""
    per_rule = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                                  _matches(r).alias("parts")) for r in rules])
    hit = texts.select("blob", F.explode(per_rule).alias("r")).select("blob", "r.*").where("parts IS NOT NULL")
    once = hit.groupBy("blob", "rule", "version").agg(F.first("least").alias("least"), F.first("parts").alias("parts"))
    each = once.select("blob", "rule", "version", "least", F.posexplode_outer("parts").alias("i", "p"))
    end = F.sum(F.col("p.gap") + F.coalesce("p.hit", F.lit(0))).over(W.partitionBy("blob", "rule", "version").orderBy("i"))
    return (each.withColumn("end", end).where(F.col("p.part") >= F.col("least"))
            .select("blob", "rule", "version", (F.col("end") - F.col("p.hit")).alias("start"), "end"))


def update(versions: DataFrame, paths: DataFrame, rules: list[Rule], ledger: str) -> None:
    """Scan the open pairs of ``versions`` (with ``blob``, ``row``, ``text``) and add them to the ledger."""
    spark = versions.sparkSession
    todo, todo_path = written(unseen(paths, rules, ledger), "unseen-blobs")
    if todo.isEmpty():
        return drop_paths(spark, [todo_path])
    batch = f"{ledger}/batch-{uuid.uuid4().hex}"
    findings(versions.select("blob", "row", "text").join(todo, ["blob", "row"]), rules).write.parquet(f"{batch}/found")
    todo.select("blob", F.explode("open").alias("r")).select("blob", "r.*").write.parquet(f"{batch}/scanned")
    fs, mark = _folder(spark, f"{batch}/{_MARK}")
    fs.create(mark, True).close()
    drop_paths(spark, [todo_path])


def scan(versions: DataFrame, rules: list[Rule], ledger: str) -> DataFrame:
    """All columns of ``versions`` but ``text``, and ``findings``: array of (start, rule_no, end, rule), in order.

    rule_no is the rule's place in ``rules``.
    """
    spark = versions.sparkSession
    others = [c for c in versions.columns if c not in ("text", "findings")]
    # inner columns stand apart from those of the versions, whatever these are called
    wrapped = versions.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("path"), blob_of(F.col("text")).alias("blob"), "text")
    keyed = wrapped.withColumn("row", F.xxhash64(F.to_json("path")))
    paths, _ = written(keyed.select("path", "blob", "row"), "paths")
    update(keyed, paths, rules, ledger)
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")), F.lit(i))])
    known = found(spark, ledger).distinct().withColumn("rule_no", place[F.struct("rule", "version")]).where("rule_no IS NOT NULL")
    per_blob, _ = written(known.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rule_no", "end", "rule"))).alias("findings")), "blob-findings")
    none = F.array().cast("array<struct<start:bigint,rule_no:int,end:bigint,rule:string>>")
    return paths.join(per_blob, "blob", "left").select("path.*", F.coalesce("findings", none).alias("findings"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every finding, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")
