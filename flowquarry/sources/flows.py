"""Flow files: reading, header repair, union, manifest and defined results for empty captures."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.schema import FEATURES, REPEATED_HEADER, RENAMES


def clean_names(names: Sequence[str]) -> list[str]:
    """Trim header names and give the repeated one its ``.1`` suffix, by position."""
    out, seen = [], 0
    for name in (n.strip() for n in names):
        if RENAMES.get(name, name) == REPEATED_HEADER:
            seen += 1
            name = name if seen == 1 else f"{REPEATED_HEADER}.1"
        out.append(name)
    return out


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Header names of the first file below ``path``, exactly as written."""
    files = flow_files(spark, [path])
    line = next((line for line in first_lines(spark, files) if line), None)
    if line is None:
        raise ValueError(f"no header line in {path}")
    return split_header(line)


def split_header(line: str) -> list[str]:
    """Names of a header line, with their blanks; quotes and a byte order mark go."""
    names = next(csv.reader([line.removeprefix("\ufeff")], skipinitialspace=False), [])
    return [n.strip().strip('"') if n.strip().startswith('"') else n for n in names]


def flow_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """All .csv files below ``paths``; a listing, no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(list(paths))
    return sorted(r["path"] for r in files.select("path").collect())


def first_lines(spark: SparkSession, files: Sequence[str], at_once: int = 32) -> list[str]:
    """First line of every file (empty for an empty file), many files at a time.

    Opens each file once and reads to its first line end; like listing, this doesn't depend on the size of the data.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first(file: str) -> str:
        path = jvm.org.apache.hadoop.fs.Path(file)
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(
            path.getFileSystem(conf).open(path), "UTF-8"))
        try:
            return reader.readLine() or ""
        finally:
            reader.close()
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(first, files))


def layouts(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Header line -> the files below ``paths`` that begin with it; files without a line are left out."""
    files = flow_files(spark, paths)
    out: dict[str, list[str]] = {}
    for file, line in zip(files, first_lines(spark, files)):
        if line:
            out.setdefault(line, []).append(file)
    return out


def _canonical(names: Sequence[str]) -> list[str]:
    """Names by which columns of different layouts are the same."""
    return [RENAMES.get(n, n) for n in clean_names(names)]


def _aligned(found: dict[str, list[str]]) -> tuple[list[str], dict[str, list[str]]]:
    """The shared columns in the first layout's order, and the canonical names of every layout."""
    named = {line: _canonical(split_header(line)) for line in found}
    for line, names in named.items():
        odd = sorted({n for n in names if names.count(n) > 1} | {n for n in names if not n})
        if odd and len(found) > 1:
            raise ValueError(f"can't align columns named {odd} of {found[line][:3]}")
    first = next(iter(named.values()))
    shared = [n for n in first if all(n in names for names in named.values())]
    if not shared:
        raise ValueError("no column is shared by the headers of " + ", ".join(f[0] for f in found.values()))
    return shared, named


def _one_layout(spark: SparkSession, paths: Sequence[str], raw: Sequence[str], names: Sequence[str],
                key: str, same: bool) -> DataFrame:
    """Files whose columns stand as in ``raw``; cells go by position, so that repeated and padded names are safe."""
    fields = names if same else raw
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    df = (spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv")
          .option("enforceSchema", same).csv(list(paths)))
    source = F.col(f"_metadata.{key}").alias("source_file")
    return df.select(source, *[F.col(f"`{f}`").alias(n) for f, n in zip(fields, names)])


def read_flows(spark: SparkSession, paths: str | Sequence[str],
               header: Sequence[str] | None = None, key: str = "file_name") -> DataFrame:
    """Flow CSV files, all cells as text, plus ``source_file``.

    The first line of every file is read beforehand. Files with equal lines are one layout with one parser, whose
    names go by position. Columns of several layouts are matched by name (trimmed, renamed, the second of the repeated
    name with its suffix); the result has those that every layout has, spelled as in the first one. Files
    that can't be aligned are named in an error. Empty files have no rows. With ``header``, all files are read by
    these names, without looking at the files; Spark then checks every file's header unless a name is repeated.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if header:
        repeated = len({n.strip().lower() for n in header}) < len(header)
        return _one_layout(spark, paths, list(header), clean_names(header), key, repeated)
    found = layouts(spark, paths)
    if not found:
        raise ValueError(f"no header line in {paths[0]}")
    spelled = clean_names(split_header(next(iter(found))))
    if len(found) == 1:
        return _one_layout(spark, paths, split_header(next(iter(found))), spelled, key, True)
    shared, named = _aligned(found)
    shown = dict(zip(_canonical(spelled), spelled))
    parts = []
    for line, files in found.items():
        one = _one_layout(spark, [_literal(f) for f in files], split_header(line), named[line], key, True)
        parts.append(one.select("source_file", *[F.col(f"`{n}`").alias(shown[n]) for n in shared]))
    return reduce(DataFrame.unionByName, parts)


def _literal(path: str) -> str:
    """``path`` with its characters that patterns of paths use escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def normalize_headers(df: DataFrame) -> DataFrame:
    """Strip blanks around every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def dedupe_header(df: DataFrame) -> DataFrame:
    """Second ``Fwd Header Length`` becomes ``Fwd Header Length.1``."""
    return df.toDF(*clean_names(df.columns))


def union_flows(dfs: Sequence[DataFrame]) -> DataFrame:
    """Rows of all inputs; columns are those every input has, in the first one's order."""
    shared = [c for c in dfs[0].columns if all(c in d.columns for d in dfs[1:])]
    quoted = [f"`{c}`" for c in shared]
    return reduce(DataFrame.unionByName, [d.select(*quoted) for d in dfs])


def capture_manifest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Name and size in bytes of every flow file, including files without data rows."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(paths))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source_file"),
                        F.col("length").alias("size_bytes"))


def empty_capture_rows(manifest: DataFrame, findings: DataFrame) -> DataFrame:
    """Give every listed capture a findings row; those without flows get the defined defaults."""
    out = manifest.select("source_file").join(findings, "source_file", "left")
    typed = {f.name: f.dataType for f in findings.schema.fields}
    fill = {
        "row_count": F.lit(0), "feature_count": F.lit(len(FEATURES)), "flow_count": F.lit(0),
        "status": F.lit("normal"), "attack_detected": F.lit(False),
        "confidence": F.lit(0.0), "attack_ratio": F.lit(0.0),
        "dominant_class": F.lit("Normal"),
        "class_distribution": F.expr("map()"),
    }
    cols = [F.coalesce(F.col(c), fill[c].cast(typed[c])).alias(c) if c in fill else F.col(c)
            for c in out.columns]
    return out.select(*cols)
