"""URL filters: fixed rules by host and path, else association rules mined from labelled URLs.

A URL's tokens are the suffixes of its host, the words of its path and the names of its query; numbers
count as one token. FP-growth finds the token combinations of labelled URLs; those that imply the label
``block`` with at least ``min_confidence``, and occur in at least ``min_support`` of the labelled URLs,
become rules. Every rule is filed under its rarest token; a URL looks up its own tokens in that
inverted index, and a rule matches if the URL has all its tokens.

Null URLs and URLs without ``://`` have neither host nor path nor tokens; no rule fits them and they are
allowed. Without labelled URLs no rule is mined. Repeated rows each get a verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
_BLOCK = "label=block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Host (with port, if any), A-Z lower-cased; empty for nulls and URLs without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits a host, or a subdomain of it, and the start of the path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    hosts = F.transform(labels, lambda x, i: F.concat(
        F.lit("host="), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))
    words = F.filter(F.split(ascii_lower(path_of(url)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1)), lambda x: x != "")
    number = lambda x: F.when(x.rlike(r"^\p{N}+$"), F.lit("0")).otherwise(x)
    every = F.concat(hosts, F.transform(words, lambda x: F.concat(F.lit("path="), number(x))),
                     F.transform(names, lambda x: F.concat(F.lit("query="), x)))
    return F.coalesce(F.array_distinct(every), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, confidence, support) that imply a block, from (url, label) with label ``block`` or ``allow``."""
    items = (labelled.where("label IS NOT NULL")
             .select(F.concat(tokens_of(F.col("url")), F.array(F.concat(F.lit("label="), F.col("label")))).alias("items")))
    if items.isEmpty():
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    return (found.associationRules.where(F.col("consequent") == F.array(F.lit(_BLOCK)))
            .where(~F.exists("antecedent", lambda x: x.startswith("label=")))
            .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` values that some rule matches, with the highest confidence."""
    tokens = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("uses"))
    filed = (rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(tokens, "token")
             .groupBy("tokens", "confidence").agg(F.min(F.struct("uses", "token"))["token"].alias("token")))
    each = urls.select("url").where("url IS NOT NULL").distinct().withColumn("has", tokens_of(F.col("url")))
    return (each.select("url", "has", F.explode("has").alias("token")).join(filed, "token")
            .where(F.size(F.array_except("tokens", "has")) == 0)
            .groupBy("url").agg(F.max("confidence").alias("confidence")))


def judge(pages: DataFrame, rules: Sequence[Rule], mined: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of the mined rule that matches, else null) for every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    return (parsed.join(matched(pages.select("url"), mined), "url", "left")
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                    "confidence"))
