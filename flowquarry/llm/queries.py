"""The registered queries of the operators in this folder, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch_path
from . import (arc_warc, blob_ledger, bpe, decontaminate, fingerprints, hard_negatives, html_text, line_dedup, minmax_dedup, oracles, quality, spelling,
               token_files, url_rules)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query
def op1_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints.compare_with_next(_table(spark, sf, "documents"))


@_query
def op2_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")).drop("k1", "k2")


@_query
def op3_minmax_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minmax_dedup.components(_table(spark, sf, "documents"), k=3, percent=85).drop("k1", "k2")


@_query
def op4_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)


@_query
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = line_dedup.deduplicate(_table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@_query
def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@_query
def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    pages = html_text.extract(_table(spark, sf, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


URL_RULES = [url_rules.Rule("allow", "org", "/"), url_rules.Rule("block", "example.org", "/es/"),
             url_rules.Rule("block", "example.org", "/en/1"), url_rules.Rule("allow", "com", "/fr/"),
             url_rules.Rule("block", "com", "/de/")]


@_query
def op8_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of a page's URL are those of the document whose id its path ends in: bad quality or toxic means block."""
    pages, labels = _table(spark, sf, "pages"), _table(spark, sf, "labels")
    numbered = pages.select("url", F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)(?:/|\\.html)?(?:[?#]|$)', 1) AS bigint)")
                            .alias("doc_id")).where("doc_id IS NOT NULL")
    label = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "block").otherwise("allow")
    labelled = numbered.join(labels, "doc_id").select("url", label.alias("label"))
    return url_rules.judge(pages, URL_RULES, url_rules.mine(labelled)).drop("confidence")


@_query
def op9_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    scored = docs.select("doc_id", quality.held_out().alias("held_out"), quality.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.KEEP_FROM).cast("int"))


@_query
def op10_arc_to_warc(spark: SparkSession, sf: str) -> DataFrame:
    return (arc_warc.round_trip(_table(spark, sf, "pages"))
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@_query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(_table(spark, sf, "documents"), one_in=199)


@_query
def op12_secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """All documents against a new ledger."""
    rules = blob_ledger.BASE + blob_ledger.ADDED
    found = blob_ledger.scan(_table(spark, sf, "documents").select("doc_id", "text"), rules, scratch_path(spark, "secret-ledger"))
    spans = F.col("findings")
    base = F.filter(spans, lambda s: s["rule_no"] < len(blob_ledger.BASE))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.name) for r in blob_ledger.BASE], F.sha2(blob_ledger.listed(base), 256).alias("base_sha256"), blob_ledger.listed(spans).alias("spans"))


@_query
def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = _table(spark, sf, "embeddings").where("label IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 100 == 0)


ORACLES |= {"op2_benchmark_decontamination": oracles.OP2, "op3_minmax_near_dedup": oracles.OP3, "op5_line_dedup": oracles.OP5,
            "op10_arc_to_warc": oracles.OP10, "op11_spelling_variants": oracles.OP11, "op12_secret_ledger": oracles.op12(blob_ledger.BASE + blob_ledger.ADDED),
            "op13_hard_negatives": oracles.OP13}
