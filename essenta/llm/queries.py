"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from essenta.llm import (
    exact_dedup, html_text, mixing, packing, periodic_runs, pii, quality_classifier, quality_rules, simhash, spelling, suffix_dedup,
    toxicity, warc)
from essenta.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), keep_text=False)


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op3_html_layout")
def op3(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("op4_suffix_passages")
def op4(spark, sf_dir):
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@query("op5_weak_toxicity")
def op5(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("hits")


@query("op6_zip_archives", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f""")
def op6(spark, sf_dir):
    folder = scratch_path(spark, "warc")
    warc.write_packages(table(spark, sf_dir, "pages"), folder)
    return warc.read_packages(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_mix_sources")
def op7(spark, sf_dir):
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


@query("op8_simhash_vantage")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_exact_dedup", """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)""")
def op9(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op10_perplexity_bands")
def op10(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def planted_period(doc_id, words: list[str]) -> list[str]:
    """The words with a repeated stretch planted in a tenth of the documents, by a hash of the id."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    block = words[a:a + 1 + (len(words) - a) // (3 + g % 8)]
    return (words[:a] + block * (1 + (len(words) - a) // len(block)))[:len(words)]


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    return periodic_runs.report(periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), planted_period))


@query("op12_pii_spans")
def op12(spark, sf_dir):
    return pii.report(pii.find_pii(table(spark, sf_dir, "documents")))


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spelling.dropped_letter)


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
