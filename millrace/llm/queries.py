"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, extract, langid, mixing, quality, secrets, simhash, tiff, toxicity, warc
from millrace.llm.shared import fresh_path, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", (langid.remainder() == 2).alias("held_out"), "lang_pred", "score")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "copy_no", F.round("rate", 6).alias("rate"), "shuffle_key")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")
    return warc.read_archives(spark, path, payloads=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), F.col("target_uri").alias("url"), "intact"
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_texts(table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("bigint"), "media_sha256": F.sha2("media", 256)})
    return tiff.tiff_pages(stored).select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("bigint").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.format_string("page=%d;size=%dx%dx%d;bits=%d;compression=%d;predictor=%d;histogram=%s", "page", "width", "height", "samples", "bits", "compression", "predictor", F.array_join(F.col("histogram").cast("array<string>"), ",")).alias("feature"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction, "op2_language_id": op2_language_id, "op3_simhash_dedup": op3_simhash_dedup, "op4_secret_scan": op4_secret_scan, "op5_decontamination": op5_decontamination,
        "op6_source_mixing": op6_source_mixing, "op7_warc": op7_warc, "op8_quality": op8_quality, "op9_toxicity": op9_toxicity, "op10_tiff": op10_tiff,
    }
