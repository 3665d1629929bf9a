"""Queries on the state of an index: what changed, what is stored twice, what doesn't fit, what went wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import errors
from millrace.functions.text import safe_name
from millrace.operators import history, integrity, manifest
from millrace.plans.fixtures import SNAPSHOTS, snapshots, table
from millrace.sources import files, state


def manifest_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(table(spark, sf_dir, "documents"))
    return manifest.classify(new, old).select("path", "status")


def manifest_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots(table(spark, sf_dir, "documents"))
    return manifest.deleted(old, new).select("path")


def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, _ = snapshots(table(spark, sf_dir, "documents"))
    s = manifest.stats(old)
    return s.select("total_files", "total_chunks", "total_images", F.unix_timestamp("oldest_index").alias("oldest_index"), F.unix_timestamp("newest_index").alias("newest_index"))


def manifest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest written as JSON and read again."""
    old, _ = snapshots(table(spark, sf_dir, "documents"))
    full = old.withColumn("file_name", F.regexp_extract("path", "[^/]*$", 0))
    again = state.manifest_from_json(state.manifest_to_json(full))
    return again.select("path", F.unix_timestamp("mtime").alias("mtime"), F.unix_timestamp("indexed_at").alias("indexed_at"), "chunks_count", "images_count", "file_name")


def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and times after a run that takes in today's state."""
    old, new = snapshots(table(spark, sf_dir, "documents"))
    cols = ("path", "mtime")
    done = manifest.upsert(old.select(*cols), manifest.to_index(new, old).select(*cols), manifest.deleted(old, new))
    return done.select("path", F.unix_timestamp("mtime").alias("mtime"))


def index_upsert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index keyed by the texts' first lines that takes in every whole text, many with a key that it has."""
    docs = table(spark, sf_dir, "documents")
    line = F.get(F.split("text", "\n"), 0)
    index = docs.groupBy(F.md5(line).alias("chunk_id")).agg(F.min("doc_id").alias("doc_id")).withColumn("version", F.lit(0))
    return manifest.upsert_vectors(index, docs.select(F.md5("text").alias("chunk_id"), "doc_id", F.lit(1).alias("version")), newest="doc_id")


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against documents as their metadata, of which some have no content."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 13 == 0, F.lit(" \n")).otherwise(F.col("text")).alias("content"))
    r = integrity.report(vectors, meta, "id", "content")
    shown = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in r.columns if c.endswith("_sample")}
    return r.withColumns(shown)


def _errors(docs: DataFrame) -> DataFrame:
    short = docs.where(F.length("text") < 300)
    odd = docs.where(F.contains("text", F.lit("@")))
    return errors.rows(short, "parsing_error", "source", "too short", F.length("text")).unionByName(errors.rows(odd, "invalid_html", "source", "mail address"))


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.counts(_errors(table(spark, sf_dir, "documents")))


def error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.examples(_errors(table(spark, sf_dir, "documents"))).select("error_type", "n", "file_path", "message")


def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as files of several formats."""
    pages = table(spark, sf_dir, "pages").select(F.lit(".html").alias("ext"))
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, ".pdf").when(F.col("doc_id") % 4 == 3, ".txt").otherwise(".md").alias("ext"))
    return files.format_counts(pages.unionByName(docs))


def data_set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", safe_name(F.col("text")).alias("name"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages; every fifth turn is a status message."""
    rows = table(spark, sf_dir, "conversations")
    status = F.when(F.col("turn") % 5 == 4, F.create_map(F.lit("title"), F.lit("status")))
    return history.normal(rows.withColumn("metadata", status))


def history_batch_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).where(history.for_batch()).select("conv_id", "turn", "role", "content")


def history_stream_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).where(history.for_stream()).select("conv_id", "turn", "role", "content")


def chat_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.transcript(_said(spark, sf_dir))
    return rows.select("conv_id", "n", F.length("transcript").alias("n_chars"), F.md5("transcript").alias("transcript_md5"))


_ALL = "CASE WHEN old.path IS NULL THEN 'new' WHEN new.mtime > old.mtime THEN 'modified' ELSE 'unchanged' END"
_CHECK = """v AS (SELECT DISTINCT vec_id AS id FROM embeddings), m AS (SELECT doc_id AS id, max(length(CASE WHEN doc_id % 13 = 0 THEN '' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END)) AS n FROM documents GROUP BY 1),
c AS (SELECT coalesce(v.id, m.id) AS id, CASE WHEN m.id IS NULL THEN 'missing_metadata' WHEN v.id IS NULL THEN 'orphan_metadata' WHEN n = 0 THEN 'empty_content' ELSE 'valid' END AS problem FROM v FULL OUTER JOIN m ON v.id = m.id)"""
_SAMPLE = "coalesce((SELECT array_to_string(list(id ORDER BY id)[1:10], ',') FROM c WHERE problem = '{0}'), '') AS {0}_sample"
_ERRORS = "e AS (SELECT 'parsing_error' AS error_type, source AS file_path, 'too short' AS message, CAST(length(text) AS VARCHAR) AS details FROM documents WHERE length(text) < 300 UNION ALL SELECT 'invalid_html', source, 'mail address', '' FROM documents WHERE contains(text, '@'))"
_SAID = "m AS (SELECT conv_id, turn, role, text AS content, turn % 5 = 4 AS status FROM conversations WHERE role IS NOT NULL)"

QUERIES = {
    "manifest_classify": (manifest_classify, f"WITH {SNAPSHOTS} SELECT new.path, {_ALL} AS status FROM new LEFT JOIN old USING (path)"),
    "manifest_deleted": (manifest_deleted, f"WITH {SNAPSHOTS} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)"),
    "manifest_stats": (
        manifest_stats,
        f"WITH {SNAPSHOTS} SELECT count(*) AS total_files, CAST(sum(chunks_count) AS BIGINT) AS total_chunks, CAST(sum(images_count) AS BIGINT) AS total_images, min(indexed_at) AS oldest_index, max(indexed_at) AS newest_index FROM old",
    ),
    "manifest_json": (manifest_json, f"WITH {SNAPSHOTS} SELECT path, mtime, indexed_at, chunks_count, images_count, regexp_extract(path, '[^/]*$') AS file_name FROM old"),
    "manifest_upsert": (manifest_upsert, f"WITH {SNAPSHOTS} SELECT new.path, greatest(new.mtime, coalesce(old.mtime, 0)) AS mtime FROM new LEFT JOIN old USING (path)"),
    "index_upsert_dedup": (
        index_upsert_dedup,
        "WITH o AS (SELECT md5(string_split(text, chr(10))[1]) AS chunk_id, min(doc_id) AS doc_id FROM documents GROUP BY 1), n AS (SELECT md5(text) AS chunk_id, max(doc_id) AS doc_id FROM documents GROUP BY 1) "
        "SELECT chunk_id, coalesce(n.doc_id, o.doc_id) AS doc_id, CAST(CASE WHEN n.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS version FROM o FULL OUTER JOIN n USING (chunk_id)",
    ),
    "integrity_report": (
        integrity_report,
        f"WITH {_CHECK} SELECT count(*) FILTER (problem <> 'orphan_metadata') AS total_vectors, count(*) FILTER (problem <> 'missing_metadata') AS total_metadata, count(*) FILTER (problem = 'valid') AS valid_mappings, "
        "count(*) FILTER (problem = 'missing_metadata') AS missing_metadata_count, count(*) FILTER (problem = 'orphan_metadata') AS orphan_metadata_count, count(*) FILTER (problem = 'empty_content') AS empty_contents_count, "
        f"count(*) FILTER (problem <> 'valid') = 0 AS is_healthy, {_SAMPLE.format('missing_metadata')}, {_SAMPLE.format('orphan_metadata')}, {_SAMPLE.format('empty_content')} FROM c",
    ),
    "error_summary": (
        error_summary,
        f"WITH {_ERRORS} SELECT error_type, CASE error_type WHEN 'parsing_error' THEN 'Parsing Error' ELSE 'Invalid Html' END AS display_name, count(*) AS n, count(DISTINCT file_path) AS n_files FROM e GROUP BY error_type",
    ),
    "error_examples": (
        error_examples,
        f"WITH {_ERRORS} SELECT error_type, CAST(n AS INTEGER) AS n, file_path, message FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY file_path, message, details) AS n FROM e) WHERE n <= 3",
    ),
    "format_counts": (
        format_counts,
        "WITH f AS (SELECT '.html' AS ext FROM pages UNION ALL SELECT CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 3 THEN '.txt' ELSE '.md' END FROM documents) "
        "SELECT count(*) FILTER (ext = '.html') AS html, count(*) FILTER (ext = '.md') AS markdown, count(*) FILTER (ext = '.pdf') AS pdf, count(*) FILTER (ext = '.txt') AS unsupported, count(*) AS total FROM f",
    ),
    "data_set_names": (data_set_names, "SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9_-]', '_', 'g') AS name FROM documents"),
    "history_batch_mode": (history_batch_mode, f"WITH {_SAID} SELECT conv_id, turn, role, content FROM m WHERE role IN ('user', 'assistant') AND NOT status"),
    "history_stream_mode": (history_stream_mode, f"WITH {_SAID} SELECT conv_id, turn, role, content FROM m WHERE NOT status"),
    "chat_transcript": (
        chat_transcript,
        f"WITH {_SAID}, t AS (SELECT conv_id, count(*) AS n, string_agg(concat(role, ': ', coalesce(content, '')), chr(10) ORDER BY turn, concat(role, ': ', coalesce(content, ''))) AS t FROM m GROUP BY conv_id) SELECT conv_id, n, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS transcript_md5 FROM t",
    ),
}
