"""Queries on small functions, and on the parts of a page or an index that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import export, html_sections, images, manifest, markdown
from millrace.operators.retrieval import INSTRUCTION
from millrace.plans.fixtures import STRIP, loose_pages, markdown_docs, table
from millrace.plans.text import IMAGE, SECTION_CHUNKS


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def joined_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with line breaks behind hyphens in place of its commas, cleaned."""
    c = T.clean(F.replace("text", F.lit(", "), F.lit("-\n ")), join_lines=True)
    return _docs(spark, sf_dir).select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("text_md5"))


def md5_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes for a key: a text, its MD5, and the same in capitals, of which only the second does."""
    key = F.md5("text")
    return _docs(spark, sf_dir).select("doc_id", T.is_md5(F.col("text")).alias("plain"), T.is_md5(key).alias("hashed"), T.is_md5(F.upper(key)).alias("capitals"))


def squashed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two numbers of every vector as the scores of a pair."""
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.sigmoid(a * 10), 6).alias("sigmoid"), F.round(V.softmax_second(a * 10, b * 10), 6).alias("softmax"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that a pair scorer reads of every document, with and without an instruction."""
    q = F.coalesce("source", F.lit(""))
    bare, told = T.pair(q, F.col("text")), T.pair(q, F.col("text"), INSTRUCTION)
    return _docs(spark, sf_dir).select("doc_id", F.md5(bare).alias("pair_md5"), F.md5(told).alias("told_md5"), F.length(told).alias("n_chars"))


def usable_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and whole texts as captions, of which those of ten characters or fewer don't count."""
    said = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.col("source"))
    kept = images.usable_description(said, F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")))
    return _docs(spark, sf_dir).select("doc_id", F.length(kept).alias("n_chars"), F.md5(kept).alias("caption_md5"))


def file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows of all documents as Markdown files: their chunks and images."""
    docs = markdown_docs(_docs(spark, sf_dir))
    scan = docs.select("path", F.timestamp_seconds(F.col("doc_id")).alias("mtime"), F.length("text").cast("bigint").alias("size"))
    rows = manifest.entries(scan, markdown.chunks(docs), "2024-01-01 00:00:00")
    return rows.select("path", "size", F.col("chunks_count").cast("bigint").alias("chunks_count"), F.col("images_count").cast("bigint").alias("images_count"), "file_name")


def export_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for every document, of which reserved and hidden keys aren't exported."""
    name = F.when(F.col("doc_id") % 2 == 0, F.lit("_source")).otherwise(F.lit("source"))
    rows = _docs(spark, sf_dir).select("doc_id", F.create_map(F.lit("id_to_idx"), F.lit("0"), F.lit("lang"), F.coalesce("lang", F.lit("")), name, F.coalesce("source", F.lit("")), F.lit("ordered_ids"), F.lit("1")).alias("metadata"))
    kept = F.array_sort(F.map_entries(export.content_metadata()))
    return rows.select("doc_id", F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kept"))


def html_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references as in pages: an alternative text that is a file's name doesn't count, and some names are too long."""
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.repeat(F.coalesce("source", F.lit("x")), (F.col("doc_id") % 60 + 1).cast("int")), F.lit(".png")).alias("src"))
    alt = F.when(F.col("doc_id") % 2 == 0, F.col("src")).otherwise(F.lit("shown"))
    refs = docs.select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("source_file"), "src", alt.alias("alt"), F.lit("").alias("title"))
    files = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("docs/img/"), "src").alias("path"))
    told = images.described(images.resolve(refs, files, blank_file_alt=True))
    return told.select("source_file", "src", "local_path", "found", "error", "description")


def html_without_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of pages without headings: a table of links, a table of content, and the text outside of both."""
    rows = html_sections.sections(loose_pages(_docs(spark, sf_dir)))
    return rows.select("source_file", "section_index", "chunk_id", "title", "heading", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"), F.array_join("links", " ").alias("links"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_S = STRIP.format
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_CAPTION = "CASE WHEN length(said) > 10 THEN said ELSE concat('Image technique de documentation (', doc_id, '.png)') END"

QUERIES = {
    "joined_words": (
        joined_words,
        f"""WITH h AS (SELECT doc_id, regexp_replace(replace(text, ', ', '-' || chr(10) || ' '), '({_WORD}+)-\\s*\\n\\s*({_WORD}+)', '\\1\\2', 'g') AS text FROM documents),
        c AS (SELECT doc_id, {_S("regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f]', '', 'g')")} AS c FROM h)
        SELECT doc_id, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS text_md5 FROM c""",
    ),
    "md5_keys": (md5_keys, "SELECT doc_id, regexp_full_match(text, '[0-9a-f]{32}') AS plain, text IS NOT NULL AS hashed, NOT regexp_matches(md5(text), '[a-f]') AS capitals FROM documents"),
    "squashed_scores": (
        squashed_scores,
        "SELECT vec_id, round(1 / (1 + exp(-a)), 6) AS sigmoid, round(exp(b) / (exp(a) + exp(b)), 6) AS softmax FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS a, CAST(embedding[2] AS DOUBLE) * 10 AS b FROM embeddings)",
    ),
    "scored_pairs": (
        scored_pairs,
        f"SELECT doc_id, md5(p) AS pair_md5, md5(t) AS told_md5, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT doc_id, p, concat('Instruction: ', {_sql(INSTRUCTION)}, chr(10), p) AS t FROM "
        "(SELECT doc_id, 'Query: ' || coalesce(source, '') || chr(10) || 'Document: ' || text AS p FROM documents))",
    ),
    "usable_captions": (
        usable_captions,
        f"SELECT doc_id, CAST(length(k) AS INTEGER) AS n_chars, md5(k) AS caption_md5 FROM (SELECT doc_id, {_CAPTION} AS k FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE source END AS said FROM documents))",
    ),
    "file_entries": (
        file_entries,
        f"{SECTION_CHUNKS}, n AS (SELECT path, count(*) AS chunks, CAST(sum(len(regexp_extract_all(body, {IMAGE}))) AS BIGINT) AS images FROM k WHERE length({_S('content')}) >= 50 GROUP BY path) "
        "SELECT path, CAST(length(text) AS BIGINT) AS size, coalesce(chunks, 0) AS chunks_count, coalesce(images, 0) AS images_count, concat(doc_id, '.md') AS file_name FROM md LEFT JOIN n USING (path)",
    ),
    "export_metadata": (export_metadata, "SELECT doc_id, concat('lang=', coalesce(lang, ''), CASE WHEN doc_id % 2 = 0 THEN '' ELSE concat(',source=', coalesce(source, '')) END) AS kept FROM documents"),
    "html_images": (
        html_images,
        """WITH d AS (SELECT doc_id, concat(repeat(coalesce(source, 'x'), CAST(doc_id % 60 + 1 AS BIGINT)), '.png') AS src FROM documents), f AS (SELECT DISTINCT src AS file FROM d WHERE doc_id % 3 = 0),
        j AS (SELECT doc_id, src, length(src) > 255 AS long, file IS NOT NULL AND length(src) <= 255 AS found FROM d LEFT JOIN f ON src = file)
        SELECT concat('docs/', doc_id, '.html') AS source_file, src, CASE WHEN found THEN concat('docs/img/', src) END AS local_path, found, CASE WHEN long THEN 'filename_too_long' WHEN NOT found THEN 'not_found' END AS error,
               CASE WHEN long THEN concat('Image non traitable (nom trop long): ', substr(src, 1, 30), '...') WHEN NOT found THEN concat('Image non trouvée: ', src)
                    WHEN doc_id % 2 = 0 THEN concat('Image technique de documentation (', src, ')') ELSE 'shown' END AS description FROM j""",
    ),
    "html_without_headings": (
        html_without_headings,
        f"""WITH d AS (SELECT doc_id, concat('loose/', doc_id) AS path, concat('Page ', doc_id) AS title, coalesce(source, 'x') AS source, {_S("coalesce(text, '')")} AS t, {_S("CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN coalesce(lang, '') ELSE coalesce(text, '') END")} AS cell FROM documents),
        c AS (SELECT path, title, 0 AS i, 'nav_table_0' AS k, 'Navigation' AS heading, concat('Navigation - ', title, chr(10), chr(10), 'Sections disponibles:', chr(10), '- ', source) AS content, concat('/', source) AS links FROM d
              UNION ALL SELECT path, title, 1, 'content_table_1', 'Contenu multimédia', concat('Contenu visuel - ', title, chr(10), chr(10), cell), '' FROM d WHERE cell <> ''
              UNION ALL SELECT path, title, 2, 'other_content', 'Contenu général', t, '' FROM d WHERE length(t) > 20)
        SELECT path AS source_file, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INTEGER) AS section_index, md5(concat(path, '_', k)) AS chunk_id, title, heading, CAST(length(content) AS INTEGER) AS n_chars, md5(content) AS content_md5, links FROM c""",
    ),
}
