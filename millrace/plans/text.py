"""Queries on texts: cleaning, sentences, paragraphs, chunks, Markdown and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, images, markdown, metadata, pages
from millrace.plans.fixtures import MARKDOWN_DOCS, PAGE_TEXTS, SPACED_DOCS, STRIP, WINDOWS, markdown_docs, page_texts, spaced_docs, table, windows
from millrace.providers import HashingEmbedder
from millrace.sources.work import fresh_path, written


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _path(docs: DataFrame) -> DataFrame:
    return docs.withColumn("path", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(c).alias("n_chars"), F.md5(c).alias("text_md5"))


def word_char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length("text").alias("char_count"), F.size(T.words(F.col("text"))).alias("word_count"))


def chunk_metadata_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = F.concat(F.lit("archive/"), F.repeat(F.col("source"), 120), F.lit("/"), F.col("doc_id").cast("string"))
    rows = _docs(spark, sf_dir).select("doc_id", long.alias("source_file"), F.col("text").alias("title"), F.lit("").alias("heading"), F.col("text").alias("content"))
    cols = metadata.projected(rows)
    return rows.select("doc_id", cols["source_file"].alias("source_file"), cols["title"].alias("title"), cols["content_length"].alias("content_length"), F.md5(cols["chunk_content"]).alias("preview_md5"), F.length(cols["chunk_content"]).alias("preview_length"))


def enriched_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the image descriptions that its words name; some are empty."""
    rows = markdown_docs(_docs(spark, sf_dir)).select("doc_id", "text", F.transform(markdown.images(F.col("text")), lambda i: F.when(F.length(i["alt"]) > 3, i["alt"]).otherwise("")).alias("d"))
    e = images.enriched(F.col("text"), F.col("d"))
    return rows.select("doc_id", F.size("d").alias("n_images"), F.length(e).alias("n_chars"), F.md5(e).alias("content_md5"))


def chunk_ids_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.single_chunks(_path(_docs(spark, sf_dir))).select("source_file", "chunk_id", "char_count", "word_count")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = chunking.raw_sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).alias("longest"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


def sentence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.each(_docs(spark, sf_dir), chunking.sentences(F.col("text")), "pos", "sentence", "doc_id")


def paragraph_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.each(spaced_docs(_docs(spark, sf_dir)), chunking.paragraphs(F.col("text")), "pos", "paragraph", "doc_id")
    return rows.select("doc_id", "pos", F.length("paragraph").alias("n_chars"), F.md5("paragraph").alias("paragraph_md5"))


def chunk_route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(chunking.route(F.col("text")).alias("route")).agg(F.count("*").alias("n"))


def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.each(_docs(spark, sf_dir), chunking.size_chunks(F.col("text")), "chunk_index", "c", "doc_id")
    return rows.select("doc_id", "chunk_index", F.length("c").alias("n_chars"), F.md5("c").alias("chunk_md5"))


def size_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the chunks of all documents."""
    n = F.length("c")
    rows = T.each(_docs(spark, sf_dir), chunking.size_chunks(F.col("text")), "k", "c")
    return rows.agg(F.count("*").alias("chunks"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("total_chars"))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.document_chunks(_path(_docs(spark, sf_dir)), HashingEmbedder().encode)


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by size of spaced documents, paragraph by paragraph."""
    return chunking.document_chunks(_path(spaced_docs(_docs(spark, sf_dir))), sizes=chunking.ChunkSizes(semantic=False))


def markdown_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_docs(_docs(spark, sf_dir)).select("doc_id", markdown.title(F.col("text")).alias("title"))


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(markdown_docs(_docs(spark, sf_dir))).select("path", "start_line", "level", "heading", F.length("body").alias("body_length"), F.md5("body").alias("body_md5"))


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = markdown.chunks(markdown_docs(_docs(spark, sf_dir)))
    return rows.select("chunk_id", "source_file", "title", "heading", F.length("content").alias("content_length"), F.md5("content").alias("content_md5"), F.size("images").alias("n_images"), F.size("links").alias("n_links"))


def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.each(markdown_docs(_docs(spark, sf_dir)), markdown.links(F.col("text")), "pos", "link", "doc_id")


def markdown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.each(markdown_docs(_docs(spark, sf_dir)), markdown.images(F.col("text")), "pos", "i", "doc_id")
    return rows.select("doc_id", "pos", "i.src", "i.alt", "i.title")


def _image_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References of all derived documents, and a file for two thirds of the names: beside the documents or in a folder below.

    Written once, as the names of the files come from the references.
    """
    docs = markdown_docs(_docs(spark, sf_dir)).withColumnRenamed("path", "source_file")
    rows = written(T.each(docs, markdown.images(F.col("text")), "pos", "i", "source_file").select("source_file", "pos", "i.*"), fresh_path(spark, "references"))
    kind = F.conv(F.substring(F.md5("src"), 1, 1), 16, 10).cast("int") % 3
    names = rows.select("src").distinct().where(~F.contains("src", F.lit("/")))
    files = names.select(F.when(kind == 0, F.concat(F.lit("docs/"), "src")).when(kind == 1, F.concat(F.lit("docs/img/"), "src")).alias("path"))
    return rows, files.where("path is not null")


def image_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = images.described(images.resolve(*_image_rows(spark, sf_dir)))
    return told.select("source_file", "pos", "src", "local_path", "found", "error", "description")


def title_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every first line as a span of a made-up size and style."""
    line = F.get(F.split("text", "\n"), 0)
    size, flags = (F.col("doc_id") % 20).cast("double"), (F.col("doc_id") % 32).cast("int")
    text = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Section 3 "), line)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("1.2 "), line)).otherwise(line)
    return _docs(spark, sf_dir).select("doc_id", chunking.is_title(text, size, flags).alias("is_title"))


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_offsets(page_texts(_docs(spark, sf_dir)))


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.whole_text(page_texts(_docs(spark, sf_dir)))
    return rows.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = pages.chunk_pages(windows(docs), pages.page_offsets(page_texts(docs)))
    return found.select("doc_id", "chunk_index", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("page_numbers"))


def avg_doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return _docs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("avg_length"), F.min(n).alias("shortest"), F.max(n).alias("longest"))


_S = STRIP.format
_ONE_SPACE = "regexp_replace(text, '\\s+', ' ', 'g')"
_MD = f"WITH md AS ({MARKDOWN_DOCS})"
_SECTIONS = f"""{_MD},
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM md),
h AS (SELECT path, pos, line, {_S('line')} AS s, starts_with({_S('line')}, '#') AS head FROM l),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS sec FROM h),
sec AS (SELECT path, CAST(min(pos) AS INTEGER) AS start_line, CAST(coalesce(max(length(s) - length(regexp_replace(s, '^#+', ''))) FILTER (head), 0) AS INTEGER) AS level,
        coalesce(max({_S("regexp_replace(s, '^#+', '')")}) FILTER (head), '') AS heading, {_S("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT head), '')")} AS body
        FROM g GROUP BY path, sec)"""
IMAGE = r"""'!\[([^\]]*)\]\(([^\)\s]+)(?:\s+"([^"]+)")?\)'"""
_LINK = r"'\[([^\]]+)\]\(([^\)]+)\)'"
_PIECES = f"p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[.!?]\\s+'), lambda x: {_S('x')}), lambda x: x <> '') AS s FROM documents)"
_TITLE = f"coalesce({_S('''substr(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: starts_with(x, '# '))[1], 3)''')}, 'Document technique')"
SECTION_CHUNKS = f"{_SECTIONS}, t AS (SELECT path, {_TITLE} AS title FROM md), k AS (SELECT *, CASE WHEN heading <> '' THEN concat(heading, chr(10), chr(10), body) ELSE body END AS content FROM sec JOIN t USING (path))"
_PARAGRAPHS = f"""d AS ({SPACED_DOCS}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
f AS (SELECT doc_id, {_S('x')} AS x, i FROM l WHERE {_S('x')} <> ''), n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 2 THEN 1 ELSE 0 END AS new FROM f),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n), p AS (SELECT doc_id, k, string_agg(x, chr(10) ORDER BY i) AS t FROM g GROUP BY doc_id, k)"""


def _chunks(before: str, texts: str) -> str:
    """Common table expressions up to cut (doc_id, part, chunk_index, c): runs of words, one step of the recursion for each."""
    return f"""WITH RECURSIVE {before}
w AS (SELECT doc_id, part, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM ({texts})),
u AS (SELECT doc_id, part, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
e AS (SELECT doc_id, part, i, sum(length(word) + 1) OVER (PARTITION BY doc_id, part ORDER BY i) AS ending FROM u),
c AS (SELECT doc_id, part, list(CAST(ending AS BIGINT) ORDER BY i) AS ends FROM e GROUP BY doc_id, part),
r AS (
    SELECT doc_id, part, 0 AS k, CAST(0 AS BIGINT) AS start, CAST(greatest(1, len(list_filter(ends, lambda x: x <= 1000)), len(list_filter(ends, lambda x: x < 301)) + 1) AS BIGINT) AS stop FROM c
    UNION ALL
    SELECT doc_id, part, k, start, CAST(greatest(old + 1, len(list_filter(ends, lambda x: x <= base + 1000)), len(list_filter(ends, lambda x: x < base + 301)) + 1) AS BIGINT)
    FROM (SELECT *, CASE WHEN start = 0 THEN 0 ELSE ends[start] END AS base
          FROM (SELECT r.doc_id, r.part, r.k + 1 AS k, r.stop AS old, ends, CAST(greatest(r.start, len(list_filter(ends, lambda x: x <= ends[r.stop] - 100))) AS BIGINT) AS start FROM r JOIN c USING (doc_id, part) WHERE r.stop < len(ends)))
),
t AS (SELECT r.doc_id, part, CAST(k AS INTEGER) AS chunk_index, array_to_string(ws[start + 1 : least(stop, len(ws))], ' ') AS c FROM r JOIN w USING (doc_id, part)),
cut AS (SELECT * FROM t WHERE length(c) >= 300)"""


_CHUNKS = _chunks("", "SELECT doc_id, 0 AS part, text FROM documents")
_PART_CHUNKS = _chunks(_PARAGRAPHS + ",", "SELECT doc_id, k AS part, t AS text FROM p WHERE length(t) > 1500")

QUERIES = {
    "clean_text": (clean_text, f"SELECT doc_id, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS text_md5 FROM (SELECT doc_id, {_S(_ONE_SPACE)} AS c FROM documents)"),
    "word_char_counts": (word_char_counts, "SELECT doc_id, CAST(length(text) AS INTEGER) AS char_count, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS word_count FROM documents"),
    "chunk_metadata_truncation": (
        chunk_metadata_truncation,
        "SELECT doc_id, CASE WHEN length(f) > 400 THEN concat('...', f[-397:]) ELSE f END AS source_file, substr(text, 1, 200) AS title, CAST(length(text) AS INTEGER) AS content_length, md5(p) AS preview_md5, CAST(length(p) AS INTEGER) AS preview_length "
        "FROM (SELECT *, concat('archive/', repeat(source, 120), '/', doc_id) AS f, CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), '...') ELSE text END AS p FROM documents)",
    ),
    "enriched_content": (
        enriched_content,
        f"{_MD}, d AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, {IMAGE}, 1), lambda x: CASE WHEN length(x) > 3 THEN x ELSE '' END) AS d FROM md), "
        "e AS (SELECT doc_id, d, CASE WHEN len(list_filter(d, lambda x: x <> '')) > 0 THEN concat(text, chr(10), chr(10), 'Images: ', array_to_string(list_filter(d, lambda x: x <> ''), ' | ')) ELSE text END AS c FROM d) "
        "SELECT doc_id, CAST(len(d) AS INTEGER) AS n_images, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS content_md5 FROM e",
    ),
    "chunk_ids_md5": (
        chunk_ids_md5,
        f"SELECT concat('docs/', doc_id) AS source_file, md5(concat('docs/', doc_id, '_', substr(text, 1, 100))) AS chunk_id, CAST(length(text) AS INTEGER) AS char_count, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS word_count FROM documents WHERE length({_S('text')}) >= 300",
    ),
    "sentence_split": (
        sentence_split,
        f"WITH {_PIECES} SELECT doc_id, CAST(len(s) AS INTEGER) AS n, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest, md5(array_to_string(s, '|')) AS sentences_md5 FROM p",
    ),
    "sentence_merge": (
        sentence_merge,
        f"WITH {_PIECES}, u AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM p), g AS (SELECT *, sum(CASE WHEN i = 1 OR length(x) >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM u) "
        "SELECT doc_id, CAST(k - 1 AS INTEGER) AS pos, string_agg(x, '. ' ORDER BY i) AS sentence FROM g GROUP BY doc_id, k",
    ),
    "paragraph_islands": (
        paragraph_islands,
        f"WITH {_PARAGRAPHS} "
        "SELECT doc_id, CAST(k AS INTEGER) AS pos, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS paragraph_md5 FROM p",
    ),
    "chunk_route_counts": (chunk_route_counts, "SELECT CASE WHEN length(text) <= 1500 THEN 'single' ELSE 'semantic' END AS route, count(*) AS n FROM documents GROUP BY 1"),
    "size_chunks": (size_chunks, f"{_CHUNKS} SELECT doc_id, chunk_index, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS chunk_md5 FROM cut"),
    "size_chunk_stats": (size_chunk_stats, f"{_CHUNKS} SELECT count(*) AS chunks, CAST(min(length(c)) AS INTEGER) AS shortest, CAST(max(length(c)) AS INTEGER) AS longest, CAST(sum(length(c)) AS BIGINT) AS total_chars FROM cut"),
    "semantic_chunks": (semantic_chunks, None),
    "document_chunks": (
        document_chunks,
        f"{_PART_CHUNKS}, a AS (SELECT doc_id, part, chunk_index, c FROM cut UNION ALL SELECT doc_id, k, 0, t FROM p WHERE length(t) BETWEEN 300 AND 1500), "
        "o AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, chunk_index) - 1 AS INTEGER) AS idx, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total FROM a), "
        "s AS (SELECT *, regexp_replace(c, '\\s+', ' ', 'g') AS content, md5(concat('docs/', doc_id, '_', substr(c, 1, 100))) AS legacy FROM o) "
        "SELECT concat('docs/', doc_id) AS source_file, content, legacy AS legacy_id, CAST(length(c) AS INTEGER) AS char_count, CAST(len(string_split(content, ' ')) AS INTEGER) AS word_count, idx AS chunk_index, total AS total_chunks, md5(concat(legacy, '_', idx)) AS chunk_id "
        "FROM s WHERE length(content) >= 300",
    ),
    "markdown_title": (markdown_title, f"{_MD} SELECT doc_id, {_TITLE} AS title FROM md"),
    "markdown_sections": (markdown_sections, f"{_SECTIONS} SELECT path, start_line, level, heading, CAST(length(body) AS INTEGER) AS body_length, md5(body) AS body_md5 FROM sec"),
    "markdown_chunks": (
        markdown_chunks,
        f"{SECTION_CHUNKS} "
        "SELECT md5(concat(path, '_', start_line, '_', heading)) AS chunk_id, path AS source_file, title, CASE WHEN heading = '' THEN 'Contenu principal' ELSE heading END AS heading, CAST(length(content) AS INTEGER) AS content_length, md5(content) AS content_md5, "
        f"CAST(len(regexp_extract_all(body, {IMAGE})) AS INTEGER) AS n_images, CAST(len(list_filter(regexp_extract_all(body, {_LINK}, 2), lambda x: NOT starts_with(x, '#'))) AS INTEGER) AS n_links FROM k WHERE length({_S('content')}) >= 50",
    ),
    "markdown_links": (
        markdown_links,
        f"{_MD}, l AS (SELECT doc_id, list_filter(regexp_extract_all(text, {_LINK}, 2), lambda x: NOT starts_with(x, '#')) AS l FROM md) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS link FROM l",
    ),
    "markdown_images": (
        markdown_images,
        f"{_MD}, l AS (SELECT doc_id, regexp_extract_all(text, {IMAGE}, 2) AS a, regexp_extract_all(text, {IMAGE}, 1) AS b, regexp_extract_all(text, {IMAGE}, 3) AS c FROM md) SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS src, unnest(b) AS alt, coalesce(unnest(c), '') AS title FROM l",
    ),
    "image_resolution": (
        image_resolution,
        f"""{_MD}, l AS (SELECT path, regexp_extract_all(text, {IMAGE}, 2) AS a, regexp_extract_all(text, {IMAGE}, 1) AS b, regexp_extract_all(text, {IMAGE}, 3) AS c FROM md),
        r AS (SELECT path AS source_file, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS src, unnest(b) AS alt, unnest(c) AS title FROM l),
        k AS (SELECT *, CAST('0x' || substr(md5(src), 1, 1) AS BIGINT) % 3 AS kind, regexp_extract(src, '[^/]*$') AS name, regexp_matches(src, '^https?://') AS outside FROM r),
        f AS (SELECT DISTINCT kind, src FROM k WHERE NOT contains(src, '/') AND kind < 2),
        p AS (SELECT DISTINCT src AS name, CASE kind WHEN 0 THEN 'docs/' ELSE 'docs/img/' END || src AS file FROM f),
        j AS (SELECT k.*, CASE WHEN outside THEN NULL ELSE p.file END AS local_path FROM k LEFT JOIN p USING (name))
        SELECT source_file, pos, src, local_path, local_path IS NOT NULL AS found, CASE WHEN local_path IS NULL AND NOT outside THEN 'not_found' END AS error,
               CASE WHEN outside THEN 'Image externe ou non accessible: ' || coalesce(nullif(alt, ''), nullif(title, ''), name) WHEN local_path IS NULL THEN 'Image non trouvée: ' || name
                    ELSE coalesce(nullif(alt, ''), nullif(title, ''), 'Image technique de documentation (' || name || ')') END AS description FROM j""",
    ),
    "title_spans": (
        title_spans,
        "SELECT doc_id, length(t) BETWEEN 5 AND 200 AND (doc_id % 20 > 14 OR (doc_id % 32) & 16 <> 0 OR regexp_matches(t, '^(\\d+\\.?)+\\s+\\w+') OR regexp_matches(t, '(?i)^(Chapter|Section|Part)\\s+\\d+')) AS is_title "
        "FROM (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'Section 3 ' WHEN 2 THEN '1.2 ' ELSE '' END || string_split(text, chr(10))[1] AS t FROM documents)",
    ),
    "page_offsets": (
        page_offsets,
        f"WITH p AS ({PAGE_TEXTS}) SELECT doc_id, page, CAST(s - n AS BIGINT) AS start_at, CAST(s - 1 AS BIGINT) AS end_at FROM (SELECT doc_id, page, length(text) + 1 AS n, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page) AS s FROM p)",
    ),
    "whole_texts": (whole_texts, f"WITH p AS ({PAGE_TEXTS}), w AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page) AS t FROM p GROUP BY doc_id) SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM w"),
    "chunk_pages": (
        chunk_pages,
        f"WITH p AS ({PAGE_TEXTS}), o AS (SELECT doc_id, page, s - n AS a, s - 1 AS b FROM (SELECT doc_id, page, length(text) + 1 AS n, sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page) AS s FROM p)), w AS ({WINDOWS}) "
        "SELECT w.doc_id, w.chunk_index, array_to_string(list(DISTINCT o.page ORDER BY o.page)[1:5], ',') AS page_numbers FROM w JOIN o ON w.doc_id = o.doc_id AND w.start_at < o.b AND o.a < w.end_at GROUP BY w.doc_id, w.chunk_index",
    ),
    "avg_doc_length": (avg_doc_length, "SELECT count(*) AS n, round(avg(length(text)), 4) AS avg_length, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest FROM documents"),
}
