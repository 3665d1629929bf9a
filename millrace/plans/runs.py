"""Queries on what lasts from run to run: files, an index, an export, a crawl, streams."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import api
from millrace.config import Answers, Index, described, download_instructions, missing_parts
from millrace.functions import urls
from millrace.operators import export, frontier, html_sections, images, saved
from millrace.plans import answers, web
from millrace.plans import text as texts
from millrace.plans.fixtures import STRIP, table
from millrace.providers import ContextCaptioner, HashingEmbedder, embed, first_available
from millrace.sources import files, state
from millrace.sources.work import drop_path, fresh_path, written
from millrace.streaming import answers as streamed
from millrace.streaming import pages as arriving

MODELS = api.Models(HashingEmbedder(answers.DIMENSION))
RANGE_ROWS = 100  # so that the small tables have many ranges, too
MOST_BYTES = 2500
SITE = "https://site.example"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _number(c: str = "page_id") -> Column:
    return F.col(c).cast("string")


def _below(path: str = "path") -> Column:
    """A file's name with its folder's."""
    return F.regexp_extract(path, "[^/]*/[^/]*$", 0)


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of pages of which every second one is fetched twice."""
    pages = _pages(spark, sf_dir)
    once = pages.select("url", F.timestamp_seconds(F.col("page_id")).alias("fetched_at"), F.col("html").alias("markdown"))
    again = pages.where("page_id % 2 = 0").select("url", F.timestamp_seconds(F.col("page_id") + 1_000_000).alias("fetched_at"), F.col("url").alias("markdown"))
    return saved.saved(once.unionByName(again)).select("path", "url", F.md5("markdown").alias("markdown_md5"), "replaced")


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as files of several formats in several folders, found by three scans: of all formats, of HTML alone, of small files."""
    kind = F.element_at(F.array(*map(F.lit, (".html", ".HTM", ".md", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = _pages(spark, sf_dir).select(F.concat(F.lit("d"), (F.col("page_id") % 3).cast("string"), F.lit("/"), _number(), F.lower(kind)).alias("path"), F.col("html").alias("markdown"))
    folder = fresh_path(spark, "files")
    saved.write_files(rows, folder).write.format("noop").mode("overwrite").save()
    scans = {"all": files.scan(spark, folder), "html": files.scan(spark, folder, files.HTML), "small": files.scan(spark, folder, max_bytes=MOST_BYTES)}
    found = [s.select(F.lit(name).alias("scan"), _below().alias("path"), "ext", "size", F.md5("content").alias("content_md5")) for name, s in scans.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as files in an index that was brought up to date: in between files were added, changed and moved."""
    where, pages = fresh_path(spark, "index"), _pages(spark, sf_dir)
    name = F.concat(_number(), F.lit(".html"))
    put = lambda rows: saved.write_files(rows, f"{where}/files").write.format("noop").mode("overwrite").save()
    put(pages.where("page_id % 3 <> 1").select(F.concat(F.when(F.col("page_id") % 5 == 0, "before/").otherwise("kept/"), name).alias("path"), F.col("html").alias("markdown")))
    api.index_folder(spark, f"{where}/files", f"{where}/index", MODELS)
    drop_path(spark, f"{where}/files/before")
    changed = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("<title>"), F.lit("<title>New "))).otherwise(F.col("html"))
    put(pages.where("page_id % 2 = 0 or page_id % 3 = 1 or page_id % 5 = 0").select(F.concat(F.when(F.col("page_id") % 5 == 0, "after/").otherwise("kept/"), name).alias("path"), changed.alias("markdown")))
    manifest, _ = api.index_folder(spark, f"{where}/files", f"{where}/index", MODELS)
    vectors = api.vectors_of(spark, f"{where}/index").select(_below("source_file").alias("path"), "title", "heading", "num_links", "content_length", F.md5("chunk_content").alias("preview_md5"))
    return manifest.select(_below().alias("path"), "size", "chunks_count", "images_count", "file_name").join(vectors, "path", "left")


def export_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in order of their ids, written in many ranges and read again with the manifest."""
    path = fresh_path(spark, "export")
    export.write(table(spark, sf_dir, "embeddings").select(F.md5(_number("vec_id")).alias("chunk_id"), "embedding"), path, "synthetic", "2024-01-01T00:00:00", per_range=RANGE_ROWS)
    vectors, about = export.load(spark, path)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5)
    return vectors.select("vec_id", "chunk_id", total.alias("total"), *[F.lit(about[c]).cast(t).alias(c) for c, t in (("total_vectors", "bigint"), ("vector_dimension", "bigint"), ("embedding_model", "string"), ("completion_timestamp", "string"))])


def found_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three folders hold an index, and what each of these lacks before it can be asked."""
    where, vectors = fresh_path(spark, "indexes"), table(spark, sf_dir, "embeddings")
    for part in ("whole/vectors", "whole/manifest", "half/vectors", "other/manifest"):
        written(vectors, f"{where}/{part}")
    found = state.find_indexes(spark, where)
    return spark.createDataFrame([(p.rpartition("/")[2], ",".join(missing_parts(set(state.children(spark, p)))), spark.read.parquet(f"{p}/vectors").count()) for p in found], "name string, missing string, n_vectors long")


def crawled_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site with a page for every document, each of which links to two others: stopped after three waves, taken up, and failures tried again."""
    at = lambda n: F.concat(F.lit("/"), (F.col("doc_id") * 2 + n).cast("string"))
    links = F.array(at(1), at(2), F.lit("#top"), F.lit("https://elsewhere.example/"), F.lit("/0"))
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit(SITE + "/"), _number("doc_id")).alias("url"), links.alias("links"))
    start = spark.createDataFrame([(f"{SITE}/0",)], "url string")
    kept: list[str] = []

    def save(df: DataFrame, wave: int) -> DataFrame:
        kept.append(fresh_path(spark, "frontier"))
        out = written(df, kept[-1])
        for path in kept[:-2]:
            drop_path(spark, path)
        del kept[:-2]
        return out

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # about what the first run leaves
        half = frontier.crawl(start, pages, F.col("links"), SITE, web.NOW, save, max_waves=3)
    done = frontier.crawl(start, pages, F.col("links"), SITE, web.NOW, save, max_retries=1, known=half)
    return done.select("url", "status", "retry_count", "error_message")


def _stream(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a stream of files."""
    path = fresh_path(rows.sparkSession, label)
    written(rows, path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def _worked_off(stream: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream when all that is there has been worked off."""
    spark = stream.sparkSession
    out = fresh_path(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, "offsets")).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetched, one a minute; those with a query failed."""
    return _pages(spark, sf_dir).select("url", F.timestamp_seconds(F.col("page_id") * 60).alias("completed_at"), F.when(F.contains("url", F.lit("?")), "timeout").alias("error"))


def stream_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _worked_off(arriving.per_host(_stream(_fetched(spark, sf_dir), "fetched")), "complete")
    return counts.select(F.unix_timestamp("window.start").alias("began"), F.unix_timestamp("window.end").alias("ended"), "host", "n", "failed")


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that come three times within half an hour, each of which is reported once."""
    rows = _fetched(spark, sf_dir).select("url", F.explode(F.transform(F.array(*map(F.lit, (0, 10, 30))), lambda m: F.timestamp_seconds(F.unix_timestamp("completed_at") + m * 60))).alias("discovered_at"))
    return _worked_off(arriving.first_seen(_stream(rows, "seen"), late="1 hour"), "append").groupBy("url").agg(F.count("*").alias("n"))


def stream_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known URLs after all pages have come by: those of the pages themselves, and what they link to."""
    pages, known = _pages(spark, sf_dir), fresh_path(spark, "known")
    written(pages.select("url"), known)
    stream = _stream(pages.select("url", html_sections.links_of("html").alias("links")), "linked")
    arriving.discover_stream(stream, F.col("links"), urls.origin(F.col("url")), known, fresh_path(spark, "offsets"), availableNow=True).awaitTermination()
    return spark.read.schema("url string").parquet(known)


def _questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return answers.questions(table(spark, sf_dir, "benchmark")), written(answers.corpus(table(spark, sf_dir, "documents")), fresh_path(spark, "corpus"))


def _first_question(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    asked, vectors = _questions(spark, sf_dir)
    return asked.orderBy("query_id").first()["question"], vectors


def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to the benchmark's items as they arrive."""
    asked, vectors = _questions(spark, sf_dir)
    out = fresh_path(spark, "answers")
    streamed.answer_stream(_stream(asked, "questions"), vectors, out, fresh_path(spark, "offsets"), MODELS, Answers(initial_k=20, final_k=5), availableNow=True).awaitTermination()
    return spark.read.parquet(out).select("query_id", "answer", "response")


def asked_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response to the benchmark's first item."""
    question, vectors = _first_question(spark, sf_dir)
    return spark.createDataFrame([(question, api.ask_rag_question(spark, vectors, question, 5, models=MODELS))], "question string, response string")


def growing_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat about the benchmark's first item: the number of messages and the last one after each step."""
    question, vectors = _first_question(spark, sf_dir)
    before = [{"role": "user", "content": "hello", "metadata": None}]
    said = streamed.chat(spark, vectors, question, before, 5, models=MODELS)
    rows = [(n, len(m), m[-1]["role"], m[-1]["content"], (m[-1]["metadata"] or {}).get("title", "")) for n, m in enumerate(said, 1)]
    return spark.createDataFrame(rows, "step long, messages int, role string, content string, title string")


def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of an export of all vectors, by way of its JSON."""
    about = export.summary(table(spark, sf_dir, "embeddings"), "synthetic").first()
    config = Index("me/vectors", about["total_vectors"], about["vector_dimension"], about["embedding_model"], files={"embeddings": "vectors"}, completion_timestamp="2024-01-01")
    again = Index.from_json(config.to_json())
    rows = [tuple(line.split(": ", 1)) for line in described(again).split("\n")]
    return spark.createDataFrame([*rows, ("repo_url", download_instructions(again)["repo_url"])], "name string, value string")


def fallback_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded by the second of two embedders, as the first doesn't load."""

    def absent() -> HashingEmbedder:
        raise ImportError("no such model")

    v = embed(first_available(absent, MODELS.embedder.__class__), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", v.alias("v"))
    return rows.select("doc_id", F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("used"), F.array_max("v").cast("bigint").alias("most"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("n_tokens"))


def captioned_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image references by source and language of a document, of which those with a file are captioned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("img/"), _number("doc_id"), F.lit(".png")).alias("src"), "lang", "source")
    shown = lambda c, n: F.when(F.col("doc_id") % n == 0, "").otherwise(F.coalesce(c, F.lit("")))
    refs = docs.select(F.concat(F.lit("docs/"), _number("doc_id"), F.lit(".md")).alias("source_file"), "src", shown("lang", 2).alias("alt"), shown("source", 3).alias("title"))
    told = images.described(images.resolve(refs, docs.where("doc_id % 7 <> 0").select(F.concat(F.lit("docs/"), "src").alias("path"))), ContextCaptioner())
    return told.select("source_file", "local_path", "description")


def pdf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of page texts as rows of an index, with the file as title and a page as heading."""
    return files.pdf_rows(texts.document_chunks(spark, sf_dir)).select("chunk_id", "title", "heading", "chunk_index", "total_chunks")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_S = STRIP.format
_RAW = "replace(html, '<title>', CASE WHEN page_id % 2 = 0 THEN '<title>New ' ELSE '<title>' END)"
_ANSWERED = answers.QUERIES["answers"][1]
_FIRST = f"""f AS (SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 1), r AS ({_ANSWERED}), t AS (SELECT answer, substr(response, length(answer) + length({answers._HEAD}) + 1) AS sources, response, text FROM r JOIN f ON query_id = item_id)"""
_FILE = "concat('d', page_id % 3, '/', page_id, CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.htm' WHEN 2 THEN '.md' ELSE '.txt' END)"
_NONE = images.NO_CONTEXT

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "saved_pages": (
        saved_pages,
        f"""WITH u AS (SELECT {web._TO_PATH} AS path, url, page_id AS fetched, html AS markdown FROM pages UNION ALL SELECT {web._TO_PATH}, url, page_id + 1000000, url FROM pages WHERE page_id % 2 = 0)
        SELECT path, url, md5(markdown) AS markdown_md5, n - 1 AS replaced FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY fetched DESC, url DESC, markdown DESC) AS i FROM u) WHERE i = 1""",
    ),
    "file_scan": (
        file_scan,
        f"""WITH p AS (SELECT {_FILE} AS path, CAST(strlen(html) AS BIGINT) AS size, md5(html) AS content_md5 FROM pages), e AS (SELECT path, regexp_extract(path, '\\.[a-z]+$') AS ext, size, content_md5 FROM p)
        SELECT s AS scan, e.* FROM e, (VALUES ('all'), ('html'), ('small')) AS k(s) WHERE ext <> '.txt' AND (s <> 'html' OR ext <> '.md') AND (s <> 'small' OR size <= {MOST_BYTES})""",
    ),
    "indexed_files": (
        indexed_files,
        f"""WITH v AS (SELECT page_id, url, {_RAW} AS html FROM pages), {web._ARTICLES.replace("FROM pages", "FROM v")},
        c AS (SELECT *, concat(head, chr(10), chr(10), {_S(web._TEXT_OF('below'))}) AS content FROM a), k AS (SELECT * FROM c WHERE length({_S('content')}) >= 50)
        SELECT concat(CASE WHEN page_id % 5 = 0 THEN 'after/' ELSE 'kept/' END, page_id, '.html') AS path, CAST(strlen(v.html) AS BIGINT) AS size, CAST(CASE WHEN content IS NULL THEN 0 ELSE 1 END AS BIGINT) AS chunks_count, CAST(0 AS BIGINT) AS images_count,
               concat(page_id, '.html') AS file_name, substr(title, 1, 200) AS title, substr(head, 1, 200) AS heading, CAST(CASE WHEN content IS NOT NULL THEN 0 END AS INTEGER) AS num_links, CAST(length(content) AS INTEGER) AS content_length,
               md5(CASE WHEN length(content) > 500 THEN concat(substr(content, 1, 500), '...') ELSE content END) AS preview_md5 FROM v LEFT JOIN k USING (page_id)""",
    ),
    "export_read_back": (
        export_read_back,
        """SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS vec_id, md5(CAST(vec_id AS VARCHAR)) AS chunk_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total,
        count(*) OVER () AS total_vectors, CAST(max(len(embedding)) OVER () AS BIGINT) AS vector_dimension, 'synthetic' AS embedding_model, '2024-01-01T00:00:00' AS completion_timestamp FROM embeddings""",
    ),
    "found_indexes": (found_indexes, "SELECT name, missing, (SELECT count(*) FROM embeddings) AS n_vectors FROM (VALUES ('half', 'manifest'), ('whole', '')) AS v(name, missing)"),
    "crawled_snapshot": (
        crawled_snapshot,
        f"""WITH RECURSIVE r(id) AS (SELECT CAST(0 AS BIGINT) UNION SELECT unnest([doc_id * 2 + 1, doc_id * 2 + 2]) FROM r JOIN documents ON doc_id = id), d AS (SELECT DISTINCT doc_id FROM documents)
        SELECT concat('{SITE}/', id) AS url, CASE WHEN doc_id IS NULL THEN 'error' ELSE 'completed' END AS status, CAST(CASE WHEN doc_id IS NULL THEN 2 ELSE 0 END AS INTEGER) AS retry_count,
               CASE WHEN doc_id IS NULL THEN 'not in the snapshot' END AS error_message FROM r LEFT JOIN d ON doc_id = id""",
    ),
    "stream_hosts": (
        stream_hosts,
        "SELECT CAST(page_id // 10 * 600 AS BIGINT) AS began, CAST(page_id // 10 * 600 + 600 AS BIGINT) AS ended, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n, count(*) FILTER (contains(url, '?')) AS failed FROM pages GROUP BY ALL",
    ),
    "stream_first_seen": (stream_first_seen, "SELECT DISTINCT url, CAST(1 AS BIGINT) AS n FROM pages"),
    "stream_discovered": (stream_discovered, f"WITH {web._FOUND} SELECT url FROM pages UNION ALL SELECT found FROM f WHERE found NOT IN (SELECT url FROM pages)"),
    "streamed_answers": (streamed_answers, _ANSWERED),
    "asked_question": (asked_question, f"WITH {_FIRST} SELECT text AS question, response FROM t"),
    "growing_answer": (
        growing_answer,
        f"""WITH {_FIRST}, w AS (SELECT string_split(answer, ' ') AS w, sources FROM t), s AS (SELECT CAST(unnest(range(1, len(w) + 1)) AS BIGINT) AS step, w, sources FROM w)
        SELECT step, CAST(3 AS INTEGER) AS messages, 'assistant' AS role, array_to_string(w[1:step], ' ') AS content, '' AS title FROM s UNION ALL SELECT len(w) + 1, 4, 'assistant', sources, 'sources' FROM w""",
    ),
    "run_config": (
        run_config,
        """WITH c AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings) SELECT 'Repository' AS name, 'me/vectors' AS value UNION ALL SELECT 'Vectors', format('{:,}', n) FROM c UNION ALL SELECT 'Dimension', CAST(d AS VARCHAR) FROM c
        UNION ALL SELECT * FROM (VALUES ('Model', 'synthetic'), ('File', 'vectors'), ('Completed', '2024-01-01'), ('repo_url', 'https://huggingface.co/datasets/me/vectors'))""",
    ),
    "fallback_embedding": (
        fallback_embedding,
        f"""WITH b AS ({answers._BUCKETS.format('doc_id', 'documents')}), g AS (SELECT id, count(*) AS used, CAST(max(c) AS BIGINT) AS most, CAST(sum(c) AS BIGINT) AS n_tokens FROM b GROUP BY id)
        SELECT doc_id, coalesce(used, 0) AS used, coalesce(most, 0) AS most, coalesce(n_tokens, 0) AS n_tokens FROM documents LEFT JOIN g ON doc_id = id""",
    ),
    "captioned_images": (
        captioned_images,
        f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE coalesce(lang, '') END AS alt, CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(source, '') END AS title FROM documents)
        SELECT concat('docs/', doc_id, '.md') AS source_file, CASE WHEN doc_id % 7 <> 0 THEN concat('docs/img/', doc_id, '.png') END AS local_path, CASE WHEN doc_id % 7 = 0 THEN concat('Image non trouvée: ', doc_id, '.png')
               ELSE concat(CASE WHEN alt = '' AND title = '' THEN {_sql(_NONE)} ELSE concat('Texte alternatif: ', alt, ', Titre: ', title) END, ' (', doc_id, '.png)') END AS description FROM d""",
    ),
    "pdf_chunks": (
        pdf_chunks,
        "SELECT chunk_id, regexp_extract(source_file, '[^/]*$') AS title, 'Page 1' AS heading, chunk_index, total_chunks FROM (" + texts.QUERIES["document_chunks"][1] + ")",
    ),
}
