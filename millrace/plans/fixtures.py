"""Inputs that the tables lack, made from whole tables by rules that both engines can follow.

Each function has its SQL beside it, as the body of a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.work import small_batches

PAGE_CHARS = 1500
WINDOW_CHARS = 1000


#: Set to true (as bench.py does) where tables are single row groups, which one task would read alone.
SPREAD = "spark.millrace.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as its files are; with :data:`SPREAD`, texts are dealt out to all cores first.  Python gets texts in small batches."""
    if name in ("documents", "pages"):
        small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in ("documents", "pages") and spark.conf.get(SPREAD, "false") == "true":
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def markdown_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): lines as headings, words as links and images."""

    def word(w, j):
        return (
            F.when(j % 34 == 33, F.concat(F.lit("!["), w, F.lit("]("), w, F.lit('.png "'), w, F.lit('")')))
            .when(j % 17 == 16, F.concat(F.lit("!["), w, F.lit("]("), w, F.lit(".png)")))
            .when(j % 22 == 21, F.concat(F.lit("["), w, F.lit("](#"), w, F.lit(")")))
            .when(j % 11 == 10, F.concat(F.lit("["), w, F.lit("](/"), w, F.lit(")")))
            .otherwise(w)
        )

    def line(x, i):
        mark = F.when(i == 0, "# ").when(i % 15 == 10, "### ").when(i % 5 == 0, "## ").otherwise("")
        return F.concat(mark, F.array_join(F.transform(F.split(x, " "), word), " "))

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    return docs.select("doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


MARKDOWN_DOCS = """
    SELECT doc_id, concat('docs/', doc_id, '.md') AS path,
           array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: concat(
               CASE WHEN i = 1 THEN '# ' WHEN (i - 1) % 15 = 10 THEN '### ' WHEN (i - 1) % 5 = 0 THEN '## ' ELSE '' END,
               array_to_string(list_transform(string_split(x, ' '), lambda w, j:
                   CASE WHEN (j - 1) % 34 = 33 THEN concat('![', w, '](', w, '.png "', w, '")')
                        WHEN (j - 1) % 17 = 16 THEN concat('![', w, '](', w, '.png)')
                        WHEN (j - 1) % 22 = 21 THEN concat('[', w, '](#', w, ')')
                        WHEN (j - 1) % 11 = 10 THEN concat('[', w, '](/', w, ')') ELSE w END), ' '))), chr(10)) AS text
    FROM documents
"""


def spaced_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): blank lines before every third and every seventh line."""
    line = lambda x, i: F.concat(F.when(i % 7 == 6, "\n\n").when(i % 3 == 2, "\n").otherwise(""), x)
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


SPACED_DOCS = """
    SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
        concat(CASE WHEN (i - 1) % 7 = 6 THEN chr(10) || chr(10) WHEN (i - 1) % 3 = 2 THEN chr(10) ELSE '' END, x)), chr(10)) AS text
    FROM documents
"""


def loose_pages(docs: DataFrame) -> DataFrame:
    """(url, html): pages without headings, with a table of links, a table of content that is empty in some, a text and a few words beside it."""
    plain = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    number, source = F.col("doc_id").cast("string"), F.coalesce("source", F.lit("x"))
    cell = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, plain("lang")).otherwise(plain("text"))
    html = F.concat(
        F.lit("<html><head><title>Page "), number, F.lit('</title></head><body><div class="page content"><table><tr><td><a href="/'), source, F.lit('">'), source, F.lit('</a><a href="/empty"> </a></td></tr></table><table><tr><td>'),
        cell, F.lit("</td></tr></table><p>"), plain("text"), F.lit("</p><span>few words</span></div></body></html>"),
    )
    return docs.select(F.concat(F.lit("loose/"), number).alias("url"), html.alias("html"))


def page_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, page, text): documents cut into pages."""
    last = F.greatest(F.ceil(F.length("text") / PAGE_CHARS), F.lit(1)) - 1
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("page"))
    return rows.select("doc_id", "page", F.substring("text", F.col("page") * PAGE_CHARS + 1, F.lit(PAGE_CHARS)).alias("text"))


PAGE_TEXTS = f"""
    SELECT doc_id, CAST(page AS INTEGER) AS page, substr(text, page * {PAGE_CHARS} + 1, {PAGE_CHARS}) AS text
    FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / {PAGE_CHARS}.0) AS BIGINT), 1))) AS page FROM documents)
"""


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, start_at, end_at): stretches of each document's page texts put together."""
    pages = F.greatest(F.ceil(F.length("text") / PAGE_CHARS), F.lit(1))
    rows = docs.select("doc_id", (F.length("text") + pages - 1).alias("n"))
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / WINDOW_CHARS), F.lit(1)).cast("int") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * WINDOW_CHARS
    return rows.select("doc_id", "chunk_index", start.cast("bigint").alias("start_at"), F.least(start + WINDOW_CHARS, F.col("n")).cast("bigint").alias("end_at"))


WINDOWS = f"""
    SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, k * {WINDOW_CHARS} AS start_at, least(k * {WINDOW_CHARS} + {WINDOW_CHARS}, n) AS end_at
    FROM (SELECT doc_id, n, unnest(range(0, greatest(CAST(ceil(n / {WINDOW_CHARS}.0) AS BIGINT), 1))) AS k
          FROM (SELECT doc_id, length(text) + greatest(CAST(ceil(length(text) / {PAGE_CHARS}.0) AS BIGINT), 1) - 1 AS n FROM documents))
"""


def snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two states of one folder: the manifest of an earlier run, and a scan of today, each of all documents.

    Some files have moved to another folder, and some are a minute younger today.
    """
    path = lambda moved, folder: F.concat(F.when(moved, folder).otherwise("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    at = lambda shift: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") + shift)
    old = docs.select(path(F.col("doc_id") % 3 == 0, "drafts/").alias("path"), at(F.lit(0)).alias("mtime"), F.col("n_chars").alias("size"), at(F.lit(3600)).alias("indexed_at"), F.col("doc_id").alias("chunks_count"), (F.col("doc_id") % 4).alias("images_count"))
    new = docs.select(path(F.col("doc_id") % 5 == 1, "moved/").alias("path"), at(F.when(F.col("doc_id") % 7 == 0, 60).otherwise(0)).alias("mtime"), F.col("n_chars").alias("size"))
    return old, new


SNAPSHOTS = """
    old AS (SELECT concat(CASE WHEN doc_id % 3 = 0 THEN 'drafts/' ELSE 'docs/' END, doc_id, '.md') AS path, 1700000000 + doc_id AS mtime, 1700003600 + doc_id AS indexed_at, doc_id AS chunks_count, doc_id % 4 AS images_count FROM documents),
    new AS (SELECT concat(CASE WHEN doc_id % 5 = 1 THEN 'moved/' ELSE 'docs/' END, doc_id, '.md') AS path, 1700000000 + doc_id + CASE WHEN doc_id % 7 = 0 THEN 60 ELSE 0 END AS mtime FROM documents)
"""

#: White space at both ends of a text, in SQL.
STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
