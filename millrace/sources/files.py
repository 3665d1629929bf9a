"""Files below a folder: scanning, telling formats apart, and reading each into chunks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import errors
from millrace.functions.text import stem, suffix
from millrace.operators import chunking, html_sections, images, markdown
from millrace.operators.pages import whole_text
from millrace.providers import Captioner
from millrace.schemas import CHUNK, ERROR, FILE_SCAN
from millrace.sources.pdf import page_texts as read_pdf

HTML, MARKDOWN, PDF = (".html", ".htm"), (".md", ".markdown"), (".pdf",)
IMAGES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".svg")


#: What opening a file counts for, in bytes, when files are dealt to tasks: a task gets up to 512 small ones.
OPEN_BYTES = 1 << 18
_OPEN_COST = "spark.sql.files.openCostInBytes"


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = HTML + MARKDOWN + PDF, max_bytes: int | None = None) -> DataFrame:
    """Files with one of ``suffixes`` anywhere below ``folder`` (path, mtime, size, ext, content).

    The size limit is pushed into the listing; content is only read where it is
    selected.  Spark's own reckoning would make a task of every 32 files; a
    session that reckons with less than :data:`OPEN_BYTES` keeps its own.
    """
    if spark._jsparkSession.sessionState().conf().filesOpenCostInBytes() > OPEN_BYTES:
        spark.conf.set(_OPEN_COST, str(OPEN_BYTES))
    glob = "*.{" + ",".join(s[1:] for s in suffixes) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), suffix(F.col("path")).alias("ext"), "content").to(FILE_SCAN)


def file_format(ext: Column) -> Column:
    return F.when(ext.isin(*HTML), "html").when(ext.isin(*MARKDOWN), "markdown").when(ext.isin(*PDF), "pdf").otherwise("unsupported")


def format_counts(files: DataFrame) -> DataFrame:
    """One row: files of each format, and of all."""
    kind = file_format(F.col("ext"))
    return files.agg(*[F.count_if(kind == k).alias(k) for k in ("html", "markdown", "pdf", "unsupported")], F.count("*").alias("total"))


def pdf_rows(chunks: DataFrame) -> DataFrame:
    """Chunks of page texts as chunk rows: title is the section's or the file's name, heading the sub-section's, the section's or the page."""
    have = chunks.columns
    col = lambda c: F.nullif(c, F.lit("")) if c in have else F.lit(None).cast("string")
    section, sub = col("section_title"), col("subsection_title")
    first = F.coalesce(F.get("page_numbers", 0), F.lit(0)) + 1 if "page_numbers" in have else F.lit(1)
    return chunks.withColumns({
        "title": F.coalesce(section, stem(F.col("source_file"))), "heading": F.coalesce(sub, section, F.concat(F.lit("Page "), first.cast("string"))),
    })


def _as_chunks(df: DataFrame) -> DataFrame:
    """Chunk rows; images and links that are missing are empty lists."""
    have = df.columns
    rows = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNK])
    return rows.withColumns({c: F.coalesce(c, F.array().cast(CHUNK[c].dataType)) for c in ("images", "links")})


def _with_images(chunks: DataFrame, files: DataFrame | None, captioner: Captioner | None, html: bool) -> DataFrame:
    """``chunks`` with their image references looked up and described, in order."""
    if files is None:
        return chunks.withColumn("images", F.transform("images", lambda i: F.struct(i["src"].alias("src"), F.lit(None).cast("string").alias("local_path"), i["alt"].alias("alt"), i["title"].alias("title"), F.lit(None).cast("string").alias("description"), F.lit(False).alias("found"), F.lit(None).cast("string").alias("error"))))
    refs = chunks.select("chunk_id", "source_file", F.posexplode("images").alias("at", "i")).select("chunk_id", "source_file", "at", "i.*")
    told = images.described(images.resolve(refs, files, "^http" if html else "^https?://", blank_file_alt=html), captioner)
    one = F.struct("at", "src", "local_path", "alt", "title", "description", "found", "error")
    lists = told.groupBy("chunk_id", "source_file").agg(F.array_sort(F.collect_list(one)).alias("__i"))
    shape = lambda i: F.struct(*[i[n].alias(n) for n in ("src", "local_path", "alt", "title", "description", "found", "error")])
    both = chunks.drop("images").join(lists, ["chunk_id", "source_file"], "left")
    return both.withColumn("images", F.transform(F.coalesce("__i", F.array().cast(lists.schema["__i"].dataType)), shape)).drop("__i")


def read_chunks(
    files: DataFrame,
    embed: Callable[[list[str]], np.ndarray] | None = None,
    sizes: chunking.ChunkSizes | None = None,
    image_files: DataFrame | None = None,
    captioner: Captioner | None = None,
    page_texts: DataFrame | None = None,
    save: Callable[[DataFrame, str], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of a scan.

    The text of a PDF file comes from ``page_texts`` (path, page, text) or, where
    that has none, from the file itself; files that :mod:`millrace.sources.pdf`
    can't read, and unknown formats, are errors.  ``save`` writes what Python made
    of HTML and PDF files and reads it back, as it is used several times.
    """
    save = save or (lambda df, name: df)
    sizes = sizes or chunking.ChunkSizes(semantic=embed is not None)
    kinds = files.withColumn("__kind", file_format(F.col("ext")))
    text = F.col("content").cast("string")
    pages = save(html_sections.sections(kinds.where("__kind = 'html'").select("path", text.alias("html")), "path"), "html")
    html = _with_images(pages.where("error is null"), image_files, captioner, True)
    said = html_sections.media_content(F.col("content"), F.transform("images", lambda i: i["description"]))
    html = html.withColumn("content", F.when(html_sections.is_media(F.col("heading"), F.col("content")), said).otherwise(F.col("content")))
    bad = errors.rows(pages.where("error is not null"), "parsing_error", "source_file", "HTML", F.col("error"))
    notes = _with_images(markdown.chunks(kinds.where("__kind = 'markdown'").select("path", text.alias("text"))), image_files, captioner, False)
    out = _as_chunks(html).unionByName(_as_chunks(notes))
    pdf = kinds.where("__kind = 'pdf'").select("path", "content")
    given = pdf if page_texts is None else pdf.join(page_texts.select("path").distinct(), "path", "left_anti")
    found = save(read_pdf(given), "pdf")
    texts = found.where("error is null").select("path", "page", "text")
    if page_texts is not None:
        texts = texts.unionByName(page_texts.join(pdf.select("path"), "path", "left_semi").select("path", F.col("page").cast("int").alias("page"), "text"))
    out = out.unionByName(_as_chunks(pdf_rows(chunking.document_chunks(whole_text(texts, "path"), embed, sizes))))
    lost = errors.rows(found.where("error is not null"), "parsing_error", "path", "no page texts for this PDF", F.col("error")).unionByName(errors.rows(kinds.where("__kind = 'unsupported'"), "parsing_error", "path", F.concat(F.lit("unsupported format: "), F.col("ext"))))
    return out, bad.unionByName(lost).to(ERROR)
