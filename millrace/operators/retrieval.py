"""Two-stage retrieval: candidates by vector, a second score, and the texts made of the hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import or_default
from millrace.functions.vectors import clamp01, distance_from_score
from millrace.operators.search import RANK_DECIMALS, nearest
from millrace.providers import NEUTRAL, Reranker

# What stands in for missing fields, and the texts of prompts and answers.
NO_CONTENT, NO_SOURCE, NO_TITLE = "Contenu non disponible", "Inconnu", "Sans titre"
SYSTEM_PROMPT = """Tu es un assistant expert qui répond aux questions en te basant uniquement sur les documents fournis dans le contexte.

Instructions importantes:
- Réponds en français de manière claire et précise
- Base-toi uniquement sur les informations du contexte fourni
- Si l'information n'est pas dans le contexte, dis-le clairement
- Utilise un ton professionnel adapté au domaine
- Structure ta réponse avec des paragraphes clairs"""
STREAM_PROMPT = ("Contexte:\n", "\n\nQuestion: ", "")
BATCH_PROMPT = ("Contexte documentaire:\n", "\n\nQuestion: ", "\n\nRéponds à cette question en te basant sur le contexte fourni.")
SOURCES_HEAD = ("\n\n📚 **Documents sources utilisés (", "):**\n")
METHODS = ("avec reranking", "par embedding seulement")
NOTHING_FOUND = "❌ Aucun document pertinent trouvé dans la base de données pour répondre à cette question."
INSTRUCTION = (
    "Évaluez la pertinence de ce document technique par rapport à la requête en considérant : terminologie technique, "
    "spécifications, normes, procédures de mise en œuvre."
)

INITIAL_K, FINAL_K = 20, 3


def clamp_k(k: object) -> int:
    """The number of documents of an answer: 1 to 10."""
    return max(1, min(10, int(k)))


def candidate_count(k: int, initial_k: int = INITIAL_K) -> int:
    return max(initial_k, 3 * k)


def candidates(queries: DataFrame, vectors: DataFrame, k: int = FINAL_K, initial_k: int = INITIAL_K) -> DataFrame:
    """First stage: (query_id, chunk row, embedding_score, embedding_distance, initial_rank).

    ``queries`` has query_id and embedding; ``vectors`` has vec_id, embedding and the
    metadata of its chunk, with defaults for what is missing.  Hits come with
    their rows by one join on the ids that were found.
    """
    hits = nearest(queries, vectors, candidate_count(k, initial_k)).select(
        "query_id", F.col("id").alias("vec_id"), F.col("score").alias("embedding_score"), distance_from_score(F.col("score")).alias("embedding_distance"), F.col("rank").alias("initial_rank")
    )
    have = vectors.columns
    field = lambda c, default: (or_default(F.col(c), default) if c in have else F.lit(default)).alias(c)
    meta = vectors.select(
        "vec_id", field("chunk_content", NO_CONTENT), field("source_file", NO_SOURCE), field("title", NO_TITLE), (F.coalesce("heading", F.lit("")) if "heading" in have else F.lit("")).alias("heading")
    )
    return hits.join(meta, "vec_id").select("query_id", "vec_id", F.col("chunk_content").alias("content"), F.col("source_file").alias("source"), "title", "heading", "embedding_score", "embedding_distance", "initial_rank")


def rerank(hits: DataFrame, questions: DataFrame, reranker: Reranker | None, k: int = FINAL_K, available: bool = True) -> DataFrame:
    """Second stage: rerank_score, final_rank, reranked; the best ``k`` of each query.

    Without a reranker the first score and rank stand.  One that isn't available
    says 0.5 of each pair.  Ties keep the first rank.
    """
    if reranker is None:
        scored = hits.withColumns({"rerank_score": F.col("embedding_score"), "reranked": F.lit(False)})
        return scored.withColumn("final_rank", F.col("initial_rank")).where(F.col("final_rank") <= k)
    if available:
        asked = questions.select("query_id", F.col("question").alias("__question"))
        both = hits.join(asked, "query_id")
        score = F.coalesce(clamp01(reranker.column(F.col("__question"), F.col("content"))), F.lit(NEUTRAL))
        scored = both.withColumn("rerank_score", score).drop("__question")
    else:
        scored = hits.withColumn("rerank_score", F.lit(NEUTRAL))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", RANK_DECIMALS)), "initial_rank")
    return scored.withColumn("reranked", F.lit(True)).withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


def _in_order(hits: DataFrame, lines: dict[str, tuple[Column, str]]) -> DataFrame:
    """(query_id, and for each name the lines in final order with their joiner between), of at most ``k`` rows for each query."""
    row = F.struct(F.col("final_rank").alias("r"), *[line.alias(n) for n, (line, _) in lines.items()])
    got = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    joined = [F.array_join(F.col("__rows")[n], joiner).alias(n) for n, (_, joiner) in lines.items()]
    return got.select("query_id", *joined)


def _context_line() -> Column:
    return F.concat(F.lit("[Document "), F.col("final_rank").cast("string"), F.lit("] "), F.col("title"), F.lit(" - "), F.col("heading"), F.lit("\n"), F.col("content"))


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context): the hits in final order, numbered."""
    return _in_order(hits, {"context": (_context_line(), "\n\n")})


def assembled(hits: DataFrame) -> DataFrame:
    """(query_id, context, sources, first): all that is made of the hits, in one pass over them; first is the best hit's content."""
    best = F.when(F.col("final_rank") == 1, F.col("content"))
    return _in_order(hits, {"context": (_context_line(), "\n\n"), "sources": (_source_line(False), "\n"), "first": (best, "")})


def prompt(question: Column, context_: Column, streaming: bool = False) -> Column:
    a, b, c = STREAM_PROMPT if streaming else BATCH_PROMPT
    return F.concat(F.lit(a), context_, F.lit(b), question, F.lit(c))


def _number(x: Column) -> Column:
    return F.format_string("%.3f", F.round(x, 3))


def _source_line(streaming: bool) -> Column:
    both = F.concat(F.lit("Embedding: "), _number(F.col("embedding_score")), F.lit(" | **Reranking: "), _number(F.col("rerank_score")), F.lit("**"))
    scores = F.when(F.col("reranked"), both).otherwise(F.concat(F.lit("Score: "), _number(F.col("embedding_score"))))
    n = F.col("final_rank").cast("string")
    head = F.concat(F.lit("• **["), n, F.lit("]** "), F.col("title"))
    if streaming:
        return F.concat(head, F.lit(" ("), F.col("source"), F.lit(")\n  └ "), scores)
    moved = F.when(F.col("reranked") & (F.col("initial_rank") != F.col("final_rank")), F.concat(F.lit(" (#"), F.col("initial_rank").cast("string"), F.lit("→#"), n, F.lit(")"))).otherwise("")
    return F.concat(head, moved, F.lit("\n  └ "), scores, F.lit("\n  └ Source: "), F.col("source"))


def source_lines(hits: DataFrame, streaming: bool = False) -> DataFrame:
    """(query_id, sources): a block of lines for each hit, with its scores and, if it moved, its ranks."""
    return _in_order(hits, {"sources": (_source_line(streaming), "\n")})


def source_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, sources, stream_sources): both forms of :func:`source_lines`, in one pass over the hits."""
    return _in_order(hits, {"sources": (_source_line(False), "\n"), "stream_sources": (_source_line(True), "\n")})


def answer_text(answer: Column, sources: Column, reranked: bool) -> Column:
    head, tail = SOURCES_HEAD
    return F.concat(answer, F.lit(head + METHODS[0 if reranked else 1] + tail), F.lit("\n"), sources)
