"""Queries on vectors.  Searches ask for every row whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators import export, search
from millrace.plans.fixtures import table

K = 10
CANDIDATES = 30  # max(20, 3 K)


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


def vector_normalize_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(V.norm(V.normalize_stored(F.col("embedding"))).alias("s"), V.norm(V.normalize_query(F.col("embedding"))).alias("q"))
    return rows.agg(F.count("*").alias("n"), *[F.round(f(c), 6).alias(f"{c}_{n}") for c in ("s", "q") for n, f in (("min", F.min), ("max", F.max))])


def _knn(spark: SparkSession, sf_dir: str, k: int, metric: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search.nearest(_asked(vectors), vectors, k, metric)


def knn_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, K, "cosine").select("query_id", "id", F.round("score", 6).alias("score"), F.round(V.distance_from_score(F.col("score")), 6).alias("distance"), "rank")


def knn_l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = -F.col("score") + 0.0
    return _knn(spark, sf_dir, K, "l2").select("query_id", "id", F.round(d, 6).alias("distance"), F.round(V.similarity_from_distance(d), 6).alias("similarity"), "rank")


def knn_candidate_overfetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, CANDIDATES, "cosine").groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("least_score"), F.max("rank").alias("last_rank"))


def knn_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each query's neighbours, itself left out, that have its label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _knn(spark, sf_dir, K, "cosine").where("id <> query_id").select("query_id", "id")
    asked = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    both = hits.join(labels, hits["id"] == labels["vec_id"]).join(asked, "query_id")
    return both.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("own") == F.col("label")).cast("double")), 6).alias("agreement"))


def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def vector_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with one number made NaN or infinite, and mended."""
    bad = F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))).cast("float")
    broken = F.transform("embedding", lambda x, i: F.when(i == F.col("vec_id") % F.size("embedding"), bad).otherwise(x))
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", broken)
    mended = V.sanitize(F.col("embedding"))
    at = (F.col("vec_id") % F.size("embedding")).cast("int")
    return rows.select("vec_id", V.is_finite(F.col("embedding")).alias("was_finite"), V.is_finite(mended).alias("finite"), F.get(mended, at).cast("double").alias("at_fault"), F.round(F.aggregate(mended, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.md5(F.col("vec_id").cast("string")).alias("chunk_id"))
    return export.with_ordinals(rows).select("vec_id", "chunk_id", F.col("ordinal").cast("bigint").alias("ordinal"))


def export_bundle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.summary(table(spark, sf_dir, "embeddings"), "synthetic")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.stats(table(spark, sf_dir, "embeddings"))


def knn_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the search in cells against the exact one, by query."""
    vectors = table(spark, sf_dir, "embeddings")
    centers = search.train_cells(vectors, 16)
    indexed = search.with_cells(vectors, centers)
    found = search.nearest_in_cells(_asked(vectors), indexed, centers, K, search.probes_for(indexed, centers, K))
    return search.recall(search.nearest(_asked(vectors), vectors, K), found)


_NORM = "sqrt(list_sum(list_transform({}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
_V = f"v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, {_NORM.format('embedding')} AS n FROM embeddings)"
_COSINE = f"""{_V},
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, q.label AS own, v.label AS label, list_dot_product(q.e, v.e) / (q.n * (v.n + 1e-8)) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s)"""
_SANITIZED = "list_transform(embedding, lambda x, i: CASE WHEN i - 1 = vec_id % len(embedding) THEN CASE vec_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 ELSE -1.0 END ELSE CAST(x AS DOUBLE) END)"

QUERIES = {
    "vector_norms": (vector_norms, f"WITH {_V} SELECT vec_id, round(n, 6) AS norm FROM v"),
    "vector_normalize_check": (
        vector_normalize_check,
        f"WITH {_V}, m AS (SELECT {_NORM.format('list_transform(e, lambda y: y / (n + 1e-8))')} AS s, {_NORM.format('list_transform(e, lambda y: y / n)')} AS q FROM v) "
        "SELECT count(*) AS n, round(min(s), 6) AS s_min, round(max(s), 6) AS s_max, round(min(q), 6) AS q_min, round(max(q), 6) AS q_max FROM m",
    ),
    "knn_cosine_topk": (knn_cosine_topk, f"WITH {_COSINE} SELECT query_id, id, round(score, 6) AS score, round(1 - score, 6) AS distance, rank FROM r WHERE rank <= {K}"),
    "knn_l2_topk": (
        knn_l2_topk,
        f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, pow(list_distance(q.e, v.e), 2) AS d FROM v AS q, v WHERE q.vec_id % 50 = 0), "
        "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS INTEGER) AS rank FROM s) "
        f"SELECT query_id, id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity, rank FROM r WHERE rank <= {K}",
    ),
    "knn_candidate_overfetch": (knn_candidate_overfetch, f"WITH {_COSINE} SELECT query_id, count(*) AS n, round(min(score), 6) AS least_score, max(rank) AS last_rank FROM r WHERE rank <= {CANDIDATES} GROUP BY query_id"),
    "knn_label_agreement": (
        knn_label_agreement,
        f"WITH {_COSINE} SELECT query_id, count(*) AS n, round(avg(CASE WHEN own = label THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM r WHERE rank <= {K} AND id <> query_id GROUP BY query_id",
    ),
    "centroid_by_label": (
        centroid_by_label,
        "SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos",
    ),
    "vector_sanitize": (
        vector_sanitize,
        f"SELECT vec_id, false AS was_finite, true AS finite, CAST(({_SANITIZED})[vec_id % len(embedding) + 1] AS DOUBLE) AS at_fault, round(list_sum({_SANITIZED}), 5) AS total FROM embeddings",
    ),
    "ordered_ids": (ordered_ids, "SELECT vec_id, md5(CAST(vec_id AS VARCHAR)) AS chunk_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR))) - 1 AS ordinal FROM embeddings"),
    "export_bundle_summary": (
        export_bundle_summary,
        "SELECT '1.0' AS format_version, count(*) AS total_vectors, CAST(max(len(embedding)) AS INTEGER) AS vector_dimension, 'flat' AS index_type, 'synthetic' AS embedding_model FROM embeddings",
    ),
    "index_stats": (index_stats, "SELECT count(*) AS total_vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension, round(sum(len(embedding)) * 4 / 1048576.0, 4) AS size_mb FROM embeddings"),
    "knn_ivf_recall": (knn_ivf_recall, None),
}
