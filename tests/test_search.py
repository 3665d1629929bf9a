import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace import providers
from millrace.functions import vectors as V
from millrace.operators import search as S


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("block", [16 << 20, 1000])
def test_nearest_is_brute_force(spark, metric, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    x = np.random.default_rng(0).integers(-3, 4, (300, 6)).astype(np.float32)  # many ties
    x[5] = 0
    df = frame(spark, x)
    got = S.nearest(df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), df, 7, metric)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    for q in range(0, 300, 10):
        if metric == "cosine":
            s = x.astype(float) @ x[q].astype(float) / ((np.linalg.norm(x, axis=1) + 1e-8) * (np.linalg.norm(x[q]) or 1))
        else:
            s = -((x - x[q]) ** 2).sum(1)
        assert found[q] == sorted(range(300), key=lambda i: (-round(s[i], 9), i))[:7]


def test_odd_vectors_are_nobodys_neighbours(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, []), (5, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = S.nearest(df.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), df, 5)
    assert [r["id"] for r in got.orderBy("rank").collect()] == [1, 5]
    assert S.nearest(df.limit(0).select(F.col("vec_id").alias("query_id"), "embedding"), df, 5).count() == 0
    assert S.nearest(df.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), "embedding"), df.limit(0), 5).count() == 0


def test_every_vector_finds_itself_first(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    got = S.nearest(df.select(F.col("vec_id").alias("query_id"), "embedding"), df, 1)
    assert got.where("id <> query_id").count() == 0 and got.count() == df.count()


def test_cells_find_nine_in_ten(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    centers = S.train_cells(df, 16)
    indexed = S.with_cells(df, centers)
    assert indexed.where("cell is null or cell < 0").count() == 0 and indexed.count() == df.count()
    asked = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    probes = S.probes_for(indexed, centers, 10)
    assert 1 <= probes < 16
    found = S.nearest_in_cells(asked, indexed, centers, 10, probes)
    assert S.recall(S.nearest(asked, df, 10), found).agg(F.avg("recall")).first()[0] >= 0.9
    everywhere = S.nearest_in_cells(asked, indexed, centers, 10, 16)
    assert S.recall(S.nearest(asked, df, 10), everywhere).agg(F.min("recall")).first()[0] == 1


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    got = df.select(V.norm(a), V.cosine(a, b), V.squared_l2(a, b), V.norm(V.normalize_query(z)), V.norm(V.normalize_stored(z)), V.sigmoid(F.lit(0.0)), V.softmax_second(F.lit(1.0), F.lit(1.0)), V.clamp01(F.lit(7.0)), V.clamp01(F.lit(-1.0))).first()
    assert list(got) == pytest.approx([5, 0.96, 2, 0, 0, 0.5, 0.5, 1, 0])
    odd = spark.createDataFrame([([float("nan"), float("inf"), float("-inf"), 2.0],)], "a array<float>")
    assert odd.select(V.sanitize(F.col("a"))).first()[0] == [0, 1, -1, 2]
    assert odd.select(V.is_finite(F.col("a"))).first()[0] is False


def test_queries_of_several_lengths(spark, monkeypatch):
    monkeypatch.setattr(S, "SCORES", 8)
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 1.0, 0.0]), (5, []), (6, None), (7, [1.0, 0.1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in S.nearest(q, v, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {1: [1, 7], 2: [2, 7], 3: [3, 4], 4: [4, 3], 7: [7, 1]}


def test_tokens_of_few_texts_are_held_at_once(monkeypatch):
    texts = ["a b c", None, "", "d" * 30, "a a", "e f"]
    whole = providers.HashingEmbedder(8).encode(texts)
    monkeypatch.setattr(providers, "MOST_CHARS", 10)
    assert [list(r) for r in providers._runs(texts)] == [["a b c", None, ""], ["d" * 30], ["a a", "e f"]]
    assert (providers.HashingEmbedder(8).encode(texts) == whole).all() and whole.sum(axis=1).tolist() == [3, 0, 0, 1, 2, 2]
    assert providers.HashingEmbedder(8).encode([]).shape == (0, 8)


def test_small_batches_are_compared_together(monkeypatch):
    batch = lambda *ids: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([[float(i)] * 2 if i % 5 else None for i in ids], pa.list_(pa.float32()))], names=["i", "v"])
    monkeypatch.setattr(S, "ROW_BYTES", 48)
    got = [(i.tolist(), v[:, 0].tolist()) for i, v in S._together(iter([batch(1, 2), batch(5), batch(3, 4), batch(6)]), 2)]
    assert got == [([1, 2, 3, 4], [1, 2, 3, 4]), ([6], [6])]
