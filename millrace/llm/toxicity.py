"""Toxicity by a classifier chain of linear models.

The categories, all labelled, are predicted one after the other: ``junk``
(quality 0), ``toxic_junk`` and ``toxic_text`` (toxic, of quality 0 and other),
and ``toxic``.  Each model is a logistic regression on the same features and on
the probabilities of the earlier categories.  For training these are
out-of-fold: a row's come from models whose features, scale and weights were
chosen without the rows of its fold.

Features are words and word beginnings of four to seven letters whose presence
separates the toxic rows of the sample, and a few shapes of the text.  The fit
reads a bounded sample of labelled rows; prediction reads every whole text.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialize, pick, scratch, small_batches

#: Labelled rows that the fit reads, about; chosen by a hash of doc_id.
FIT_ROWS = 12_000
FEATURES = 768
#: A feature needs this many toxic rows, and its log-ratio of rates must, two standard errors off, be this much.
LEAST_ROWS, LEAST_RATIO = 3, 0.2
FOLDS = 4
CATEGORIES = ("junk", "toxic_junk", "toxic_text", "toxic")
SHAPES = 6
#: Words whose features a worker keeps.
CACHE_WORDS = 400_000
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in (4, 5, 6, 7) if len(word) > k)]


def shapes(text: str, counts: Counter, total: int) -> list[float]:
    """Logarithm of the length, shares of distinct words, of symbols, of capitals, of digits, of lines."""
    n = max(1, len(text))
    letters = sum(map(len, counts)) and sum(len(w) * c for w, c in counts.items())
    lower = text.lower()
    if len(text) == len(lower):
        capitals = sum(a != b for a, b in zip(text, lower, strict=True))
    else:  # letters that are several in lower case
        capitals = sum(c != c.lower() for c in text)
    return [math.log1p(total) / 10, len(counts) / max(1, total), 1 - letters / n, capitals / n, sum(map(text.count, "0123456789")) / n, text.count("\n") / n]


@dataclass
class Model:
    words: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # for each category: features, then earlier categories, then the constant

    def vector(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
        return vector(text, self.words, cache)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the categories for rows of features."""
        x = (x - self.mean) / self.scale
        out = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            out = np.concatenate((out, _sigmoid(np.concatenate((x, out), axis=1) @ w[:-1] + w[-1])[:, None]), axis=1)
        return out


def vector(text: str | None, words: dict[str, int], cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    out = np.zeros(len(words) + SHAPES, np.float32)
    counts = Counter(_WORD.findall(text.lower())) if text else Counter()
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w, c in counts.items():
        at = cache.get(w)
        if at is None:
            at = cache[w] = tuple(words[f] for f in word_features(w) if f in words)
        for i in at:
            out[i] += c
    np.log1p(out, out=out)
    out[len(words) :] = shapes(text or "", counts, counts.total())
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 2e-4) -> np.ndarray:
    """Weights and constant of a ridge logistic regression, by accelerated gradient steps."""
    n, k = x.shape
    w, v = np.zeros(k + 1, np.float32), np.zeros(k + 1, np.float32)
    rate = 4 / (float((x * x).sum(axis=1).mean()) / 8 + 1)
    for t in range(steps):
        look = w + t / (t + 3) * v
        e = (_sigmoid(x @ look[:-1] + look[-1]) - y).astype(np.float32)
        g = np.append(e @ x / n + decay * look[:-1], e.mean()).astype(np.float32)
        new = look - rate * g
        w, v = new, new - w
    return w


def _scaled(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale of the features over ``rows``."""
    return x[rows].mean(axis=0), x[rows].std(axis=0) + 0.05


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, columns: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Mean, scale and the weights of each category in turn; earlier ones enter by out-of-fold probabilities.

    ``columns`` has the features to use by fold that is left out, at -1 those of
    the chain itself; by default all.
    """
    everyone = np.ones(len(x), bool)
    all_ = np.arange(x.shape[1])
    use = lambda f: all_ if columns is None else columns[f]
    parts = {}
    for f in (*np.unique(folds).tolist(), -1):
        rows = folds != f if f >= 0 else everyone
        mean, scale = _scaled(x[:, use(f)], rows if rows.any() else everyone)
        parts[f] = rows, (x[:, use(f)] - mean) / scale, mean, scale
    earlier, out = np.zeros((len(x), 0), np.float32), []
    for c in range(labels.shape[1]):
        y, apart = labels[:, c].astype(np.float32), np.zeros(len(x), np.float32)
        for f, (rows, z, _, _) in parts.items():
            full = np.concatenate((z, earlier), axis=1).astype(np.float32)
            w = logistic(full[rows], y[rows]) if rows.any() else np.zeros(full.shape[1] + 1, np.float32)
            if f < 0:
                out.append(w)
            else:
                apart[~rows] = _sigmoid(full[~rows] @ w[:-1] + w[-1])
        earlier = np.concatenate((earlier, apart[:, None]), axis=1)
    return parts[-1][2], parts[-1][3], out


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, toxic, junk, fold) of about ``rows`` labelled documents, one row for each doc_id."""
    known = pick(labels, "doc_id", "quality", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id")
    known = known.agg(F.max("toxic").alias("toxic"), F.when(F.min("quality") == 0, 1).otherwise(0).alias("junk"))
    total = max(1, known.count())
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_003))
    chosen = known.where(draw < min(1_000_003, 1_000_003 * rows // total)).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # about ``rows`` rows of three numbers
    return texts.groupBy("doc_id", "toxic", "junk", "fold").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def _chosen(counted: DataFrame, toxic: list[int], clean: list[int], left_out: int) -> list[str]:
    """The best features by the rows outside fold ``left_out`` (-1: by all rows); ``counted`` has counts of each fold, a of toxic rows and b of others."""
    folds = [f for f in range(FOLDS) if f != left_out]
    n, m = sum(toxic[f] for f in folds), sum(clean[f] for f in folds)
    a, b = (sum((F.col(c)[f] for f in folds), F.lit(0)) for c in ("a", "b"))
    rows = counted.select("f", a.alias("x"), b.alias("y")).where(F.col("x") >= LEAST_ROWS)
    ratio = F.log((F.col("x") + 0.5) / (n + 1)) - F.log((F.col("y") + 0.5) / (m + 1))
    least = ratio - 2 * F.sqrt(1 / (F.col("x") + 0.5) + 1 / (F.col("y") + 0.5))
    best = rows.withColumn("least", least).where(F.col("least") >= LEAST_RATIO).orderBy(F.desc("least"), "f").limit(FEATURES)
    return [r["f"] for r in best.select("f").collect()]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """The chain from labelled rows (doc_id, quality, toxic); None if none of them is toxic or none isn't.

    Of contradicting labels of a doc_id the toxic one and the lower quality count,
    of several rows of ``docs`` (doc_id, text) with it the text that is first in
    order.  The driver holds about ``rows`` vectors.
    """
    with scratch(docs.sparkSession):
        return _fit(docs, labels, rows)


def _fit(docs: DataFrame, labels: DataFrame, rows: int) -> Model | None:
    small_batches(docs.sparkSession)
    sample = materialize(_sample(docs, labels, rows).repartition(8), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for f in {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}:
                    if f not in seen:
                        seen[f] = np.zeros((2, FOLDS), np.int64)
                    seen[f][int(toxic <= 0), fold] += 1
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k].tolist() for v in seen.values()], kind) for k in (0, 1))], names=["f", "a", "b"])

    sizes = {(r["t"], r["fold"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("t"), "fold").agg(F.count("*").alias("n")).collect()}
    toxic, clean = ([sizes.get((t, f), 0) for f in range(FOLDS)] for t in (True, False))
    if not sum(toxic) or not sum(clean):
        return None
    counted = sample.select("text", F.col("toxic").cast("int"), "fold").mapInArrow(count, "f string, a array<long>, b array<long>")
    summed = lambda c: F.array(*[F.sum(F.col(c)[f]) for f in range(FOLDS)]).alias(c)
    counted = materialize(counted.groupBy("f").agg(summed("a"), summed("b")).where(F.aggregate("a", F.lit(0).cast("bigint"), lambda x, y: x + y) >= LEAST_ROWS), "features")
    chosen = {f: _chosen(counted, toxic, clean, f) for f in range(-1, FOLDS)}
    words = {w: i for i, w in enumerate(sorted(set().union(*chosen.values())))}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                v = vector(x, words, cache)
                at = np.flatnonzero(v)
                out.append(at.astype(np.int32).tobytes() + v[at].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(out, pa.binary())], names=["id", "toxic", "junk", "fold", "v"])

    got = sample.select(F.col("doc_id").cast("string").alias("id"), "text", F.col("toxic").cast("int"), "junk", "fold").mapInArrow(vectors, "id string, toxic int, junk int, fold int, v binary").collect()
    got.sort(key=lambda r: (r["id"], bytes(r["v"])))
    x = np.zeros((len(got), len(words) + SHAPES), np.float32)
    for i, r in enumerate(got):
        n = len(r["v"]) // 8
        x[i, np.frombuffer(r["v"], np.int32, n)] = np.frombuffer(r["v"], np.float32, n, 4 * n)
    bad, junk = np.array([r["toxic"] > 0 for r in got]), np.array([r["junk"] > 0 for r in got])
    shape_columns = list(range(len(words), len(words) + SHAPES))
    columns = {f: np.array([words[w] for w in names] + shape_columns) for f, names in chosen.items()}
    mean, scale, weights = fit_chain(x, np.stack((junk, bad & junk, bad & ~junk, bad), axis=1), np.array([r["fold"] for r in got]), columns)
    return Model({w: i for i, w in enumerate(chosen[-1])}, mean, scale, weights)


_CACHE: dict[str, dict[str, tuple[int, ...]]] = {}


def classify(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """(doc_id, p_junk, p_toxic_junk, p_toxic_text, p_toxic, toxic) for every row of ``docs`` (doc_id, text), from the whole text.

    toxic says whether p_toxic is ``least`` or more, so a tie with it counts.  A
    null or empty text, and every text if there is no model, has probabilities 0.
    Texts of any length are read whole.  Repeated rows give repeated results, an
    empty table an empty one; further columns of any name are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent, name = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _CACHE:
            _CACHE.clear()
            _CACHE[name] = {}
        cache, chain = _CACHE[name], sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = np.zeros((len(texts), len(CATEGORIES)))
            some = [i for i, x in enumerate(texts) if x]
            if some and chain is not None:
                p[some] = chain.predict(np.stack([chain.vector(texts[i], cache) for i in some]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(p[:, -1] >= least)], names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'p_{c} double' for c in CATEGORIES)}, toxic boolean")
