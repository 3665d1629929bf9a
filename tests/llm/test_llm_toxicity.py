import math
import re

import numpy as np
import pytest

from millrace.llm import toxicity as X


@pytest.mark.parametrize("sf,least", [("sf0.1", 0.85), ("sf0.01", 0.6)])
def test_half_predicts_the_other_half(spark, sf, least):
    """With the 200 labels of sf0.01 (35 toxic ones to find) it finds two thirds, with ten times as many nine tenths."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(docs, labels.where("doc_id % 2 = 0"))
    got = X.classify(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "y"), "doc_id").collect()
    toxic = [r["toxic"] for r in got if r["y"] == 1]
    clean = [r["toxic"] for r in got if r["y"] == 0]
    assert len(toxic) > 10 and sum(toxic) / len(toxic) >= least and sum(clean) / len(clean) <= 0.02


def test_logistic_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 3)).astype(np.float32)
    y = (x[:, 0] > 0.2).astype(np.float32)
    w = X.logistic(x, y)
    assert ((X._sigmoid(x @ w[:-1] + w[-1]) > 0.5) == (y > 0.5)).mean() > 0.97


def test_later_models_see_out_of_fold_predictions(monkeypatch):
    """A feature that names each row teaches nothing about rows left out, so earlier predictions must not know their own labels."""
    n = 60
    x, labels = np.eye(n, dtype=np.float32), np.random.default_rng(1).integers(0, 2, (n, 2)).astype(bool)
    seen = []
    real = X.logistic
    monkeypatch.setattr(X, "logistic", lambda a, y, *k: seen.append(a) or real(a, y, *k))
    X.fit_chain(x, labels, np.arange(n) % 4)
    assert seen[0].shape[1] == n and seen[-1].shape[1] == n + 1
    earlier = seen[-1][:, -1]
    inside = np.corrcoef(earlier, labels[:, 0])[0, 1]
    assert not inside > 0.3


def test_nothing_of_a_fold_enters_its_predictions(monkeypatch):
    """Features, scale and weights behind the out-of-fold probabilities of a fold stay as they are when its labels and features change."""
    r = np.random.default_rng(2)
    x, labels, folds = r.normal(size=(80, 6)).astype(np.float32), r.integers(0, 2, (80, 1)).astype(bool), np.arange(80) % 4
    columns = {f: np.array([0, 1, 2]) if f == 2 else np.arange(6) for f in (-1, 0, 1, 2, 3)}
    seen = []
    real = X.logistic
    monkeypatch.setattr(X, "logistic", lambda a, y, *k: seen.append((a, y)) or real(a, y, *k))
    X.fit_chain(x, labels, folds, columns)
    before = seen[2]
    seen.clear()
    x[folds == 2] += 100
    labels[folds == 2] ^= True
    X.fit_chain(x, labels, folds, columns)
    assert before[0].shape == (60, 3) and (before[0] == seen[2][0]).all() and (before[1] == seen[2][1]).all()


def test_features_are_chosen_without_the_fold_left_out(spark):
    rows = [(f"only{f}", [9 if g == f else 0 for g in range(X.FOLDS)], [0] * X.FOLDS) for f in range(X.FOLDS)] + [("all", [9] * X.FOLDS, [0] * X.FOLDS), ("both", [9] * X.FOLDS, [90] * X.FOLDS)]
    counted = spark.createDataFrame(rows, "f string, a array<long>, b array<long>")
    chosen = lambda f: set(X._chosen(counted, [10] * X.FOLDS, [100] * X.FOLDS, f))
    assert chosen(-1) == {"all", *(f"only{f}" for f in range(X.FOLDS))}
    assert chosen(1) == chosen(-1) - {"only1"}


def slow_probabilities(text, model):
    """The chain's definition for one text, without matrices."""
    if not text:
        return [0.0] * len(X.CATEGORIES)
    found = re.findall(r"\w+", text.lower())
    x = [0.0] * len(model.words)
    for w in found:
        for f in [w] + [w[:k] + "*" for k in (4, 5, 6, 7) if k < len(w)]:
            if f in model.words:
                x[model.words[f]] += 1
    x = [math.log1p(v) for v in x]
    n = max(1, len(text))
    x += [math.log1p(len(found)) / 10, len(set(found)) / max(1, len(found)), 1 - sum(map(len, found)) / n]
    x += [sum(c != c.lower() for c in text) / n, sum(c in "0123456789" for c in text) / n, text.count("\n") / n]
    z = [(v - m) / s for v, m, s in zip(x, model.mean.tolist(), model.scale.tolist(), strict=True)]
    for w in model.weights:
        z.append(1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(z, w[:-1].tolist(), strict=True)) + float(w[-1]))))))
    return z[len(x) :]


def test_results_are_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(docs, labels)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "İstanbul ŞİİR Straße"), (-4, "!!!\n\n12")], "doc_id long, text string")
    rows = docs.where("n_chars < 3000").select("doc_id", "text").limit(300).unionByName(more)
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for r in X.classify(rows, model).collect():
        want = slow_probabilities(texts[r["doc_id"]], model)
        assert [r[f"p_{c}"] for c in X.CATEGORIES] == pytest.approx(want, abs=1e-4)
        assert r["toxic"] == (r["p_toxic"] >= 0.5)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "some words", 0.1), (3, "scum " * 60_000, 0.1), (3, "some words", 0.1)], "doc_id long, text string, p_toxic double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.fit(docs, none) is None
    got = X.classify(docs, None).collect()
    assert len(got) == 5 and not any(r["toxic"] for r in got)
    labels = spark.createDataFrame([(3, None, 1), (2, 1, 0), (1, 1, 0), (None, 0, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    model = X.fit(docs, labels)
    assert X.classify(docs, model).count() == 5 and X.classify(docs.limit(0), model).count() == 0
