import math
from collections import Counter

import numpy as np
import pytest

from millrace.llm import quality as Q


def slow_model(texts):
    """log p of each four-gram by plain dictionaries."""
    grams = Counter(tuple(int(g) // Q.CODES**i % Q.CODES for i in range(3, -1, -1)) for t in texts if t for g in Q.grams(t))
    counts = {4: grams}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        if not all(n):
            return [0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]

    d = {k: discounts(c) for k, c in counts.items()}
    tail = {k: {} for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            t = tail[k].setdefault(g[:-1], [0, 0.0])
            t[0] += v
            t[1] += d[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / Q.CODES
        k, below = len(g), p(g[1:])
        if g[:-1] not in tail[k]:
            return below
        total, held = tail[k][g[:-1]]
        v = counts[k].get(g, 0)
        return (v - d[k][min(v, 3) - 1] if v else 0) / total + held / total * below

    return p


TEXTS = ["the cat sat on the mat.", "the dog, the cat and THE bird; 42 times!", "á è ñ ü ß", "aaaa aaaa aaaa", "x", "the end | of the the end"]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,), ("",)], "text string").repartition(3)
    return Q.log_table(Q.fit(df))


def test_probabilities_are_the_definitions(table):
    p = slow_model(TEXTS)
    for g in [int(x) for t in (*TEXTS, "cats and dogs zzz") for x in Q.grams(t)]:
        want = p(tuple(g // Q.CODES**i % Q.CODES for i in range(3, -1, -1)))
        assert math.exp(table[g]) == pytest.approx(want, rel=1e-4)


def test_each_context_sums_to_one(table):
    sums = np.exp(table.reshape(-1, Q.CODES)[:: 4099].astype(np.float64)).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)


def test_counts_flush(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").coalesce(1)
    want = {tuple(r) for r in Q.counts(df).collect()}
    monkeypatch.setattr(Q, "FLUSH", 4)
    assert {tuple(r) for r in Q.counts(df).collect()} == want
    assert sum(c for _, c in want) == 3 * sum(len(t) + 1 for t in TEXTS)


def test_junk_is_told_from_text(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.classify(docs, labels).join(labels, "doc_id").collect()
    good = [r["keep"] for r in got if r["quality"] == 1]
    bad = [r["keep"] for r in got if r["quality"] == 0]
    assert sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.3


def test_classification_is_brute_force(spark):
    """Perplexity, threshold and decision from plain dictionaries, for every row."""
    r = np.random.default_rng(3)
    words = "the cat dog sat on mat and a bird sang of 42 trees".split()
    docs = [(i, " ".join(r.choice(words, int(r.integers(3, 12)))), ("en", "de", None)[i % 3]) for i in range(60)] + [(100 + i, "###"[: i + 1] + " zzz qqq", "en") for i in range(3)] + [(200, None, "en"), (201, "", "fr"), (202, "the cat", "fr")]
    labels = [(i, int(i % 5 > 0)) for i in range(60)]
    df, lf = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    teaches = {x["doc_id"]: x["teaches"] for x in Q._trusted(lf).collect()}
    assert set(teaches) == {i for i, q in labels if q} and 0.2 < sum(teaches.values()) / len(teaches) < 0.8
    p = slow_model([t for d, t, _ in docs if teaches.get(d)])
    perplexity = {d: math.exp(-sum(math.log(p(tuple(int(g) // Q.CODES**i % Q.CODES for i in range(3, -1, -1)))) for g in Q.grams(t)) / len(Q.grams(t))) if t else None for d, t, _ in docs}
    held = {}
    for d, t, lang in docs:
        if teaches.get(d) is False and t:
            held.setdefault(lang, []).append(perplexity[d])
            held.setdefault("all", []).append(perplexity[d])
    cut = {k: sorted(v)[math.ceil(0.9 * len(v)) - 1] for k, v in held.items()}
    for x in Q.classify(df, lf, 0.9).collect():
        want = perplexity[x["doc_id"]]
        assert (x["perplexity"] is None) == (want is None)
        if want is not None:
            assert x["perplexity"] == pytest.approx(want, rel=1e-3)
        assert x["threshold"] == pytest.approx(cut.get(x["lang"], cut["all"]), rel=1e-3)
        assert x["keep"] == (want is not None and x["perplexity"] <= x["threshold"])


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en", 1), (1, "the cat sat", "en", 1), (2, None, "en", 1), (3, "", None, 1), (None, "zzz", None, 1), (4, "q" * 100_000, "fr", 1)], "doc_id long, text string, lang string, own int")
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, 0), (4, 1)], "doc_id long, quality int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == 6 and sum(r["keep"] for r in got if r["doc_id"] == 1) == 2
    assert all(r["perplexity"] is None and not r["keep"] for r in got if r["doc_id"] in (2, 3))
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert all(r["keep"] == (r["perplexity"] is not None) for r in Q.classify(docs, labels.limit(0)).collect())


def test_no_two_characters_share_a_symbol(spark):
    """Texts that differ in one character have perplexities of their own, under counts that tell the characters apart."""
    texts = ["ABCABC ABC", "éà éà éà", "дом дом", "漢字 漢字", "\0a\0a", "😀 1 2 1"]
    letters = "ABéQàдм漢字\0😀12#+"
    assert len({Q.grams(c)[0] for c in letters}) == len(letters)
    docs = [(i, t, "en") for i, t in enumerate(texts * 2)] + [(100 + i, t, "en") for i, t in enumerate(["ABC", "BCA", "QQQ", "é", "à", "ù", "漢", "1 2", "2 1", "+", "#"])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    p = slow_model(texts)
    got = {r["doc_id"]: r["perplexity"] for r in Q.perplexities(df, Q.fit(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()}
    for d, t, _ in docs:
        g = [tuple(x // Q.CODES**i % Q.CODES for i in range(3, -1, -1)) for x in Q.grams(t)]
        assert g[0] == (0, 0, 0, ord(t[0]) + 1)
        assert got[d] == pytest.approx(math.exp(-sum(math.log(p(x)) for x in g) / len(g)), rel=1e-9)
    assert len({round(got[100 + i], 6) for i in (0, 1, 2)}) == 3


def test_blocks_and_large_alphabets_change_nothing(spark, monkeypatch):
    many = "".join(chr(c) for c in range(0x20000, 0x20000 + 60_000))  # more than keys of 63 bits can hold
    texts = [*TEXTS, many, None, "", "the cat"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang").coalesce(1)
    model = Q.fit(df)
    one = {r["doc_id"]: r["perplexity"] for r in Q.perplexities(df, model).collect()}
    monkeypatch.setattr(Q, "BLOCK", 1)
    monkeypatch.setattr(Q, "small_batches", lambda spark: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1"))
    two = {r["doc_id"]: r["perplexity"] for r in Q.perplexities(df, model).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    assert set(one) == set(two) == set(range(len(texts))) and one[len(TEXTS) + 1] is None
    assert all(one[d] == pytest.approx(two[d], rel=1e-12) if one[d] else two[d] is None for d in one)


def test_packed_texts_are_written_once(spark, monkeypatch):
    """Only answers move to the texts: no exchange by block, whatever the number of blocks, and no named table is left."""
    monkeypatch.setattr(Q, "BLOCK", 1)
    texts = [f"{t} {i}" for i in range(40) for t in TEXTS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang").repartition(20)
    tables = spark.catalog.listTables()
    found = Q.perplexities(df, Q.fit(df))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Bucketed: true" in plan and "hashpartitioning(block" not in plan
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(len(texts)))
    assert spark.catalog.listTables() == tables
