import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import mixing as M


def slow_counts(rows, weights=None, power=0.5):
    n = Counter(s for _, s in rows)
    w = {s: weights.get(s, 0.0) if weights is not None else c**power for s, c in n.items()}
    total = sum(w.values())
    out = Counter()
    for d, s in rows:
        rate = w[s] / total * len(rows) / n[s] if total else 0.0
        chunks = max(1, math.ceil(rate / M.CHUNK))
        for j in range(chunks):
            name = f"{'' if d is None else d}:{hashlib.md5(f'text {d}'.encode()).hexdigest()}"
            u = (int(hashlib.md5(f"{M.SEED}:poisson:{name}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            k, p = 0, math.exp(-rate / chunks)
            c = p
            while c < u and k < M.TABLE - 1:
                k += 1
                p *= rate / chunks / k
                c += p
            out[d] += k
    return +out


def frame(spark, rows):
    return spark.createDataFrame([(d, s, f"text {d}") for d, s in rows], "doc_id long, source string, text string").repartition(4)


ROWS = [(i, "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]


def test_counts_are_brute_force(spark):
    got = Counter(r["doc_id"] for r in M.replicate(frame(spark, ROWS)).select("doc_id").collect())
    assert got == slow_counts(ROWS)


def test_high_rates(spark):
    rows = [(i, "rare" if i < 10 else "other") for i in range(2000)]
    weights = {"rare": 0.7, "other": 0.3}
    got = Counter(r["doc_id"] for r in M.replicate(frame(spark, rows), weights).select("doc_id").collect())
    assert got == slow_counts(rows, weights)
    assert abs(sum(n for d, n in got.items() if d < 10) - 1400) < 200


def test_shares_come_out(spark):
    df = M.replicate(frame(spark, ROWS))
    sizes = Counter(s for _, s in ROWS)
    total = sum(n**0.5 for n in sizes.values())
    got = {r["source"]: r["n"] for r in df.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for s, n in sizes.items():
        want = n**0.5 / total * len(ROWS)
        assert abs(got[s] - want) < 5 * want**0.5
    numbered = df.groupBy("doc_id").agg(F.max("copy_no").alias("m"), F.count("*").alias("n"))
    assert numbered.where("m <> n").count() == 0


def test_same_every_time_and_shuffled(spark):
    a = M.replicate(frame(spark, ROWS)).select("doc_id", "copy_no", "shuffle_key")
    b = M.replicate(frame(spark, ROWS).repartition(7)).select("doc_id", "copy_no", "shuffle_key")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    ids = [r["doc_id"] for r in a.collect()]
    assert sum(x < y for x, y in zip(ids, ids[1:], strict=False)) < 0.6 * len(ids)


def test_rows_without_id_draw_each_for_itself(spark):
    """A third of the rows has no doc_id: they neither share a draw nor a place."""
    rows = [(None if i % 3 == 0 else i, "a", f"text {i}") for i in range(3000)]
    df = M.replicate(spark.createDataFrame(rows, "doc_id long, source string, text string"), {"a": 1.0})
    hot = df.where("doc_id is null")
    assert hot.select("shuffle_key").distinct().count() == hot.count()
    assert len({r["n"] for r in hot.groupBy("text").agg(F.count("*").alias("n")).collect()}) > 2


def test_odd_tables(spark):
    assert M.replicate(frame(spark, ROWS).limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, None, 5), (1, None, None, 5), (None, "a", "t", 6), (None, "a", "t", 6)], "doc_id long, source string, text string, rate int")
    got = M.replicate(odd, {None: 0.5, "a": 0.5})
    assert dict(got.dtypes)["rate"] == "double"
    n = Counter((r["doc_id"], r["source"]) for r in got.collect())
    assert all(v % 2 == 0 for v in n.values())
    assert M.replicate(odd, {"missing": 1.0}).count() == 0


def test_native(spark):
    assert not re.search("Python|Pandas|Arrow", M.replicate(frame(spark, ROWS))._jdf.queryExecution().optimizedPlan().toString())
