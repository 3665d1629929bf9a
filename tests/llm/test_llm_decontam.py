import random
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import decontam as D


def slow_tiles(a, b, k):
    """Every round looks at all pairs of places."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                    n += 1
                if n >= k and (best is None or (-n, i, j) < best):
                    best = (-n, i, j)
        if best is None:
            return sorted(out)
        n, i, j = -best[0], best[1], best[2]
        out.append((i, j, n))
        for x in range(n):
            used_a[i + x] = used_b[j + x] = True


sequence = st.lists(st.integers(1, 3), max_size=25)


@settings(max_examples=300, deadline=None)
@given(sequence, sequence, st.integers(2, 4))
def test_tiles_are_greedy_string_tiling(a, b, k):
    assert sorted(D.tile(np.array(a, np.int64), np.array(b, np.int64), k)) == slow_tiles(a, b, k)


def slow_leaks(docs, items, least=0.8):
    out = set()
    for d, text in docs:
        for i, item in items:
            a, b = D.tokens(item or ""), D.tokens(text or "")
            k = min(5, len(a))
            if a and sum(n for *_, n in slow_tiles(a, b, k)) / len(a) >= least:
                out.add((d, i))
    return out


def inputs():
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choices(vocab, k=r.randint(4, 20)))) for i in range(12)] + [(50, None), (51, ""), (52, "one two"), (53, "w3, w4"), (54, "w7 w1 w2 w9")]
    docs = []
    for d in range(40):
        text = r.choices(vocab, k=r.randint(0, 25))
        if d % 2:
            item = r.choice(items[:12])[1].split()
            h = len(item) // 2
            text = text[:5] + r.choice([item, item[h:] + ["x"] + item[:h], item[: max(1, h)], item]) + text[5:]
        docs.append((d, ", ".join(text).upper() if d % 3 else " ".join(text)))
    return [*docs, (90, None), (91, "")], items


def test_leaks_are_brute_force(spark):
    docs, items = inputs()
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = slow_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 8


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    docs, items = inputs()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.leaks(d, b).collect()))
    clean = sorted(map(repr, D.keep_clean(d, b).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)
    assert sorted(map(tuple, D.leaks(d, b).collect())) == whole
    assert sorted(map(repr, D.keep_clean(d, b).collect())) == clean


def test_reordered_passages_leak_and_parts_do_not(spark):
    words = [f"token{i}" for i in range(40)]
    item = [(1, " ".join(words))]
    swapped = " ".join(["before", *words[20:], "between", *words[:20], "after"])
    docs = [(1, swapped), (2, " ".join(words[:25])), (3, " ".join(words[i // 2] if i % 2 else "z" for i in range(80))), (4, "x " * 50000 + " ".join(words))]
    got = {r["doc_id"]: r for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string")).collect()}
    assert sorted(got) == [1, 4] and got[1]["n_tiles"] == 2 and got[1]["coverage"] == 1.0


def test_texts_that_say_one_word_over_and_over():
    """A megabyte of it against a long item: the work is not the product of both."""
    began = time.perf_counter()
    same, two = D.Seeds([(1, "a " * 2000)]), D.Seeds([(2, "a b c " * 700)])
    assert same.leaks("a " * 500_000) == [(1, 1.0, 1, 2000, 2000, 2000)]
    assert same.leaks("a " * 1000) == []
    assert two.leaks("a b " * 250_000) == [] and two.leaks("b c a " * 170_000)[0][:2] == (2, 1.0)
    assert time.perf_counter() - began < 30
    tracemalloc.start()
    same.leaks("a " * 500_000)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_short_items_and_scripts_without_spaces(spark):
    items = spark.createDataFrame([(1, "これは日本語の文です。"), (2, "two words"), (3, "本")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "前置き、これは日本語の文です、後"), (2, "Two, WORDS!"), (3, "two other words"), (4, "日本語の本"), (5, "two words twice two words")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["item_tokens"]) for r in D.leaks(docs, items).collect())
    assert got == [(1, 1, 1, 10), (1, 3, 1, 1), (2, 2, 1, 2), (4, 3, 1, 1), (5, 2, 1, 2)]


def test_keep_clean_and_odd_tables(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(1, text, "m"), (1, text, "m"), (2, "other", None), (None, None, "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, text), (7, text)], "item_id long, text string")
    kept = D.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2]
    assert D.leaks(docs, bench).count() == 2
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0
    assert D.keep_clean(docs, bench.limit(0)).count() == 4
