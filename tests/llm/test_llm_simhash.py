import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash as S
from millrace.llm.components import components


def slow_fingerprint(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (fps[i], least[find(i)]) for i, (d, _) in enumerate(rows)}


def apart(a, b):
    return ((int(a) ^ int(b)) % 2**64).bit_count()


def texts(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ÀB", "x\x0by", "a b"]
    base = [" ".join(r.choices(vocab, k=r.choice([0, 1, 3, 4, 30, 120]))) for _ in range(n // 2)]
    out = list(base)
    for _ in range(n - len(base)):
        words = r.choice(base).split(" ")
        if len(words) > 20:
            words[r.randrange(len(words))] = r.choice(vocab)
        out.append(r.choice([" ", "\n", "\t"]).join(words).upper() if r.random() < 0.3 else " ".join(words))
    return out


def test_fingerprints_and_classes_are_brute_force(spark):
    rows = list(enumerate(texts(1, 300))) + [(900, None), (901, ""), (902, " \n"), (903, "x " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in S.classes(df).collect()}
    assert got == slow_classes(rows)
    assert got[900][0] == got[901][0] == got[902][0] == 0


@pytest.mark.parametrize("block", [1, 64, 1 << 18])
@pytest.mark.parametrize("spread", [2, 6, 20])
def test_shards_lose_no_link(monkeypatch, block, spread):
    monkeypatch.setattr(S, "BLOCK", block)
    r = np.random.default_rng(spread)
    seeds = r.integers(-(2**63), 2**63, 12)
    fps = np.unique(np.concatenate([[(s ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, spread), replace=False))) % 2**64 for _ in range(30)] for s in seeds.tolist()]).astype(np.uint64)).view(np.int64)
    trees = [S._top_tree(S._quarter(fps[::3], q), 3) for q in range(4)]
    shard, fp, home = S._route(fps, trees, 3)
    found = np.concatenate([S.shard_links(fp[shard == s], home[shard == s], int(s) >> 3) for s in np.unique(shard)])

    def classes(pairs):
        sets = {int(f): {int(f)} for f in fps}
        for a, b in pairs:
            if sets[int(a)] is not sets[int(b)]:
                merged = sets[int(a)] | sets[int(b)]
                for x in merged:
                    sets[x] = merged
        return {frozenset(s) for s in sets.values()}

    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if apart(a, b) <= 4]
    assert classes(found) == classes(near)
    assert all(apart(a, b) <= 4 for a, b in found)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (201, 200), (5, 5), (300, 400), (400, 301)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200, 300: 300, 301: 300, 400: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, long, "a"), (3, long, "b"), (9, long + " tail", None), (7, "something else entirely in here", "a"), (7, "something else entirely in here", "a"), (None, long, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = S.keep_one(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 7]


def test_keep_one_goes_by_rows(spark):
    """A doc_id that stands for several texts, and rows without any."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (None, c), (None, c), (None, a), (5, b), (4, "x y z"), (4, "other words, none the same"), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for _ in range(2):
        assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in S.keep_one(df).collect()))) == sorted(map(repr, [(1, a), (2, b), (None, c), (4, "x y z"), (4, "other words, none the same"), (8, "")]))
    assert S.keep_one(df.where("doc_id is null and text is not null")).count() == 2


def test_crowded_shards_lose_no_link(spark):
    """A third of all fingerprints share a quarter, and some differ from one another by up to four bits."""
    r = np.random.default_rng(5)
    fps = [int(x) for x in r.integers(-(2**63), 2**63, 400)]
    fps += [(x & ~0xFFFF) | 0x1234 for x in fps[:200]]
    for x in fps[:150] + fps[400:500]:
        flips = r.choice(64, r.integers(1, 5), replace=False)
        fps.append(int(np.uint64(x % 2**64 ^ sum(1 << int(f) for f in flips)).view(np.int64)))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if apart(a, b) <= 4]

    def classes(pairs):
        up = {x: x for x in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        groups = {}
        for x in fps:
            groups.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    sizes = S._crowded(df.mapInArrow(lambda bs: iter(()), "shard int, sub int, fp long, home boolean"), 1)
    assert len(sizes) == 0
    for most in (20, 120, 10**6):
        assert classes([(x["a"], x["b"]) for x in S.links(df, most=most).collect()]) == classes(near)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.classes(none).count() == 0 and S.keep_one(none).count() == 0
    same = spark.createDataFrame([(1, "a b c d e", 0), (1, "a b c d e", 0), (2, "a b c d e", 0)], "doc_id long, text string, component_id int")
    assert sorted((r["doc_id"], r["component_id"]) for r in S.classes(same).collect()) == [(1, 1), (1, 1), (2, 1)]
