"""The corpus pipeline, stage by stage, against brute force: each stage is worked out again from its own input by other code."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
from millrace.llm import langid, mixing, secrets, shared
from millrace.llm.shared import materialize


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, f in C.STAGES:
        out.append(materialize(f(spark, out[-1], folder), name))
    return out


def test_stages_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "simhash_dedup", "decontamination", "secret_scan", "source_mixing"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert set(stages[0].columns) <= set(stages[-1].columns)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_languages(stages):
    from test_llm_langid import slow_bundle, slow_prototypes

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in stages[0].collect()]
    held = {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    assert max(Counter(lang for _, _, lang in rows).values()) <= langid.FIT_ROWS  # all of them are read
    bundles = {d: slow_bundle(t) for d, t, _ in rows}
    names, units = slow_prototypes([(bundles[d], lang) for d, _, lang in rows if d not in held])
    seen = {}
    for d, _, lang in rows:
        v, n = bundles[d]
        if n:
            c = units @ v / np.linalg.norm(v)
            mine = names.index(lang)
            seen[d] = n.bit_length(), c.max(), c[mine] - max(x for i, x in enumerate(c) if i != mine)
    least, lead = {}, {}
    for kind in range(33):
        near = [s for d, s in seen.items() if d in held and abs(s[0] - kind) <= 1]
        best, own = sorted(s[1] for s in near), sorted(s[2] for s in near if s[2] > 0)
        least[kind] = 0.7 * best[int(0.01 * len(best))] if best else least.get(kind - 1, -9)
        lead[kind] = own[int(0.1 * len(own))] if own else lead.get(kind - 1, 9)
    want = {d for d, (kind, top, own) in seen.items() if top >= least[kind] and -own < lead[kind]}
    assert set(texts(stages[1])) == want
    assert 0.98 * len(rows) < len(want) < len(rows)


def test_near_duplicates(stages):
    from test_llm_simhash import slow_classes

    least = slow_classes(sorted(texts(stages[1]).items()))
    assert set(texts(stages[2])) == {c for _, c in least.values()}


def test_decontamination(spark, folder, stages):
    from test_llm_decontam import slow_tiles

    words = lambda t: re.findall(r"\w+", (t or "").lower())
    fives = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    docs, kept = texts(stages[2]), set(texts(stages[3]))
    for d, text in docs.items():
        w = words(text)
        mine = fives(w)
        leaked = False
        for item in items:
            both = fives(item) & mine
            if both and len({x for i in range(len(item) - 4) if tuple(item[i : i + 5]) in both for x in range(i, i + 5)}) >= 0.8 * len(item):
                near = sorted({x for i in range(len(w) - 4) if tuple(w[i : i + 5]) in both for x in range(i, i + 5)})
                part = [w[x] if x == y + 1 else f"|{w[x]}" for x, y in zip(near, [near[0] - 1, *near], strict=False)]
                part = [p for x in part for p in (["|", x[1:]] if x.startswith("|") else [x])]
                leaked |= sum(n for *_, n in slow_tiles(item, part, 5)) >= 0.8 * len(item)
        assert leaked == (d not in kept)
    assert len(kept) < len(docs)


def slow_spans(text):
    """All spans by the patterns' own matches, and weak ones by comparing each with each."""
    flags = lambda p: re.A | (re.I if p.startswith("(?i)") else 0)
    found = []
    for rank, (_, pattern, group, enough) in enumerate(secrets.KINDS):
        for m in re.finditer(pattern, text or "", flags(pattern)):
            mixed = all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))
            if len(m[group]) >= enough and (rank != 4 or mixed):
                found.append((m.start(), rank, m.end()))
    base = [s for s in found if s[1] < 3]
    out = list(base)
    for a, rank, b in found:
        if rank >= 3 and not any(x < b and a < y for x, _, y in base):
            other = (1, 3, 5) if rank == 4 else (0, 2, 4)
            if any(k in other and max(a - y, x - b) <= secrets.SCOPE for x, k, y in found):
                out.append((a, rank, b))
    return sorted(out)


def test_secrets(stages):
    docs, masked = texts(stages[3]), texts(stages[4])
    assert set(docs) == set(masked)
    touched = 0
    for d, text in docs.items():
        out, at = "", 0
        for a, _, b in slow_spans(text):
            if a >= at:
                out += (text or "")[at:a] + secrets.MASK
            at = max(at, b)
        assert masked[d] == (out + text[at:] if text is not None else None)
        touched += at > 0
    assert touched > 10


def test_mixing(stages):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in stages[4].collect()]
    n = Counter(s for _, s, _ in rows)
    total = sum(math.sqrt(c) for c in n.values())
    want = Counter()
    for d, s, text in rows:
        rate = math.sqrt(n[s]) / total * len(rows) / n[s]
        assert rate <= mixing.CHUNK
        draw = hashlib.md5(f"{mixing.SEED}:poisson:{d}:{hashlib.md5((text or '').encode()).hexdigest()}:0".encode()).hexdigest()
        u, k, p = (int(draw[:13], 16) + 0.5) / 2**52, 0, math.exp(-rate)
        below = p
        while below < u:
            k += 1
            p *= rate / k
            below += p
        want[d] = k
    got = Counter(r["doc_id"] for r in stages[5].select("doc_id").collect())
    assert got == +want and texts(stages[5]) == {d: t for d, t in texts(stages[4]).items() if d in got}


def test_run_is_the_stages_and_leaves_one_table(spark, folder, stages):
    key = lambda df: sorted(hashlib.md5(repr((r["doc_id"], r["copy_no"], r["text"])).encode()).hexdigest() for r in df.select("doc_id", "copy_no", "text").collect())
    top = shared.work.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    assert key(C.run(spark, folder)) == key(stages[-1])
    assert [n.rpartition("-")[0] for n in set(os.listdir(top)) - before] == ["source_mixing"]
    assert C.ORACLE_SQL is None


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, f in C.STAGES:
        docs = materialize(f(spark, docs, small), name)
    assert docs.count() == 0
