import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import langid as L


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = L.predict(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(L.remainder() == 2).collect()
    assert len(got) > 150 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_remainder(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    assert [r[0] for r in df.select(L.remainder()).collect()] == [zlib.crc32(str(i).encode()) % 4 for i in range(50)] + [0]


def test_only_training_rows_teach(spark, docs):
    from pyspark.sql import functions as F

    lied = docs.withColumn("lang", F.when(L.remainder() == 2, F.lit("xx")).otherwise(F.col("lang")))
    names, prototypes = L.fit(lied)
    assert "xx" not in names and np.allclose(prototypes, L.fit(docs)[1])


def test_vectors_bind_order_and_bundle():
    b = L.Bundler()
    one, two = b.bundle("abc"), b.bundle("cba")
    assert abs(one @ two) / (np.linalg.norm(one) * np.linalg.norm(two)) < 0.4
    twice = b.bundle("abc abc")
    assert one @ twice > 0.8 * np.linalg.norm(one) * np.linalg.norm(twice)
    assert b.bundle("123 !?") is None and b.bundle("") is None
    first, second, third = L._alphabet()
    ids, counts = np.unique(L.trigrams("some text, with words; and words"), return_counts=True)
    slow = sum(n * (first[i // L.CODES**2] * second[i // L.CODES % L.CODES] * third[i % L.CODES]).astype(int) for i, n in zip(ids, counts, strict=True))
    assert (b.bundle("some text, with words; and words") == slow).all()


def test_crowded_cache_changes_nothing(monkeypatch):
    text = " ".join(chr(97 + i % 26) + chr(97 + i * 7 % 26) + chr(97 + i * 11 % 26) for i in range(300))
    whole = L.Bundler().bundle(text)
    monkeypatch.setattr(L, "CACHE_ROWS", 16)
    assert (L.Bundler().bundle(text) == whole).all()


def test_odd_rows(spark, docs):
    model = L.fit(docs)
    odd = spark.createDataFrame([(1, None), (1, ""), (2, "12 34 !"), (None, "the and of with"), (3, "😀"), (4, "the " * 50000)], "doc_id long, text string")
    got = {(r["doc_id"], r["lang_pred"]) for r in L.predict(odd, model).collect()}
    assert (1, "und") in got and (2, "und") in got and (3, "und") in got and (4, "en") in got
    assert L.predict(odd.limit(0), model).count() == 0
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in L.predict(none, L.fit(none)).collect()] == ["und"]
    clash = docs.withColumnRenamed("source", "lang_pred").withColumnRenamed("n_chars", "score")
    assert L.predict(clash, L.fit(clash)).columns == ["doc_id", "lang_pred", "score"]


ITALIAN = "La lingua italiana viene parlata in tutto il territorio della penisola da milioni di persone che vivono nelle grandi città e nelle campagne. "
FINNISH = "Suomen kieltä puhuu noin viisi miljoonaa ihmistä, joista suurin osa asuu Suomessa ja loput muualla maailmassa. "
RUSSIAN = "Русский язык является одним из самых распространённых языков мира, на нём говорят миллионы людей. "


def test_stage_rejects_other_languages_and_keeps_clean_documents(spark, docs):
    r = random.Random(0)
    letters = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(n)) for n in (40, 100, 300) for _ in range(5)]
    german = [x["text"] for x in docs.where("lang = 'de' and n_chars > 200").orderBy("doc_id").limit(10).collect()]
    bad = [(None, None), ("", None), ("... 123", "en"), *((t * 3, None) for t in (ITALIAN, FINNISH, RUSSIAN)), *((t, None) for t in letters), *((t, "en") for t in german)]
    more = spark.createDataFrame([(10_001 + i, *x) for i, x in enumerate(bad)], "doc_id long, text string, lang string")
    all_ = docs.unionByName(more, allowMissingColumns=True)
    kept = L.keep_identified(all_)
    ids = {x[0] for x in kept.select("doc_id").collect()}
    clean = {x[0] for x in docs.select("doc_id").collect()}
    assert kept.columns == docs.columns
    assert len(ids & clean) >= 0.99 * len(clean)
    assert len(ids - clean) <= 1
    none = more.where("lang is null")  # nothing to learn from: only texts without letters go
    assert {x[0] for x in L.keep_identified(none).select("doc_id").collect()} == {10_001 + i for i, (t, lang) in enumerate(bad) if lang is None and t}
    assert L.keep_identified(docs.limit(0)).count() == 0


def slow_bundle(text):
    """(sum of trigram vectors, their number), from the definition, one trigram at a time."""

    def code(c):
        low = ord(c.lower()[0])
        return 0 if not c.isalpha() else low - 96 if 97 <= low <= 122 else 27 + (low - 0xC0) % 64 if 0xC0 <= low < 0x250 else 91 + low % 37

    words = "".join(chr(code(c)) for c in text or "").split("\0")
    joined = "\0" + "\0".join(w for w in words if w) + "\0"
    out = np.zeros(L.DIMENSIONS)
    if len(joined) < 3:
        return out, 0
    for (a, b, c), n in Counter(zip(joined, joined[1:], joined[2:], strict=False)).items():
        out += n * np.roll(LETTERS[ord(a)], 2) * np.roll(LETTERS[ord(b)], 1) * LETTERS[ord(c)]
    return out, len(joined) - 2


LETTERS = np.random.default_rng(L.SEED).integers(0, 2, (L.CODES, L.DIMENSIONS), np.int8).astype(int) * 2 - 1


def slow_prototypes(labelled):
    sums = {}
    for (v, n), lang in labelled:
        if lang is not None and n:
            sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    names = sorted(sums)
    units = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    units -= units.mean(axis=0)
    return names, units / np.linalg.norm(units, axis=1, keepdims=True)


def slow_prediction(rows, held_out):
    names, units = slow_prototypes([(slow_bundle(t), lang) for d, t, lang in rows if not held_out(d)])
    out = {}
    for d, text, _ in rows:
        v, n = slow_bundle(text)
        c = units @ v / np.linalg.norm(v) if n else None
        out[d] = ("und", 0.0) if c is None else (names[int(c.argmax())], max(0.0, float(c.max())))
    return out


def test_predictions_are_brute_force(spark, docs):
    rows = [(x["doc_id"], x["text"], x["lang"]) for x in docs.where("n_chars < 600").orderBy("doc_id").limit(120).collect()]
    rows += [(20_001, None, "en"), (20_002, "", None), (20_003, "42!", "de"), (20_004, "Größe für alle", None), (20_005, "漢字 кириллица", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in L.predict(df, L.fit(df)).collect()}
    want = slow_prediction(rows, lambda d: zlib.crc32(str(d).encode()) % 4 == 2)
    assert {d: p for d, (p, _) in got.items()} == {d: p for d, (p, _) in want.items()}
    assert all(got[d][1] == pytest.approx(want[d][1], abs=1e-4) for d in got)


def test_fit_and_limits_read_every_labelled_text(spark):
    r = random.Random(5)
    words = {"en": "the and of with from that have this".split(), "de": "der und von mit aus dass haben diese".split()}
    rows = [(i, " ".join(r.choices(words[lang], k=r.choice((1, 2, 3, 9)))), lang) for i in range(13_600) for lang in [r.choice(("en", "de"))]]
    held = {d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    names, prototypes = L.fit(df)
    bundles = {t: slow_bundle(t) for t in {t for _, t, _ in rows}}
    want_names, want = slow_prototypes([(bundles[t], lang) for d, t, lang in rows if d not in held])
    assert names == want_names and np.allclose(prototypes, want, atol=1e-6)
    assert (L.fit(df.repartition(3))[1] == prototypes).all()  # not even the last bit depends on where rows lie
    seen = []
    for d, t, lang in rows:
        if d in held:
            kind, c = L._cosines(t, prototypes)
            mine = names.index(lang)
            seen.append((kind, float(c.max()), float(c[mine] - c[1 - mine])))
    assert min(Counter(lang for d, _, lang in rows if d in held).values()) > 1_500
    least, lead = L.limits(df, (names, prototypes))
    for kind in {k for k, _, _ in seen}:
        near = [s for s in seen if abs(s[0] - kind) <= 1]
        best, own = sorted(s[1] for s in near), sorted(s[2] for s in near if s[2] > 0)
        assert least[kind] == L.SLACK * best[int(L.LOW * len(best))] and lead[kind] == own[int(L.LEAD * len(own))]
