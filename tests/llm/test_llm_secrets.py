import hashlib
import random
import re

from millrace.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


PARTS = [
    "password = hunter2hunter2", "PassWD:'short'", 'api_key: "0123456789abcdef"', "apikey=x", "token  =  abcdefgh", "AKIAABCDEFGHIJKL", "AKIASHORT", "0" * 32, "f" * 31, "deadbeef" * 5,
    "É ", "\n", "😀", " user: bob ", "https://h.example/x?y=1 ", "10.1.2.3:80 ", "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA", "secret=", "=token:token=tokentoken", " words ", "x" * 250,
]


def texts():
    r = random.Random(4)
    return ["", None, *("".join(r.choices(PARTS, k=r.randint(1, 14))) for _ in range(400)), "password=" + "a" * 30000, ("token=abcdefghij " * 500)]


def scanned(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    return {r["doc_id"]: r for r in S.scan(df).collect()}


def test_base_spans_are_the_contracts(spark):
    rows = texts()
    got = scanned(spark, rows)
    names = ("assign", "access", "hex")
    for i, text in enumerate(rows):
        want = base(text)
        shown = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in want) for j in range(3)), text
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if s.split(":")[0] in names] == (shown.split(",") if shown else [])
        starts = [int(s.split(":")[1]) for s in spans]
        assert starts == sorted(starts)


def kinds(spark, text):
    return [s.split(":")[0] for s in scanned(spark, [text])[0]["spans"].split(",") if s]


def test_weak_parts_count_only_together(spark):
    key = "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA"
    assert kinds(spark, "user: bob lives here") == []
    assert kinds(spark, f"digest {key}") == []
    assert kinds(spark, "see https://h.example/") == []
    assert kinds(spark, f"user: bob {key}") == ["linked_identifier", "linked_secret"]
    assert kinds(spark, f"user: bob {key} https://h.example/") == ["linked_identifier", "linked_secret", "linked_endpoint"]
    assert kinds(spark, "user: bob password=hunter2hunter2") == ["linked_identifier", "assign"]
    far = "x " * 150
    assert kinds(spark, f"user: bob {far}{key}") == []
    assert kinds(spark, f"user: bob {far}password=hunter2hunter2") == ["assign"]


def test_scope_counts_what_lies_between(spark):
    """A part right behind a long one is near it, however far its start is."""
    key, long = "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MA", "https://h.example/" + "x" * 400
    assert kinds(spark, f"{long} {key}") == ["linked_endpoint", "linked_secret"]
    assert kinds(spark, f"{key} {'-' * 150} {long}") == ["linked_secret", "linked_endpoint"]
    assert kinds(spark, f"{long} {'-' * 198} {key}") == ["linked_endpoint", "linked_secret"]
    assert kinds(spark, f"{long} {'-' * 199} {key}") == []
    assert kinds(spark, f"{key} {'-' * 199} {long}") == []


def test_redaction(spark):
    rows = texts()
    df = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in enumerate(rows)], "doc_id long, text string, n_chars long, found string")
    got = {r["doc_id"]: r for r in S.redact(df).collect()}
    assert S.redact(df).columns == df.columns and len(got) == len(rows)
    spans = scanned(spark, rows)
    for i, text in enumerate(rows):
        cut = [tuple(map(int, s.split(":")[1:])) for s in spans[i]["spans"].split(",") if s]
        if not cut:
            assert got[i]["text"] == text
            continue
        out, at = "", 0
        for a, b in sorted(cut):
            if a >= at:
                out += text[at:a] + S.MASK
            at = max(at, b)
        assert got[i]["text"] == out + text[at:]
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_large_and_small_ways_of_redaction_agree(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    small = sorted(map(repr, S.redact(df).collect()))
    monkeypatch.setattr(S, "BROADCAST_TEXTS", 0)
    assert sorted(map(repr, S.redact(df).collect())) == small


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.scan(none).count() == 0 and S.redact(none).count() == 0
    odd = spark.createDataFrame([(None, "token=abcdefghij", "k"), (1, "token=abcdefghij", "k"), (1, "token=abcdefghij", "k"), (2, None, None)], "doc_id long, text string, key string")
    assert sorted((r["doc_id"] or 0, r["n_assign"]) for r in S.scan(odd).collect()) == [(0, 1), (1, 1), (1, 1), (2, 0)]
    assert sorted(r["text"] or "" for r in S.redact(odd).collect()) == ["", S.MASK, S.MASK, S.MASK]


def test_native(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (S.scan(docs), S.redact(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
