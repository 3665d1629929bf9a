"""Manifest, frontier, integrity, export, errors and their files."""

import datetime as dt
import inspect
import os

import pytest
from pyspark.sql import functions as F

from millrace import errors
from millrace.config import Index, described, download_instructions
from millrace.functions import urls
from millrace.operators import export, frontier, history, integrity, manifest, saved
from millrace.schemas import MANIFEST
from millrace.sources import state

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def test_manifest(spark):
    old = spark.createDataFrame([("a", T0), ("b", T0), ("c", T0), ("d", None)], "path string, mtime timestamp")
    scan = spark.createDataFrame([("a", T0), ("b", T1), ("e", T0), ("d", T0)], "path string, mtime timestamp")
    assert {r["path"]: r["status"] for r in manifest.classify(scan, old).collect()} == {"a": "unchanged", "b": "modified", "e": "new", "d": "modified"}
    gone = manifest.deleted(old, scan)
    assert [r["path"] for r in gone.collect()] == ["c"]
    done = manifest.upsert(old, manifest.to_index(scan, old).drop("status"), gone)
    assert {r["path"]: r["mtime"] for r in done.collect()} == {"a": T0, "b": T1, "d": T0, "e": T0}
    assert manifest.to_index(scan, done).count() == 0  # a second run has nothing to do
    assert list(manifest.stats(spark.createDataFrame([], MANIFEST)).first()) == [0, 0, 0, None, None]


def test_upsert_vectors(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 2), ("b", 3), ("c", 2), ("c", 2)], "chunk_id string, v int")
    assert {tuple(r) for r in manifest.upsert_vectors(old, new, newest="v").collect()} == {("a", 1), ("b", 3), ("c", 2)}
    assert manifest.upsert_vectors(old, new).count() == 3


def test_json_round_trips(spark):
    rows = [("p/a.md", T0, 5, T1, 2, 0, "a.md"), ("p/b.md", T1, None, None, 0, 0, "b.md")]
    m = spark.createDataFrame(rows, MANIFEST)
    assert sorted(map(tuple, state.manifest_from_json(state.manifest_to_json(m)).collect())) == rows
    f = frontier.settle(frontier.claim(frontier.seed(spark.createDataFrame([("u",), ("v",)], "url string"), T0), T1), spark.createDataFrame([("u", None), ("v", "timeout")], "url string, error string"), T1)
    again = state.frontier_from_json(state.frontier_to_json(f))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, f.collect()))
    whole = spark.createDataFrame([('{"u": {"status": "pending", "retry_count": 1}, "v": {"status": "error"}}',), ("broken{",)], "value string")
    assert {(r["url"], r["status"], r["retry_count"]) for r in state.frontier_from_json(whole).collect()} == {("u", "pending", 1), ("v", "error", None)}


def test_tables_are_replaced_even_by_themselves(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert state.read_or_empty(spark, path, MANIFEST).count() == 0
    state.replace_table(spark.range(3), path)
    state.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_crawl(spark, tmp_path):
    base = "http://h"
    site = {"/": ["/a", "b", "#x", "http://other/"], "/a": ["/", "/c?q=1"], "/b": ["/missing", "/a#frag"], "/c?q=1": []}
    pages = spark.createDataFrame([(base + k, v) for k, v in site.items()], "url string, links array<string>")
    seen = []

    def save(df, wave):
        seen.append(wave)
        df.write.parquet(f"{tmp_path}/w{wave}")
        return spark.read.parquet(f"{tmp_path}/w{wave}")

    got = frontier.crawl(spark.createDataFrame([(base + "/",)], "url string"), pages, F.col("links"), base, T0, save)
    assert {r["url"]: r["status"] for r in got.collect()} == {base + p: "completed" for p in site} | {base + "/missing": "error"}
    assert seen == [0, 1, 2, 3]
    assert list(frontier.status_counts(got).first()) == [0, 0, 4, 1, 5]
    assert list(frontier.success_rate(got).first()) == [4, 5, 80.0]
    assert frontier.claim(got, T1, max_retries=1).where("status = 'in_progress'").count() == 1
    assert list(frontier.success_rate(got.limit(0)).first()) == [0, 0, 0.0]


def test_crawl_says_what_it_leaves(spark, tmp_path):
    pages = spark.createDataFrame([(f"http://h/{i}", [f"/{i + 1}"]) for i in range(4)], "url string, links array<string>")

    def save(df, wave):
        df.write.mode("overwrite").parquet(f"{tmp_path}/w{wave}")
        return spark.read.parquet(f"{tmp_path}/w{wave}")

    start = spark.createDataFrame([("http://h/0",)], "url string")
    with pytest.warns(UserWarning, match="1 URLs pending"):
        got = frontier.crawl(start, pages, F.col("links"), "http://h", T0, save, 2)
    assert got.where("status = 'pending'").count() == 1
    assert inspect.signature(frontier.crawl).parameters["max_waves"].default is None


def test_urls(spark):
    cases = {
        "http://h/a/b.html": "a/b.md", "http://h/a/b": "a/b/index.md", "http://h/a/": "a/index.md", "http://h": "index.md", "http://h/": "index.md", "http://h/x.y/z?q=a.b": "x.y/z/index.md",
        "http://h/a.tar.gz#f": "a.tar.md", "http://h/.well": ".well/index.md",
    }
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert {r["url"]: r["p"] for r in df.select("url", urls.to_path(F.col("url")).alias("p")).collect()} == cases
    hrefs = spark.createDataFrame([("http://h/a/b", "../c"), ("http://h/a/b", "//g/x"), ("http://h", "http://[bad"), ("http://h", None)], "p string, h string")
    assert [r[0] for r in hrefs.select(urls.resolve("p", "h")).collect()] == ["http://h/c", "http://g/x", None, None]
    assert list(df.limit(1).select(urls.origin(F.lit("https://u:8/x")), urls.host(F.lit("https://u:8/x"))).first()) == ["https://u:8", "u"]


def test_challenges(spark):
    df = spark.createDataFrame([("we are CHECKING your browser. Ray ID: 1",), ("x CF-Turnstile x",), ("plain",), (None,)], "h string")
    assert [r[0] for r in df.select(frontier.challenge(F.col("h"))).collect()] == ["loading", "captcha", "", ""]


def test_integrity(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "chunk_id string")
    m = spark.createDataFrame([("a", "x"), ("b", " \n"), ("d", "y")], "chunk_id string, chunk_content string")
    r = integrity.report(v, m).first().asDict()
    assert r == {
        "total_vectors": 3, "total_metadata": 3, "valid_mappings": 1, "missing_metadata_count": 1, "orphan_metadata_count": 1, "empty_contents_count": 1,
        "missing_metadata_sample": ["c"], "orphan_metadata_sample": ["d"], "empty_content_sample": ["b"], "is_healthy": False,
    }
    assert integrity.report(v.where("chunk_id = 'a'"), m.where("chunk_id = 'a'")).first()["is_healthy"] is True
    assert integrity.report(v.limit(0), m.limit(0)).first()["is_healthy"] is True


def test_export(spark, tmp_path):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("chunk_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"))
    want = {k: i for i, k in enumerate(sorted(r["chunk_id"] for r in df.collect()))}
    for per_range in (100, 10**6):
        assert {r["chunk_id"]: r["ordinal"] for r in export.with_ordinals(df, per_range=per_range).collect()} == want
    export.write(df, str(tmp_path), "m", "2024", per_range=100)
    about = spark.read.json(f"{tmp_path}/manifest").first().asDict()
    assert (about["total_vectors"], about["vector_dimension"], about["completion_timestamp"]) == (1000, 2, "2024")
    vectors, row = export.load(spark, str(tmp_path))
    assert row["embedding_model"] == "m" and {r["chunk_id"]: r["vec_id"] for r in vectors.collect()} == want
    vectors.limit(5).write.mode("overwrite").parquet(f"{tmp_path}/less")
    os.rename(f"{tmp_path}/vectors", f"{tmp_path}/all")
    os.rename(f"{tmp_path}/less", f"{tmp_path}/vectors")
    with pytest.raises(ValueError, match="total_vectors is 5, the manifest says 1000"):
        export.load(spark, str(tmp_path))
    maps = spark.createDataFrame([({"ordered_ids": "1", "_x": "2", "k": "3"},)], "metadata map<string,string>")
    assert maps.select(export.content_metadata()).first()[0] == {"k": "3"}


def test_ordinals_of_many_ranges_survive_a_write(spark, tmp_path):
    """More rows in a range than the sampling that places its bounds looks at; keys repeat."""
    n = 600_000
    df = spark.range(n).select(F.md5((F.col("id") % (n - 100)).cast("string")).alias("chunk_id"), "id").repartition(7)
    export.with_ordinals(df, per_range=20_000).write.parquet(f"{tmp_path}/o")
    got = spark.read.parquet(f"{tmp_path}/o")
    assert list(got.agg(F.count("*"), F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal"), F.count_distinct("id")).first()) == [n, n, 0, n - 1, n]
    pairs = got.select("ordinal", "chunk_id").join(got.select((F.col("ordinal") - 1).alias("ordinal"), F.col("chunk_id").alias("after")), "ordinal")
    assert pairs.where("after < chunk_id").count() == 0 and pairs.count() == n - 1


def test_a_crawl_goes_on(spark, tmp_path):
    pages = spark.createDataFrame([(f"http://h/{i}", [f"/{i + 1}"]) for i in range(4)], "url string, links array<string>")

    def save(df, wave, name="a"):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}{wave}")
        return spark.read.parquet(f"{tmp_path}/{name}{wave}")

    start = spark.createDataFrame([("http://h/0",)], "url string")
    with pytest.warns(UserWarning, match="1 URLs pending"):
        half = frontier.crawl(start, pages, F.col("links"), "http://h", T0, save, 2)
    done = frontier.crawl(start, pages, F.col("links"), "http://h", T1, lambda d, w: save(d, w, "b"), known=half)
    state_ = {r["url"]: (r["status"], r["started_at"]) for r in done.collect()}
    assert state_["http://h/0"] == ("completed", T0) and state_["http://h/3"] == ("completed", T1)
    assert state_["http://h/4"][0] == "error"
    tried = frontier.crawl(start, pages, F.col("links"), "http://h", T1, lambda d, w: save(d, w, "c"), max_retries=2)
    assert {r["url"]: r["retry_count"] for r in tried.where("status = 'error'").collect()} == {"http://h/4": 3}


def test_saved_pages(spark, tmp_path):
    rows = [("http://h/a", T0, "old"), ("http://h/a?x=1", T1, "new"), ("http://h/a?x=0", T1, "same time"), ("http://h/b/c.html", None, None), ("http://h/e", T0, "é"), (None, T0, "x")]
    kept = saved.saved(spark.createDataFrame(rows, "url string, fetched_at timestamp, markdown string"))
    assert {r["path"]: (r["markdown"], r["replaced"]) for r in kept.collect()} == {"a/index.md": ("new", 2), "b/c.md": ("", 0), "e/index.md": ("é", 0)}
    for _ in range(2):
        assert {r["path"]: r["bytes"] for r in saved.write_files(kept, str(tmp_path / "out")).collect()} == {"a/index.md": 3, "b/c.md": 0, "e/index.md": 2}
    assert (tmp_path / "out/e/index.md").read_text() == "é" and not list(tmp_path.rglob("*.part"))
    with pytest.raises(Exception, match="steps up"):
        saved.write_files(spark.createDataFrame([("../x.md", "x")], "path string, markdown string"), str(tmp_path)).collect()


def test_buckets(spark, tmp_path):
    path, schema = f"{tmp_path}/t", spark.createDataFrame([], "k string, v int").schema
    rows = lambda v, keys: spark.createDataFrame([(k, v) for k in keys], schema).withColumn("bucket", state.bucket(F.col("k"), 4))
    read = lambda: sorted((r["k"], r["v"]) for r in state.read_buckets(spark, path, schema).collect())
    state.replace_buckets(rows(0, "abcdefgh"), path)
    at = {r["k"]: r["bucket"] for r in rows(0, "abcdefgh").collect()}
    one = at["a"]
    kept = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path) if n.startswith("bucket=") and n != f"bucket={one}"}
    mine = [k for k in "abcdefgh" if at[k] == one]
    state.replace_buckets(rows(1, mine), path, [one])
    assert read() == sorted((k, int(k in mine)) for k in "abcdefgh")
    assert kept == {n: os.stat(f"{path}/{n}").st_mtime_ns for n in kept}
    state.replace_buckets(rows(1, ""), path, [one])
    assert read() == [(k, 0) for k in "abcdefgh" if k not in mine]
    # a run that was stopped between writing and moving
    rows(2, mine).write.partitionBy("bucket").parquet(path + ".new")
    state.settle_buckets(spark, path)
    assert [x for x in read() if x[1] == 2] == [(k, 2) for k in mine] and not os.path.exists(path + ".new")


def test_what_an_export_says():
    made = Index("me/x", 1234, 4, "m", files={"embeddings": "e"})
    assert "Vectors: 1,234" in described(made) and "Completed: unknown" in described(made)
    assert download_instructions(made)["repo_url"].endswith("/datasets/me/x")


def test_errors_and_history(spark):
    df = spark.createDataFrame([("p1", "m"), ("p1", "n"), ("p2", "m")], "path string, m string")
    e = errors.rows(df, "parsing_error", "path", F.col("m"))
    assert [tuple(r) for r in errors.counts(e).collect()] == [("parsing_error", "Parsing Error", 3, 2)]
    assert errors.examples(e, 2).count() == 2
    msgs = spark.createDataFrame([(1, 0, "system", "s", None), (1, 1, "user", "q", None), (1, 2, "assistant", "thinking", {"title": "t"}), (1, 3, "assistant", "a", {}), (1, 4, None, "x", None)], "conv_id int, turn int, role string, text string, metadata map<string,string>")
    n = history.normal(msgs)
    assert [r["content"] for r in n.where(history.for_batch()).orderBy("turn").collect()] == ["q", "a"]
    assert [r["content"] for r in n.where(history.for_stream()).orderBy("turn").collect()] == ["s", "q", "a"]
    assert history.transcript(n.where(history.for_batch())).first()["transcript"] == "user: q\nassistant: a"


def test_settings():
    made = Index("me/x", 3, 4, "m", completion_timestamp="t")
    assert Index.from_json(made.to_json()) == made
    for bad in ("{}", '{"step03_completed": true}'):
        try:
            Index.from_json(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
