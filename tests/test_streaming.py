import datetime as dt

from pyspark.sql import functions as F

from millrace.__main__ import run
from millrace.operators import metadata
from millrace.providers import HashingEmbedder, embed
from millrace.sources import state
from millrace.streaming import answers, pages


def corpus(spark):
    rows = spark.createDataFrame([("a", "s", "Water", "h", "water and cement make concrete"), ("b", "s", "Cable", "h", "copper cables carry current")], "chunk_id string, source_file string, title string, heading string, content string")
    cols = metadata.projected(rows)
    return rows.select(F.xxhash64("chunk_id").alias("vec_id"), embed(HashingEmbedder(), F.col("content")).alias("embedding"), *[c.alias(n) for n, c in cols.items()])


def test_questions_as_they_arrive(spark, tmp_path):
    feed, out = f"{tmp_path}/feed", f"{tmp_path}/out"
    schema = "query_id long, question string"
    for n, q in enumerate(["copper cables", "cement"]):
        spark.createDataFrame([(n, q)], schema).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(schema).parquet(feed)
        answers.answer_stream(stream, corpus(spark), out, f"{tmp_path}/check", availableNow=True).awaitTermination(120)
        assert spark.read.parquet(out).count() == n + 1  # the first question isn't answered again
    got = {r["query_id"]: r["answer"] for r in spark.read.parquet(out).collect()}
    assert got == {0: "copper cables carry current", 1: "water and cement make concrete"}


def test_pages_as_they_arrive(spark, tmp_path):
    feed, known = f"{tmp_path}/feed", f"{tmp_path}/known"
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("http://h/a", ["/b", "/a", "#x"], at, None), ("http://h/c", ["/b", "/d"], at + dt.timedelta(minutes=1), "timeout")]
    spark.createDataFrame(rows, "url string, links array<string>, completed_at timestamp, error string").write.parquet(feed)
    spark.createDataFrame([("http://h/d",)], "url string").write.parquet(known)
    stream = lambda: spark.readStream.schema(spark.read.parquet(feed).schema).parquet(feed)
    pages.discover_stream(stream(), F.col("links"), "http://h", known, f"{tmp_path}/c1", availableNow=True).awaitTermination(120)
    assert sorted(r[0] for r in spark.read.parquet(known).collect()) == ["http://h/b", "http://h/d"]

    q = pages.per_host(stream()).writeStream.format("memory").queryName("per_host").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["host"], r["n"], r["failed"]) for r in spark.table("per_host").collect()] == [("h", 2, 1)]

    twice = stream().select("url", "completed_at").union(stream().select("url", "completed_at"))
    q = pages.first_seen(twice, "completed_at").writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("first_seen").count() == 2


def test_command_line(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# Guide\nthe concrete mixture needs water and cement in the right amounts before it is poured\n")
    index = f"{tmp_path}/indexes/one"
    run(spark, ["index", str(docs), index])
    run(spark, ["ask", index, "water and cement?", "--documents", "1"])
    assert "Guide" in capsys.readouterr().out
    run(spark, ["status", index])
    run(spark, ["export", index, f"{tmp_path}/export"])
    assert spark.read.parquet(f"{tmp_path}/export/vectors").count() == 1
    assert state.find_indexes(spark, f"{tmp_path}/indexes") == [index]
    try:
        run(spark, ["ask", f"{tmp_path}/none", "x"])
    except SystemExit as e:
        assert "no vectors" in str(e)
    spark.createDataFrame([("http://h/", '<a href="/x">x</a>'), ("http://h/x", "")], "url string, html string").write.parquet(f"{tmp_path}/pages")
    run(spark, ["crawl", f"{tmp_path}/pages", "http://h/", f"{tmp_path}/crawl"])
    assert spark.read.parquet(f"{tmp_path}/crawl/wave=2").where("status = 'completed'").count() == 2
