"""A folder indexed, changed, indexed again, and asked."""

import os

import pytest
from pyspark.sql import functions as F

from millrace import api
from millrace.operators import integrity, retrieval
from millrace.providers import HashingEmbedder, embed, first_available
from millrace.sources import files
from millrace.streaming.answers import chat

WORDS = "the concrete mixture needs water and cement in the right amounts before it is poured into the form "


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / "sub" / "img").mkdir(parents=True)
    (d / "a.md").write_text(f"# Guide\n{WORDS}\n## Pumps\nA pump moves liquids such as oil through pipes ![p](pump.png) and [more](/x).\n")
    (d / "sub" / "b.html").write_text(f"<title>Page</title><h1>Cables</h1><p>Copper cables carry current; {WORDS}<img src='img/c.png' alt='c.png'></p>")
    (d / "sub" / "img" / "c.png").write_bytes(b"png")
    (d / "pump.png").write_bytes(b"png")
    (d / "x.pdf").write_bytes(b"%PDF")
    (d / "note.TXT").write_text("ignored")
    return d


def test_scan(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r["ext"] for r in files.scan(spark, str(folder)).select("path", "ext").collect()}
    assert got == {"a.md": ".md", "b.html": ".html", "x.pdf": ".pdf"}
    assert files.scan(spark, str(folder), files.HTML).count() == 1
    assert files.scan(spark, str(folder), max_bytes=4).select("path").count() == 1
    assert list(files.format_counts(files.scan(spark, str(folder))).first()) == [1, 1, 1, 0, 3]


def test_index_and_ask(spark, folder, tmp_path):
    index = f"{tmp_path}/index"
    pdf = f"file:{folder}/x.pdf"
    pages = spark.createDataFrame([(pdf, 0, "Turbines turn. " * 30), (pdf, 1, "Blades spin. " * 30)], "path string, page int, text string")
    done, errors = api.index_folder(spark, str(folder), index, page_texts=pages)
    first = sorted(map(tuple, done.collect()))
    assert len(first) == 3 and errors.count() == 0
    vectors = api.vectors_of(spark, index)
    assert vectors.count() == 4 and integrity.report(vectors, vectors).first()["is_healthy"]
    pump = vectors.where("heading = 'Pumps'").first()
    assert pump["num_images"] == 1 and pump["num_links"] == 2

    same, _ = api.index_folder(spark, str(folder), index, page_texts=pages)
    assert sorted(map(tuple, same.collect())) == first

    (folder / "a.md").write_text(f"# Guide\n{WORDS} and much more than before\n")
    at = (folder / "sub" / "b.html").stat().st_mtime + 100
    os.utime(folder / "a.md", (at, at))
    (folder / "sub" / "b.html").unlink()
    after, _ = api.index_folder(spark, str(folder), index, page_texts=pages)
    assert after.count() == 2
    assert {r["heading"] for r in api.vectors_of(spark, index).collect()} == {"Guide", "Page 1"}

    api.index_file(spark, f"{folder}/a.md", index)
    vectors = api.vectors_of(spark, index)
    assert vectors.count() == 2

    said = api.ask_rag_question(spark, vectors, "How much water does concrete need?", 99)
    assert said.startswith("Guide") and "**[1]**" in said and "Reranking" in said
    plain = api.ask_rag_question(spark, vectors, "How much water does concrete need?", 1, use_reranking=False)
    assert "Score: " in plain and "Reranking" not in plain
    assert api.ask_rag_question(spark, vectors.limit(0), "anything") == retrieval.NOTHING_FOUND
    grown = list(chat(spark, vectors, "water", [{"role": "user", "content": "hi", "metadata": None}]))
    assert len(grown) > 3 and grown[-1][-1]["metadata"] == {"title": "sources"} and grown[0][0]["content"] == "hi"


def test_a_changed_file_costs_its_bucket(spark, tmp_path):
    """Paths over the length that is shown, equal in what is shown; one file changes, and only its bucket is written."""
    docs, index = tmp_path / "docs", f"{tmp_path}/index"
    tail = "/".join(["p" * 200, "q" * 200, "same.md"])
    for top in ("one", "two", "three"):
        (docs / top / tail).parent.mkdir(parents=True)
        (docs / top / tail).write_text(f"# {top}\n{WORDS} {top}\n")
    api.index_folder(spark, str(docs), index)
    shown = lambda: sorted((r["heading"], len(r["source_file"]), "more" in r["chunk_content"]) for r in api.vectors_of(spark, index).collect())
    assert [x[0] for x in shown()] == ["one", "three", "two"] and {x[1] for x in shown()} == {400}
    files_ = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "index" / "vectors").rglob("*.parquet")}
    before = files_()
    (docs / "two" / tail).write_text(f"# two\n{WORDS} and more\n")
    os.utime(docs / "two" / tail, (2e9, 2e9))
    api.index_folder(spark, str(docs), index)
    assert [x for x in shown() if x[2]] == [("two", 400, True)] and len(shown()) == 3
    assert len(set(before.items()) & set(files_().items())) == 2
    (docs / "one" / tail).write_text(f"# one\n{WORDS} has more\n")
    api.index_file(spark, str(docs / "one" / tail), index)
    assert [x[0] for x in shown() if x[2]] == ["one", "two"] and len(shown()) == 3


def test_pdf_without_text_is_an_error(spark, folder):
    _, errors = files.read_chunks(files.scan(spark, str(folder)))
    assert [r["error_type"] for r in errors.collect()] == ["parsing_error"]


def test_clamp():
    assert [retrieval.clamp_k(k) for k in (0, 1, "4", 99)] == [1, 1, 4, 10]
    assert retrieval.candidate_count(3) == 20 and retrieval.candidate_count(10) == 30


def test_rerankers(spark):
    hits = spark.createDataFrame([(1, 1, "a b", "s", "t", "h", 0.9, 0.1, 1), (1, 2, "c d", "s", "t", "h", 0.8, 0.2, 2), (1, 3, "c", "s", "t", "h", 0.7, 0.3, 3)], "query_id long, vec_id long, content string, source string, title string, heading string, embedding_score double, embedding_distance double, initial_rank int")
    q = spark.createDataFrame([(1, "c d")], "query_id long, question string")
    order = lambda df: [r["vec_id"] for r in df.orderBy("final_rank").collect()]
    assert order(retrieval.rerank(hits, q, api.LexicalReranker(), 2)) == [2, 3]
    neutral = retrieval.rerank(hits, q, api.LexicalReranker(), 3, available=False)
    assert order(neutral) == [1, 2, 3] and {r["rerank_score"] for r in neutral.collect()} == {0.5}
    none = retrieval.rerank(hits, q, None, 2)
    assert order(none) == [1, 2] and {r["reranked"] for r in none.collect()} == {False}


def test_first_available_embedder():
    def absent():
        raise ImportError("no such model")

    assert first_available(absent, HashingEmbedder).dimension == 64
    with pytest.raises(RuntimeError, match="no such model"):
        first_available(absent)
    assert HashingEmbedder(8).encode(["a b a", "", None]).sum(axis=1).tolist() == [3, 0, 0]


def test_wrong_vectors_are_an_error(spark):
    class Wrong(HashingEmbedder):
        def encode(self, texts, is_query=False):
            return super().encode(texts)[:, :3]

    with pytest.raises(Exception, match="the embedder gave"):
        spark.createDataFrame([("a",)], "t string").select(embed(Wrong(), F.col("t"))).collect()


def test_tables_of_images(spark, folder):
    (folder / "t.html").write_text("<body><table><tr><td>cell<img src='pump.png' alt='A pump'><img src='gone.png'></td></tr></table></body>")
    scan = files.scan(spark, str(folder), files.HTML)
    pictures = files.scan(spark, str(folder), files.IMAGES).select("path")
    chunks, _ = files.read_chunks(scan, image_files=pictures)
    got = chunks.where("heading = 'Contenu multimédia'").first()
    assert got["content"].endswith("\n\ncell\n[Image: A pump]\n[Image: Image non trouvée: gone.png]")
    assert [i["found"] for i in got["images"]] == [True, False] and got["links"] == []
    plain, _ = files.read_chunks(scan)
    assert plain.where("heading = 'Contenu multimédia'").first()["content"].endswith("\n\ncell")


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.md").write_text("x")
    assert files.scan(spark, str(tmp_path)).rdd.getNumPartitions() < 12


def test_errors_outlast_the_files(spark, folder, tmp_path):
    _, errors = api.index_folder(spark, str(folder), f"{tmp_path}/index")
    (folder / "x.pdf").unlink()
    assert [r["file_path"].rpartition("/")[2] for r in errors.collect()] == ["x.pdf"]
