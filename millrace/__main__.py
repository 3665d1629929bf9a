"""python -m millrace: index a folder, ask it, look at it, export it, or crawl a snapshot of pages."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession

from millrace import api, config, errors
from millrace.operators import export, frontier, html_sections, integrity, manifest
from millrace.sources import state


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("millrace")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="bring an index up to date with a folder")
    index.add_argument("folder")
    index.add_argument("index")
    index.add_argument("--full", action="store_true", help="read every file anew")
    ask = sub.add_parser("ask", help="answer a question")
    ask.add_argument("index")
    ask.add_argument("question")
    ask.add_argument("--documents", type=int, default=3)
    ask.add_argument("--no-reranking", action="store_true")
    ask.add_argument("--exported", action="store_true", help="index is a folder that export has written")
    status = sub.add_parser("status", help="what an index holds, and whether it is sound")
    status.add_argument("index")
    out = sub.add_parser("export", help="write vectors in order, with a manifest")
    out.add_argument("index")
    out.add_argument("path")
    out.add_argument("--dry-run", action="store_true")
    crawl = sub.add_parser("crawl", help="walk a Parquet snapshot of pages (url, html)")
    crawl.add_argument("pages")
    crawl.add_argument("start")
    crawl.add_argument("out")
    crawl.add_argument("--base")
    crawl.add_argument("--waves", type=int, default=None)
    crawl.add_argument("--retries", type=int, default=0)
    crawl.add_argument("--resume", action="store_true", help="go on from the last wave in out")
    return p


def run(spark: SparkSession, argv: list[str]) -> None:
    a = _parser().parse_args(argv)
    if a.command == "index":
        done, wrong = api.index_folder(spark, a.folder, a.index, incremental=not a.full)
        manifest.stats(done).show(truncate=False)
        errors.counts(wrong).show(truncate=False)
        return
    if a.command == "crawl":
        pages = spark.read.parquet(a.pages).select("url", html_sections.links_of("html").alias("links"))
        base = a.base or "/".join(a.start.split("/")[:3])
        done = [int(n[5:]) for n in state.children(spark, a.out) if n.startswith("wave=") and "_SUCCESS" in state.children(spark, f"{a.out}/{n}")]
        first = max(done) + 1 if a.resume and done else 0
        known = spark.read.parquet(f"{a.out}/wave={first - 1}") if first else None

        def save(df, wave):
            path = f"{a.out}/wave={first + wave}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        start = spark.createDataFrame([(a.start,)], "url string")
        found = frontier.crawl(start, pages, pages["links"], base, dt.datetime.now(), save, a.waves, a.retries, known)
        frontier.status_counts(found).show(truncate=False)
        return
    lacking = config.missing_parts(set(state.children(spark, a.index)))
    if lacking:
        raise SystemExit(f"{a.index} has no {' and no '.join(lacking)}")
    vectors = export.load(spark, a.index)[0] if a.command == "ask" and a.exported else api.vectors_of(spark, a.index)
    if a.command == "ask":
        print(api.ask_rag_question(spark, vectors, a.question, a.documents, not a.no_reranking))
    elif a.command == "status":
        export.stats(vectors).show(truncate=False)
        integrity.report(vectors, vectors).show(truncate=False)
    else:
        export.summary(vectors, "hashing").show(truncate=False)
        if not a.dry_run:
            export.write(vectors.drop("vec_id"), a.path, "hashing", dt.datetime.now().isoformat())


def main() -> None:
    spark = SparkSession.builder.appName("millrace").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        run(spark, sys.argv[1:])
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
