"""The crawl frontier: links of a wave of pages, what is new among them, and the state of every URL."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import each
from millrace.functions.urls import in_scope, resolve_all
from millrace.schemas import FRONTIER

PENDING, IN_PROGRESS, COMPLETED, ERROR = STATUSES = ("pending", "in_progress", "completed", "error")

# Phrases of pages that only check the visitor.
LOADING = ["We are checking your browser", "Enable JavaScript and cookies", "Vérification réussie", "Checking if the site connection is secure", "This process is automatic"]
CAPTCHA = ["cf-challenge-form", "cf-turnstile", "Please complete the security check", "DDoS protection by Cloudflare", "cf-browser-verification", "cf-challenge", "Ray ID:"]


def challenge(html: Column) -> Column:
    """``loading``, ``captcha`` or the empty text, by the first list that has a phrase of the page."""
    low = F.lower(F.coalesce(html, F.lit("")))
    has = lambda phrases: F.greatest(*[F.contains(low, F.lit(p.lower())) for p in phrases])
    return F.when(has(LOADING), "loading").when(has(CAPTCHA), "captcha").otherwise("")


def discover(pages: DataFrame, links: Column, base: Column | str, resolved: bool = False) -> DataFrame:
    """Distinct URLs below ``base`` that ``pages`` (url) link to; ``resolved`` says that the links are whole URLs.

    A page's links are resolved together and before they are rows, so that no
    filter on them has Python do its work a second time.
    """
    base = F.lit(base) if isinstance(base, str) else base
    rows = each(pages.withColumn("__base", base), links if resolved else resolve_all(F.col("url"), links), "__pos", "found", "url", "__base").withColumnRenamed("__base", "base")
    return rows.where(in_scope(F.col("found"), F.col("base"), F.col("url"))).select(F.col("found").alias("url")).distinct()


def seed(urls: DataFrame, now) -> DataFrame:
    """New frontier rows of ``urls`` (url)."""
    rows = urls.select("url").distinct()
    at = F.lit(now).cast("timestamp")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in FRONTIER}
    return rows.select(*[c.alias(n) for n, c in (empty | {"url": F.col("url"), "status": F.lit(PENDING), "discovered_at": at, "retry_count": F.lit(0)}).items()])


def add(frontier: DataFrame, urls: DataFrame, now) -> DataFrame:
    """``frontier`` and the URLs that it doesn't know, as pending."""
    return frontier.unionByName(seed(urls.join(frontier, "url", "left_anti"), now))


def ready(max_retries: int = 0) -> Column:
    """Whether a URL can be fetched: it is pending, an interrupted run left it in progress, or it is in error with retries left."""
    again = (F.col("status") == ERROR) & (F.coalesce("retry_count", F.lit(0)) <= max_retries) & F.lit(max_retries > 0)
    return F.col("status").isin(PENDING, IN_PROGRESS) | again


def claim(frontier: DataFrame, now, max_retries: int = 0) -> DataFrame:
    """``frontier`` with all that is :func:`ready` in progress."""
    ready_ = ready(max_retries)
    return frontier.withColumns({"status": F.when(ready_, IN_PROGRESS).otherwise(F.col("status")), "started_at": F.when(ready_, F.lit(now).cast("timestamp")).otherwise(F.col("started_at"))})


def settle(frontier: DataFrame, fetched: DataFrame, now) -> DataFrame:
    """``frontier`` after a wave: what is in ``fetched`` (url, error) is complete or in error, all else stays."""
    got = fetched.groupBy("url").agg(F.min("error").alias("__error")).withColumn("__got", F.lit(True))
    both = frontier.join(got, "url", "left")
    mine, failed = F.col("__got") & (F.col("status") == IN_PROGRESS), F.col("__error").isNotNull()
    out = both.withColumns({
        "completed_at": F.when(mine & ~failed, F.lit(now).cast("timestamp")).otherwise(F.col("completed_at")),
        "error_message": F.when(mine & failed, F.col("__error")).otherwise(F.col("error_message")),
        "retry_count": F.when(mine & failed, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
        "status": F.when(mine & failed, ERROR).when(mine, COMPLETED).otherwise(F.col("status")),
    })
    return out.select(*frontier.columns)


def crawl(start: DataFrame, pages: DataFrame, links: Column, base: str, now, save: Callable[[DataFrame, int], DataFrame], max_waves: int | None = None, max_retries: int = 0, known: DataFrame | None = None) -> DataFrame:
    """Breadth-first over a snapshot of ``pages`` (url, html): wave after wave, until nothing is :func:`ready`.

    ``save`` writes the frontier of a wave and reads it back, which cuts its
    lineage.  URLs that the snapshot doesn't have end in error, after
    ``max_retries`` more tries.  ``known`` is the frontier of an earlier run, which
    this one takes up: what is complete stays, what was left is fetched.  Where
    ``max_waves`` ends it early, a warning says how many URLs are pending.
    """
    frontier = save(seed(start, now) if known is None else add(known, start, now), 0)
    for wave in itertools.count(1):
        if frontier.where(ready(max_retries)).isEmpty():
            break
        if max_waves is not None and wave > max_waves:
            left = frontier.where(ready(max_retries)).count()
            warnings.warn(f"crawl ended after {max_waves} waves with {left} URLs pending", stacklevel=2)
            break
        claimed = claim(frontier, now, max_retries)
        mine = claimed.where(F.col("status") == IN_PROGRESS).select("url")
        here = pages.join(mine, "url", "left_semi")
        fetched = mine.join(pages.select("url").distinct().withColumn("__has", F.lit(True)), "url", "left")
        fetched = fetched.select("url", F.when(F.col("__has").isNull(), "not in the snapshot").alias("error"))
        frontier = save(add(settle(claimed, fetched, now), discover(here, links, base), now), wave)
    return frontier


def status_counts(frontier: DataFrame) -> DataFrame:
    """One row: count of each status, zeros included, and of all."""
    return frontier.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def success_rate(frontier: DataFrame) -> DataFrame:
    """One row: percent of URLs that are complete, one decimal."""
    done, total = F.count_if(F.col("status") == COMPLETED), F.count("*")
    return frontier.agg(done.alias("completed"), total.alias("total"), F.round(done * 100.0 / F.greatest(total, F.lit(1)), 1).alias("success_rate"))
