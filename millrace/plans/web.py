"""Queries on pages: HTML, URLs and the crawl frontier."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import each
from millrace.operators import frontier, html_sections, main_content
from millrace.plans.fixtures import STRIP, table
from millrace.sources import html, state

NOW = dt.datetime(2024, 1, 1)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", html_sections.title_of("html").alias("title"))


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(_pages(spark, sf_dir), html_sections.links_of("html"), "pos", "href", "page_id")


def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of every page by tag."""
    return html.nodes(_pages(spark, sf_dir)).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def html_sections_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_sections.sections(_pages(spark, sf_dir)).select("source_file", "section_index", "chunk_id", "title", "heading", "content", F.array_join("links", " ").alias("links"), "error")


def html_main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", main_content.extract(F.col("html")).alias("main"))


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every page is kept, and its main content as Markdown."""
    rows = _pages(spark, sf_dir).select("page_id", urls.to_path(F.col("url")).alias("path"), main_content.extract(F.col("html")).alias("main"))
    return rows.select("page_id", "path", main_content.as_markdown("main").alias("markdown"))


def url_to_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", urls.to_path(F.col("url")).alias("path"))


def url_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages lie in the crawl that starts at the first secure origin."""
    pages = _pages(spark, sf_dir)
    start = pages.where(F.startswith("url", F.lit("https://"))).agg(F.min(urls.origin(F.col("url"))).alias("base"))
    return pages.select("page_id", urls.origin(F.col("url")).alias("origin"), F.coalesce(urls.in_scope(F.col("url"), start.scalar()), F.lit(False)).alias("in_scope"))


def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def _found(pages: DataFrame) -> DataFrame:
    """Links of all pages on their own hosts; parsed and resolved in one step of Python."""
    rows = pages.select("url", html_sections.targets_of("url", "html").alias("links"))
    return frontier.discover(rows, F.col("links"), urls.origin(F.col("url")), resolved=True)


def frontier_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first wave over all pages adds: links on the page's own host that aren't pages yet."""
    pages = _pages(spark, sf_dir)
    known = frontier.seed(pages.select("url"), NOW)
    found = _found(pages)
    return frontier.add(known, found, NOW).where("status = 'pending'").join(pages.select("url"), "url", "left_anti").select("url", "status", "retry_count")


def _after_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier after one wave over all pages, of which those with a query fail."""
    pages = _pages(spark, sf_dir)
    found = _found(pages)
    begun = frontier.claim(frontier.seed(pages.select("url"), NOW), NOW)
    fetched = pages.select("url", F.when(F.contains("url", F.lit("?")), "timeout").alias("error"))
    return frontier.add(frontier.settle(begun, fetched, NOW), found, NOW)


def frontier_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.status_counts(_after_wave(spark, sf_dir))


def crawl_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.success_rate(_after_wave(spark, sf_dir))


def frontier_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frontier of all pages written as JSON and read again."""
    rows = frontier.claim(frontier.seed(_pages(spark, sf_dir).select("url"), NOW), NOW)
    again = state.frontier_from_json(state.frontier_to_json(rows))
    return again.select("url", "status", F.unix_timestamp("discovered_at").alias("discovered"), F.col("completed_at").isNull().alias("open"), "retry_count")


def challenge_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a phrase of a visitor check on some, in any case of letters."""
    more = F.when(F.col("page_id") % 11 == 0, "CHECKING if the Site connection is SECURE").when(F.col("page_id") % 7 == 0, "ray id: 1").otherwise("")
    return _pages(spark, sf_dir).select("page_id", frontier.challenge(F.concat("html", more)).alias("challenge"))


_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_PATH = "ltrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/')"
_TO_PATH = f"""CASE WHEN regexp_matches(regexp_extract({_PATH}, '[^/]*$'), '[^.]\\.[^.]*$') THEN concat(regexp_replace({_PATH}, '\\.[^./]*$', ''), '.md')
    WHEN {_PATH} = '' OR ends_with({_PATH}, '/') THEN concat({_PATH}, 'index.md') ELSE concat({_PATH}, '/index.md') END"""
_STRIP = STRIP.format
_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
_DECODED = "regexp_replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;?', '&', 'g')"
_HREFS = f"h AS (SELECT page_id, url, {_ORIGIN} AS origin, regexp_extract_all(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '<a [^>]*?href=\"([^\"]*)\"', 1) AS hrefs FROM pages)"
_FOUND = f"{_HREFS}, f AS (SELECT DISTINCT concat(origin, {_DECODED.format('href')}) AS found FROM (SELECT url, origin, unnest(hrefs) AS href FROM h) WHERE NOT contains(href, '#') AND concat(origin, {_DECODED.format('href')}) <> url)"

_TEXT_OF = lambda h: _DECODED.format(f"regexp_replace({h}, '<[^>]*>', '', 'g')")  # noqa: E731  all text below an element
# In these pages the paragraphs with bold text aren't closed, so that they hold all that follows up to the end of the article.
_ARTICLES = f"""a AS (SELECT page_id, url, {_STRIP(_DECODED.format(_TITLE))} AS title, {_STRIP(_TEXT_OF("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS head, regexp_extract(html, '(?s)</h1>(.*)</article>', 1) AS below,
    regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS inside, regexp_extract(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)</nav>(.*?)<article>', 1) AS beside FROM pages)"""
_AGAIN = "replace(replace(replace(regexp_replace(replace(replace(replace({}, '&lt;', chr(2)), '&gt;', chr(3)), '&quot;', '\"'), '&amp;?', '&', 'g'), '&', '&amp;'), chr(2), '&lt;'), chr(3), '&gt;')"  # references as they are written again
_CLOSED = f"concat({_AGAIN.format("replace(inside, '<br>', '<br/>')")}, repeat('</b></p>', len(regexp_extract_all(inside, '<b>'))))"
_MAIN = f"""{_ARTICLES}, m AS (SELECT page_id, url, inside, CASE WHEN length({_STRIP(_TEXT_OF("inside"))}) > 50 THEN concat('<article>', {_CLOSED}, '</article>')
    WHEN length({_STRIP(_TEXT_OF("beside"))}) > 200 THEN {_AGAIN.format('beside')} ELSE concat('<body>', {_AGAIN.format('beside')}, '<article>', {_CLOSED}, '</article></body>') END AS main FROM a)"""
_BLOCKS = "regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(main, '\\s+', ' ', 'g'), '\\s+(</(h1|p)>)', '\\1', 'g'), '(</b></p>)+(</article>|</body>)+$', ''), '<p><b>', '<p>**'), '<br/>', '  ' || chr(10)), '<h1>', chr(10) || chr(10) || '# '), '</?(p|h1|div|article|body)( [^>]*)?>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g')"

QUERIES = {
    "html_title": (html_title, f"SELECT page_id, {_STRIP(_DECODED.format(_TITLE))} AS title FROM pages"),
    "html_links": (html_links, f"WITH {_HREFS} SELECT page_id, CAST(generate_subscripts(hrefs, 1) - 1 AS INTEGER) AS pos, {_DECODED.format('unnest(hrefs)')} AS href FROM h"),
    "html_nodes": (
        html_nodes,
        "WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)[^>]*>.*?</(script|style)>', '<\\1>', 'g') AS h FROM pages) "
        "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, lower(unnest(regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM x) GROUP BY page_id, tag",
    ),
    "html_sections": (
        html_sections_,
        f"WITH {_ARTICLES}, c AS (SELECT *, concat(head, chr(10), chr(10), {_STRIP(_TEXT_OF('below'))}) AS content FROM a) "
        f"SELECT url AS source_file, CAST(0 AS INTEGER) AS section_index, md5(concat(url, '_0_', head)) AS chunk_id, title, head AS heading, content, '' AS links, CAST(NULL AS VARCHAR) AS error FROM c WHERE length({_STRIP('content')}) >= 50",
    ),
    "html_main_content": (html_main_content, f"WITH {_MAIN} SELECT page_id, main FROM m"),
    "html_markdown": (
        html_markdown,
        f"WITH {_MAIN}, b AS (SELECT page_id, url, concat({_STRIP(_DECODED.format(_BLOCKS))}, repeat('**', len(regexp_extract_all(main, '<b>')))) AS b FROM m) "
        f"SELECT page_id, {_TO_PATH} AS path, concat({_STRIP("regexp_replace(b, '\\n{3,}', chr(10) || chr(10), 'g')")}, chr(10)) AS markdown FROM b",
    ),
    "url_to_path": (url_to_path, f"SELECT page_id, {_TO_PATH} AS path FROM pages"),
    "url_scope_filter": (
        url_scope_filter,
        f"WITH b AS (SELECT min({_ORIGIN}) AS base FROM pages WHERE starts_with(url, 'https://')) SELECT page_id, {_ORIGIN} AS origin, starts_with(url, base) AND NOT contains(url, '#') AS in_scope FROM pages, b",
    ),
    "host_counts": (host_counts, "SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1"),
    "frontier_wave": (frontier_wave, f"WITH {_FOUND} SELECT found AS url, 'pending' AS status, CAST(0 AS INTEGER) AS retry_count FROM f WHERE found NOT IN (SELECT url FROM pages)"),
    "frontier_status": (
        frontier_status,
        f"WITH {_FOUND}, n AS (SELECT count(*) AS p FROM f WHERE found NOT IN (SELECT url FROM pages)), u AS (SELECT DISTINCT url FROM pages) "
        "SELECT (SELECT p FROM n) AS pending, CAST(0 AS BIGINT) AS in_progress, count(*) FILTER (NOT contains(url, '?')) AS completed, count(*) FILTER (contains(url, '?')) AS error, count(*) + (SELECT p FROM n) AS total FROM u",
    ),
    "crawl_success_rate": (
        crawl_success_rate,
        f"WITH {_FOUND}, n AS (SELECT count(*) AS p FROM f WHERE found NOT IN (SELECT url FROM pages)), u AS (SELECT DISTINCT url FROM pages), "
        "c AS (SELECT count(*) FILTER (NOT contains(url, '?')) AS completed, count(*) + (SELECT p FROM n) AS total FROM u) SELECT completed, total, round(CAST(completed AS DOUBLE) * 100 / greatest(total, 1), 1) AS success_rate FROM c",
    ),
    "frontier_json": (
        frontier_json,
        "SELECT DISTINCT url, 'in_progress' AS status, CAST(epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) AS discovered, true AS open, CAST(0 AS INTEGER) AS retry_count FROM pages",
    ),
    "challenge_detect": (
        challenge_detect,
        "SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'loading' WHEN page_id % 7 = 0 THEN 'captcha' ELSE '' END AS challenge FROM pages",
    ),
}
