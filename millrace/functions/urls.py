"""URL functions: what SQL can say as column expressions, joining as a pandas UDF."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def origin(url: Column) -> Column:
    """``scheme://host:port``."""
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("AUTHORITY")))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def to_path(url: Column) -> Column:
    """Where the Markdown of a page is kept: its path with ``.md``, or ``index.md`` below a folder.

    The query is left out.  A null or unreadable URL has no path.
    """
    path = F.ltrim(F.try_parse_url(url, F.lit("PATH")), F.lit("/"))
    last = F.regexp_extract(path, r"[^/]*$", 0)
    named = last.rlike(r"[^.]\.[^.]*$")
    folder = F.when((path == "") | path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.when(named, F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(".md"))).otherwise(F.concat(folder, F.lit("index.md")))


def in_scope(url: Column, base: Column | str, page: Column | None = None) -> Column:
    """Below ``base``, without a fragment, and not ``page`` itself."""
    base = F.lit(base) if isinstance(base, str) else base
    ok = F.startswith(url, base) & ~F.contains(url, F.lit("#"))
    return ok & (url != page) if page is not None else ok


def joined(page: str | None, href: str | None) -> str | None:
    if page is None or href is None:
        return None
    try:
        return urljoin(page, href)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve(page: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` as seen from ``page``; null where it can't be read."""
    return pd.Series([joined(a, b) for a, b in zip(page, href, strict=True)], dtype="object")


@F.pandas_udf(ArrayType(StringType()))
def resolve_all(page: pd.Series, hrefs: pd.Series) -> pd.Series:
    """:func:`resolve` of each of a page's ``hrefs``."""
    return pd.Series([None if bs is None else [joined(a, b) for b in bs] for a, bs in zip(page, hrefs, strict=True)], dtype="object")
