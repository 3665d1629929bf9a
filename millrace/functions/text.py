"""Text functions as column expressions.

White space is what Python's ``str.isspace`` accepts: Java's Unicode class plus
U+001C to U+001F, which Java leaves out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
CONTROL = r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it, in a lambda too."""
    return F.get(F.transform(F.array(value), body), 0)


def each(df: DataFrame, array: Column, pos: str, value: str, *keep: str) -> DataFrame:
    """A row for each entry of ``array``, with the columns ``keep``.

    The outer form of the generator, as the inner one gets a filter on the size
    of the array, for which the array is worked out a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).where(F.col(pos).isNotNull())


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, SPACE + "+", " ")


def clean(c: Column, join_lines: bool = False) -> Column:
    """Single spaces, no control characters, no space at the ends.

    ``join_lines`` first joins words that a hyphen splits over two lines;
    without it white space is collapsed first, so hyphens stay.
    """
    if join_lines:
        c = F.regexp_replace(c, r"(?U)(\w+)-[\s\x1c-\x1f]*\n[\s\x1c-\x1f]*(\w+)", "$1$2")
    return strip(F.regexp_replace(collapse(c), CONTROL, ""))


def words(c: Column) -> Column:
    """The words between white space; none in a text of white space only."""
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def md5_key(*parts: Column) -> Column:
    """MD5 of the parts joined by underscores."""
    return F.md5(F.concat_ws("_", *[p.cast("string") for p in parts]))


def or_default(c: Column, default: str) -> Column:
    """``default`` for null and for the empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def keep_tail(c: Column, most: int) -> Column:
    """A text longer than ``most`` becomes an ellipsis and its last characters, ``most`` in all."""
    return F.when(F.length(c) > most, F.concat(F.lit("..."), F.substring(c, -(most - 3), most - 3))).otherwise(c)


def keep_head(c: Column, most: int, mark: str = "") -> Column:
    """The first ``most`` characters, with ``mark`` behind them if some were cut off."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def is_md5(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{32}$")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/]*$", 0)


def suffix(c: Column) -> Column:
    """Lower-case extension with its dot; empty without one, and for names that only start with a dot."""
    return F.lower(F.regexp_extract(basename(c), r"[^.](\.[^.]+)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"(?<=[^.])\.[^.]+$", "")


def forward_slashes(c: Column) -> Column:
    return F.translate(c, "\\", "/")


def display_name(c: Column) -> Column:
    """``file_not_found`` as ``File Not Found``."""
    return F.initcap(F.translate(c, "_", " "))


def safe_name(c: Column) -> Column:
    """A data set name with characters outside letters, digits, dash and underscore as underscores."""
    return F.regexp_replace(c, r"[^A-Za-z0-9_-]", "_")


def tokens(c: Column) -> Column:
    """Lower-case runs of Latin letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9À-ɏ]+"), F.lit(0))


def pair(query: Column, document: Column, instruction: str | None = None) -> Column:
    """The text that a pair scorer reads."""
    head = [F.lit(f"Instruction: {instruction}\n")] if instruction else []
    return F.concat(*head, F.lit("Query: "), query, F.lit("\nDocument: "), document)
