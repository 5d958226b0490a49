"""Column helpers for text, where Spark's defaults differ from what documents need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script; plain trim() takes spaces alone.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"
OTHER = SPACE.replace("[", "[^", 1)
CHARS_PER_TOKEN = 4


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def blank(text: Column) -> Column:
    """Null, empty or white space alone; a long text is read up to its first other character."""
    return F.coalesce(~text.rlike(OTHER), F.lit(True))


def words(text: Column) -> Column:
    """The runs of non-space characters; no empty strings."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Estimated tokens: characters over four, rounded down."""
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def short_hash(text: Column) -> Column:
    """First 16 hex digits of SHA-256, as for cells and tables."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def shown(value: Column) -> Column:
    """A cell as it is printed: null as None, which array_join would leave out."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def pipe_row(cells: Column) -> Column:
    return F.array_join(F.transform(cells, shown), " | ")


def escaped(text: Column) -> Column:
    """The text as a regular expression that matches it alone."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-#&~])", r"\\$1")
