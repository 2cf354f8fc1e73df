"""Profiles of Markdown outputs: lines, characters, headings, tables.

All of it is computed within a row, by one pass of a regular expression for each figure, so a profile
of any number of documents needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markfuse.functions.text import SPACE, col, strip

_HEADING = rf"(?dUm)^(#{{1,6}})[{SPACE}&&[^\n]]+([^\n]+)"
# a table is a run of lines that start with a bar
_TABLE = rf"(?dUm)(?:^[{SPACE}&&[^\n]]*+\|[^\n]*+(?:\n|\z))++"


def headings(markdown: Column | str) -> Column:
    """array<struct<level int, title string>> in order. Titles of one character, of digits only and
    empty ones are page furniture and not counted."""
    m = col(markdown)
    marks, titles = (F.regexp_extract_all(m, F.lit(_HEADING), F.lit(i)) for i in (1, 2))
    both = F.zip_with(marks, titles, lambda a, b: F.struct(F.length(a).alias("level"), strip(b).alias("title")))
    return F.filter(both, lambda h: (F.length(h["title"]) > 1) & ~h["title"].rlike(r"(?U)\A\d+\z"))


def table_count(markdown: Column | str) -> Column:
    return F.regexp_count(col(markdown), F.lit(_TABLE))


def line_count(markdown: Column | str) -> Column:
    m = col(markdown)
    return F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit(""))) + 1


def profile(outputs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """outputs plus exists, lines, chars, titles, headings, tables; null Markdown means a missing file,
    whose figures are null."""
    m = F.col(markdown)
    return outputs.select(
        "*",
        m.isNotNull().alias("exists"),
        line_count(m).cast("long").alias("lines"),
        F.length(m).cast("long").alias("chars"),
        F.transform(headings(m), lambda h: h["title"]).alias("titles"),
        F.when(m.isNotNull(), F.size(headings(m))).cast("long").alias("headings"),
        table_count(m).cast("long").alias("tables"),
    )
