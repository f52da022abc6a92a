"""Titles and abstracts from the layout of pages: spans of text with their sizes and places, and the texts of front pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that are headings and no titles (fixed values).
HEADINGS = ("abstract", "keywords", "index terms")
#: Letters of the shortest line that can be a title; of an abstract without an end, and of a front without a heading.
SHORTEST, LONGEST, OPENING = 8, 3000, 2200
_START = r"(?is)\babstract\b[\s:.\-]*"
_END = r"(?im)^\s*(?:keywords?|index terms?|1\.?\s+introduction|i\.?\s+introduction|introduction|background|materials?\s+and\s+methods?|methods)\b"


def stripped(value: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def titles(spans: DataFrame, key: str, page: int = 1) -> DataFrame:
    """The title of each document's first page: (key, title).

    ``spans`` has the key, page, line (a number within the page), y (the line's upper edge), span (a number within the line),
    size and text. A line is its spans joined; that with the largest letters counts, of equal ones the uppermost, of those the
    last in the alphabet. Lines that are short or headings don't; where no other is left, the first line that is long enough.
    A line's spans meet first and a document's lines in an aggregate of one row, so long documents shrink before they move.
    """
    part = F.struct("span", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size"))
    lines = spans.filter(F.col("page") == page).groupBy(key, "line").agg(F.array_sort(F.collect_list(part)).alias("s"), F.min("y").cast("double").alias("y"))
    lines = lines.select(key, "line", stripped(F.array_join(F.transform("s", lambda x: x["text"]), "")).alias("text"), F.array_max(F.transform("s", lambda x: x["size"])).alias("size"), "y")
    lines = lines.filter(F.length("text") >= SHORTEST)
    heading = F.trim(F.lower(F.regexp_replace("text", r"(?U)\s+", " "))).isin(*HEADINGS)
    place = F.struct("size", (-F.col("y")).alias("up"), "text")
    best = lines.groupBy(key).agg(F.max(F.when(~heading, place)).alias("best"), F.min_by("text", "line").alias("first"))
    return best.select(key, F.coalesce("best.text", "first").alias("title"))


def abstracts(pages: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The abstract on each document's front pages: (key, abstract, front).

    ``pages`` has the key, page (from 1) and text. It goes from behind the first heading to the next section or keyword line,
    or LONGEST letters; a front without such a heading gives its first OPENING letters. Documents without text give empty ones.
    """
    fronts = pages.filter(F.col("page").between(1, most)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    fronts = fronts.select(key, stripped(F.array_join(F.transform("p", lambda x: x["text"]), "\n")).alias("front"))
    fronts = fronts.withColumn("__after", F.when(F.col("front").rlike(_START), stripped(F.regexp_extract("front", _START + "(.*)$", 1))))
    fronts = fronts.withColumn("__end", F.regexp_instr("__after", F.lit(_END)))
    found = F.when(F.col("__after").isNull(), F.substring("front", 1, OPENING)).when(F.col("__end") > 0, F.substring(F.col("__after"), F.lit(1), F.col("__end") - 1)).otherwise(F.substring("__after", 1, LONGEST))
    return fronts.select(key, stripped(found).alias("abstract"), "front")
