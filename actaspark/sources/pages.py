"""Pages of a text, the page of a place, and snippets around it. Offsets count Unicode characters from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def split_pages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, numero, testo, offset_inizio, offset_fine): pages between form feeds. A null text has no pages, an empty one has one."""
    parts = F.split(text, "\f", -1)
    lengths = F.transform(parts, lambda p: F.length(p))
    p = docs.where(F.col(text).isNotNull()).select(key, lengths.alias("_l"), F.posexplode(parts).alias("_i", "testo"))
    start = F.aggregate(F.slice("_l", 1, F.col("_i")), F.lit(0), lambda a, x: a + x + 1)
    return p.select(key, (F.col("_i") + 1).cast("int").alias("numero"), "testo", start.cast("int").alias("offset_inizio"), (start + F.length("testo")).cast("int").alias("offset_fine"))


def page_of(pages: Column, offset: Column) -> Column:
    """Number of the page (of an array of numero, offset_inizio, offset_fine) that an offset lies in, else null."""
    return F.get(F.filter(pages, lambda p: (p["offset_inizio"] <= offset) & (offset < p["offset_fine"])), F.lit(0))["numero"]


def snippet(text: Column, start: Column, end: Column, around: int = 40) -> Column:
    """The text around a place, white space collapsed."""
    low = F.greatest(start - around, F.lit(0))
    return F.trim(F.regexp_replace(F.substring(text, low + 1, end + around - low), r"\s+", " "))
