"""Rows from list and detail pages, by patterns, in the JVM.

Entities are resolved before tags are stripped, so an escaped tag goes too. A null page gives no rows; missing cells are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Common character entities, fixed values.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&agrave;": "à", "&egrave;": "è", "&eacute;": "é", "&igrave;": "ì", "&ograve;": "ò", "&ugrave;": "ù", "&euro;": "€", "&deg;": "°", "&amp;": "&"}


def unescape(c: Column) -> Column:
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def strip_tags(c: Column) -> Column:
    """Text of a fragment: entities resolved, scripts, styles and tags out, white space collapsed; empty becomes null."""
    t = F.regexp_replace(unescape(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"[\s ]+", " "))
    return F.when(t != "", t)


def table_rows(pages: DataFrame, html: str, columns: Sequence[str], row: str = r"(?is)<tr\b[^>]*>(.*?)</tr>", cell: str = r"(?is)<td\b[^>]*>(.*?)</td>", least: int = 1) -> DataFrame:
    """One row per table row with at least ``least`` cells: the pages' other columns, ``riga`` and the cells by position, and ``href``."""
    keep = [c for c in pages.columns if c != html]
    r = pages.where(F.col(html).isNotNull()).select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(row), 1)).alias("riga", "_row"))
    r = r.withColumn("_cells", F.regexp_extract_all("_row", F.lit(cell), 1)).where(F.size("_cells") >= least)
    href = F.regexp_extract("_row", r"""(?i)href\s*=\s*["']([^"']*)["']""", 1)
    return r.select(*keep, "riga", *[strip_tags(F.get("_cells", F.lit(i))).alias(c) for i, c in enumerate(columns)], F.when(href != "", unescape(href)).alias("href"))


def labelled(pages: DataFrame, html: str, fields: Mapping[str, Sequence[str]], label: str = r"(?is)<dt\b[^>]*>(.*?)</dt>\s*<dd\b[^>]*>.*?</dd>", value: str = r"(?is)<dt\b[^>]*>.*?</dt>\s*<dd\b[^>]*>(.*?)</dd>") -> DataFrame:
    """One row per page: each field's value under the first of its labels the page has; of repeated labels the first counts."""
    keep = [c for c in pages.columns if c != html]
    norm = lambda x: F.lower(F.rtrim(F.coalesce(strip_tags(x), F.lit("")), F.lit(" :")))
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all(html, F.lit(label), 1), norm).alias("k"), F.transform(F.regexp_extract_all(html, F.lit(value), 1), strip_tags).alias("v"))
    d = pages.withColumn("_pairs", F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")))
    under = lambda name: F.get(F.filter("_pairs", lambda p: p["k"] == name.lower()), F.lit(0))["v"]
    one = lambda names: F.coalesce(*[under(n) for n in names])
    return d.select(*keep, *[one(names).alias(f) for f, names in fields.items()])


def first_word_type(c: Column) -> Column:
    return F.lower(F.split(F.trim(c), r"\s+")[0])


def mapped_type(c: Column, rules: Sequence[tuple[str, str]], otherwise: str = "atto") -> Column:
    """The type of the first substring, in order, that a category holds."""
    out = F.lit(otherwise)
    for part, kind in reversed(rules):
        out = F.when(F.contains(F.lower(c), F.lit(part)), kind).otherwise(out)
    return out


def attachments(pages: DataFrame, html: str, row: str = r"(?is)<tr\b[^>]*data-key=\"([^\"]*)\"", link: str = r"atob\('([A-Za-z0-9+/=]*)'\)") -> DataFrame:
    """Rows of an attachment list paired with their encoded links by position; a link that does not decode stays null in its place."""
    keep = [c for c in pages.columns if c != html]
    z = F.arrays_zip(F.regexp_extract_all(html, F.lit(row), 1).alias("chiave"), F.regexp_extract_all(html, F.lit(link), 1).alias("url"))
    e = pages.select(*keep, F.inline(z)).where("chiave is not null")
    return e.withColumn("url", F.try_to_binary("url", F.lit("base64")).cast("string"))
