"""Digests, kinds of content by first bytes, and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: First bytes of known contents, in hexadecimal; fixed values.
MAGIC = (("pdf", "25504446"), ("zip", "504B"), ("markup", "3C"))


def kind_of(raw: Column) -> Column:
    """The kind of a binary content; ``altro`` where no known bytes begin it, null for null."""
    head = F.hex(F.substring(raw, 1, 8))
    out = F.lit("altro")
    for name, begin in reversed(MAGIC):
        out = F.when(head.startswith(begin), name).otherwise(out)
    return F.when(raw.isNotNull(), out)


def host(url: Column) -> Column:
    """The host of an address, null where it cannot be read."""
    return F.try_parse_url(url, F.lit("HOST"))


def joined(base: Column, link: Column) -> Column:
    """A link of a page as a whole address: absolute, from the host's root, or beside the page. A null link stays null."""
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)
    beside = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(?:/(?:[^?#]*/)?)?", 0)
    whole = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), link))
    return whole.when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.when(beside.endswith("/"), beside).otherwise(F.concat(beside, F.lit("/"))), link))
