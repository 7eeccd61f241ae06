"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from actaspark.llm import areas, boilerplate, leakage, names, pii, scans, tokenizer
from actaspark.tables import load

QUERIES = {
    "p1_found": lambda s, d: boilerplate.found(load(s, d, "atti")),
    "p1_blocks": lambda s, d: boilerplate.block_report(load(s, d, "atti")),
    "p1_clean": lambda s, d: boilerplate.cleaned(load(s, d, "atti")),
    "p8_found": lambda s, d: leakage.join(load(s, d, "documents"), load(s, d, "valutazione")),
    "p9_found": lambda s, d: areas.assign(load(s, d, "documents"), load(s, d, "esempi_area")).select("doc_id", "area"),
    "p9_composition": lambda s, d: areas.composition(load(s, d, "documents"), load(s, d, "esempi_area")),
    "p4_found": lambda s, d: scans.found(load(s, d, "paginatesto"), load(s, d, "atti")),
    "p4_text": lambda s, d: scans.texts(load(s, d, "paginatesto"), load(s, d, "atti")),
    "p5_found": lambda s, d: pii.found(load(s, d, "atti")),
    "p5_masked": lambda s, d: pii.masked(load(s, d, "atti")),
    "p6_found": lambda s, d: names.link(load(s, d, "anac_sample"), load(s, d, "enti")),
    "p7_ids": lambda s, d: tokenizer.encode(load(s, d, "documents")),
    "p7_round_trip": lambda s, d: tokenizer.round_trip(load(s, d, "documents")),
}
SQL: dict[str, str] = {"p1_found": boilerplate.FOUND_SQL}
