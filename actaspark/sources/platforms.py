"""List and detail pages of notice boards, one description per platform, read by the same plan.

A description says what a row is, what it must hold, how many cells it needs, and each field as an expression over the row, its
cells and the page. All of it runs in the JVM. Null pages have no rows; missing fields are null; dates that are not in the calendar are null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as attribute

from pyspark.sql import Column, DataFrame, functions as F

from actaspark.functions.encoding import joined
from actaspark.functions.text import iso_date, italian_amount
from actaspark.sources.html import first_word_type, mapped_type, strip_tags, unescape

FIELDS = ("tipo", "numero", "oggetto", "data_atto", "data_pub", "data_scadenza", "url_fonte")
#: Types by parts of a category, in order; fixed values.
KINDS = (("ordinanza", "ordinanza"), ("delibera", "delibera"), ("determin", "determina"), ("concors", "concorso"), ("gara", "bando"), ("appalt", "bando"), ("band", "bando"), ("decret", "decreto"))
NOTICES, NOTICE = (*KINDS, ("avvis", "avviso")), (*KINDS, ("avviso", "avviso"))
#: Types of the categories of one platform, and those read by default; fixed values.
CATEGORIES = {
    "delibere": "delibera", "determinazioni dirigenziali": "determina", "determinazioni/ord. sindacali": "ordinanza", "avvisi e bandi di concorso": "concorso",
    "bandi, avvisi, gare di appalti ed esiti": "bando", "avvisi ed atti diversi": "avviso", "avvisi ed atti di altri enti": "avviso", "convocazioni": "convocazione",
    "concessione": "concessione", "pubblicazioni di matrimonio": "matrimonio", "documento generico": "atto",
}
DEFAULT_CATEGORIES = ("delibera", "determina", "ordinanza", "concorso", "bando")
#: Days after today up to which one platform is asked for; a fixed value.
MARGIN = 60
TR = r"(?is)<tr\b[^>]*>.*?</tr>"


def one(c: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null if there is none or it is empty."""
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def day(c: Column) -> Column:
    """A date written dd/MM/yyyy, dd-MM-yyyy or yyyy-MM-dd as ISO text."""
    d = F.coalesce(F.try_to_date(F.regexp_extract(F.translate(c, "-", "/"), r"^\s*([0-9]{2}/[0-9]{2}/[0-9]{4})", 1), "dd/MM/yyyy"), iso_date(F.trim(c)))
    return F.date_format(d, "yyyy-MM-dd")


def dates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]{2}/[0-9]{2}/[0-9]{4}"), 0)


@dataclass(frozen=True)
class Row:
    """A row as its description sees it."""

    html: Column
    page: Column
    options: dict[str, str]

    @property
    def cells(self) -> Column:
        return F.regexp_extract_all(self.html, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)

    def raw(self, i: int | Column) -> Column:
        return F.get(self.cells, i if isinstance(i, Column) else F.lit(i))

    def cell(self, i: int | Column) -> Column:
        return strip_tags(self.raw(i))

    def base(self) -> Column:
        return F.lit(self.options.get("base_url", ""))


@dataclass(frozen=True)
class Platform:
    fields: Callable[[Row], dict[str, Column]]
    row: str = TR
    holds: str = ""
    cells: int = 0
    options: tuple[str, ...] = attribute(default=())
    split: str = ""


def _icity(r: Row) -> dict[str, Column]:
    link = one(r.html, r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']+)["']""")
    return {"numero": r.cell(0), "tipo": F.coalesce(F.lower(r.cell(1)), F.lit("determina")), "oggetto": r.cell(2), "data_pub": day(r.cell(3)), "data_scadenza": day(r.cell(4)), "url_fonte": joined(r.base(), unescape(link))}


def _jcitygov(r: Row) -> dict[str, Column]:
    """The number's column is there only if the header names it."""
    numbered = F.contains(r.page, F.lit("Anno e Numero"))
    shift = F.when(numbered, 1).otherwise(0)
    part = lambda name: strip_tags(one(r.raw(0), rf'(?is)<span class="categoria_{name}">(.*?)</span>'))
    number = F.when(numbered, r.cell(1))
    both = dates(r.cell(shift + 2))
    url = F.concat(r.base(), F.lit("?action=mostraDettaglio&id="), one(r.html, r'(?i)data-id="([0-9]+)"'))
    return {
        "tipo": F.coalesce(F.lower(F.when(part("categoria").isNotNull(), F.concat_ws(" / ", part("categoria"), part("sottocategoria")))), F.lower(r.cell(0)), F.lit("atto")),
        "numero": F.when(F.contains(number, F.lit("/")) & ~number.endswith("/"), F.substring_index(number, "/", -1)), "oggetto": r.cell(shift + 1), "data_pub": day(F.get(both, F.lit(0))), "data_scadenza": day(F.get(both, F.lit(1))), "url_fonte": url,
    }


def _paginated(r: Row) -> dict[str, Column]:
    link = unescape(one(r.html, r"""href=["']([^"']*albo_dettagli\.php\?id=[0-9]+[^"']*)["']"""))
    return {"numero": r.cell(0), "oggetto": r.cell(1), "tipo": F.coalesce(first_word_type(r.cell(2)), F.lit("atto")), "data_atto": day(r.cell(3)), "data_scadenza": day(r.cell(4)), "url_fonte": F.concat(r.base(), F.lit("/"), F.ltrim(link, F.lit("/")))}


def _halley(r: Row) -> dict[str, Column]:
    """Labelled fields, of which the first of a name counts; an undefined one is null."""

    def value(label: str) -> Column:
        v = strip_tags(one(r.html, rf"(?s)<strong>{label}</strong>(?:\s*<br>)?(?:\s*<a[^>]*>)?\s*<div[^>]*>(.*?)</div>"))
        return F.when(F.lower(v) != "non definito", v)

    url = F.concat(r.base(), F.lit("?id_pubbl="), one(r.html, r'href="[^"]*id_pubbl=([0-9]+)"'))
    return {"tipo": F.coalesce(F.lower(value("Tipo")), F.lit("atto")), "numero": value("Numero atto"), "oggetto": value("Oggetto"), "data_atto": day(value("Data atto")), "data_scadenza": day(value("Data fine")), "url_fonte": url}


def _hspromila(r: Row) -> dict[str, Column]:
    return {"numero": r.cell(4), "oggetto": r.cell(5), "tipo": mapped_type(F.coalesce(r.cell(6), F.lit("")), NOTICES), "data_pub": day(r.cell(8)), "data_scadenza": day(r.cell(9)), "url_fonte": F.concat(r.base(), F.lit("#"), F.coalesce(r.cell(1), F.lit("")))}


def _sent(r: Row) -> Column:
    return F.trim(one(r.html, r"Ente Mittente\s*<strong>([^<]*)</strong>"))


def _urbi(r: Row) -> dict[str, Column]:
    """``_proprio`` tells rows of the sender asked for from those of others on the same board."""
    span = r"in pubblicazione dal\s+([0-9-]+)\s+al\s+([0-9-]+)(?:\s*\(reg\.\s*([^)]+)\))?"
    kind = one(r.html, r"Tipologia Atto\s*<strong>([^<]*)</strong>")
    return {
        "tipo": mapped_type(F.coalesce(kind, F.lit("")), KINDS), "numero": F.trim(one(r.html, span, 3)), "oggetto": strip_tags(one(r.html, r"(?s)<br><strong>(.*?)</strong>\s*<br>")), "data_pub": day(one(r.html, span, 1)), "data_scadenza": day(one(r.html, span, 2)),
        "url_fonte": F.concat(r.base(), F.lit("?" + r.options.get("qs_base", "") + "&IdMePubblica="), one(r.html, r"IdMePubblica=([0-9]+)")), "_proprio": F.coalesce(F.upper(_sent(r)) == r.options.get("ente_mittente", "").upper(), F.lit(False)),
    }


def _palermo(r: Row) -> dict[str, Column]:
    number = r.cell(1)
    return {"tipo": F.lit(r.options.get("tipo", "atto")), "numero": number, "oggetto": r.cell(3), "data_atto": day(r.cell(2)), "data_pub": day(r.cell(4)), "data_scadenza": day(r.cell(5)), "url_fonte": F.concat(r.base(), F.coalesce(F.concat(F.lit("#prot-"), number), F.lit("")))}


def _ribera(r: Row) -> dict[str, Column]:
    both = dates(r.cell(2))
    url = F.concat(r.base(), F.lit("?action=visatto&id="), one(r.html, r'href="[^"]*[?&]action=visatto&(?:amp;)?id=([0-9]+)'))
    return {"numero": r.cell(0), "oggetto": r.cell(1), "tipo": mapped_type(F.coalesce(r.cell(3), F.lit("")), NOTICE), "data_pub": day(F.get(both, F.lit(0))), "data_scadenza": day(F.get(both, F.lit(1))), "url_fonte": url}


def _trapani(r: Row) -> dict[str, Column]:
    head = one(r.html, r'(?s)<div class="panel-heading titolo-albo"[^>]*>(.*?)</div>')
    number = lambda g: one(strip_tags(head), r"Registrazione Albo n\.\s*([0-9]+)/([0-9]{4})", g)
    kind = strip_tags(one(r.html, r'(?is)Tipo pubblicazione:.*?<div class="testata-dati[^"]*"[^>]*>\s*([^<]+)'))
    return {
        "tipo": F.coalesce(F.lower(kind), F.lit("atto")), "numero": F.concat(number(1), F.lit("/"), number(2)), "oggetto": strip_tags(one(head, r"(?s)Oggetto:\s*(.*)$")), "data_atto": day(one(r.html, r"Pubblicazione dal\s+([0-9]{2}/[0-9]{2}/[0-9]{4})")),
        "data_scadenza": day(one(r.html, r"(?<!\w)al\s+([0-9]{2}/[0-9]{2}/[0-9]{4})")), "url_fonte": F.concat(r.base(), F.lit("/AlboOnline/albo/"), number(1), F.lit("/"), number(2)),
    }


def _agrigento(r: Row) -> dict[str, Column]:
    """A permanent link, and the text shown beside its number elsewhere on the page."""
    link = r'data-link="(https?://[^"]+anno=([0-9]+)[^"]*numero=([0-9]+))"'
    year, number = one(r.html, link, 2), one(r.html, link, 3)
    at = F.instr(r.page, F.concat(F.lit("#collapse"), number, F.lit("_"), year))
    low = F.greatest(at - 200, F.lit(1))
    near = F.when(at > 0, F.substring(r.page, low, at + 800 - low))
    shown = one(near, r'(?s)<span class="text text-custom p-1">(.*?)</span>')
    head = strip_tags(F.regexp_replace(shown, r"(?s)<em>.*?</em>", ""))
    parts = r"(?i)([0-9]+/[0-9]{4})\s+del\s+([0-9]{2}/[0-9]{2}/[0-9]{4})\s+-\s+([^-]+?)\s+-"
    return {"tipo": F.coalesce(F.lower(one(head, parts, 3)), F.lit("atto")), "numero": F.concat(number, F.lit("/"), year), "oggetto": strip_tags(one(shown, r"(?s)<em>(.*?)</em>")), "data_atto": day(one(head, parts, 2)), "url_fonte": unescape(one(r.html, link, 1)), "_proprio": shown.isNotNull()}


PLATFORMS = {
    "icity": Platform(_icity, holds=r"(?is)<td\b.*<a\b|<a\b.*<td\b", cells=1),
    "jcitygov": Platform(_jcitygov, row=r'(?is)<tr\s+class="master-detail-list-line[^"]*"\s+data-id="[0-9]+">.*?</tr>', cells=3),
    "portalepa": Platform(_paginated, row=r'(?s)<tr class="paginated_element">.*?</tr>', holds=r"albo_dettagli\.php\?id=[0-9]", cells=3),
    "siracusa": Platform(_paginated, row=r'(?s)<tr class="paginated_element">.*?</tr>', holds=r"albo_dettagli\.php\?id=[0-9]", cells=3),
    "halley": Platform(_halley, row=r"(?s)<tr>.*?</tr>", holds=r'(?s)<strong>Numero pubblicazione</strong>.*id_pubbl=[0-9]|id_pubbl=[0-9].*<strong>Numero pubblicazione</strong>'),
    "hspromila": Platform(_hspromila, row=r'(?s)<tr class="">.*?</tr>', cells=10),
    "urbi": Platform(_urbi, holds=r"IdMePubblica=[0-9]", options=("qs_base", "ente_mittente")),
    "catania": Platform(_urbi, holds=r"IdMePubblica=[0-9]", options=("qs_base", "ente_mittente")),
    "palermo": Platform(_palermo, holds=r"tabella-modifica\.do\?row=[0-9]", cells=6, options=("tipo",)),
    "ribera": Platform(_ribera, row=r"(?s)<tr>.*?</tr>", holds=r"[?&]action=visatto&(?:amp;)?id=[0-9]", cells=5),
    "trapani": Platform(_trapani, holds=r"Registrazione Albo n\.\s*[0-9]+/[0-9]{4}", split='<div class="panel panel-primary">'),
    "agrigento": Platform(_agrigento, row=r'data-link="https?://[^"]+anno=[0-9]+[^"]*numero=[0-9]+"'),
}


def _each(pages: DataFrame, platform: Platform, html: str) -> DataFrame:
    """The page's rows that hold what they must, with the page beside them."""
    rows = F.slice(F.split(html, platform.split.replace("(", r"\("), -1), 2, 1_000_000) if platform.split else F.regexp_extract_all(html, F.lit(platform.row), 0)
    d = pages.where(F.col(html).isNotNull()).select("*", F.posexplode(rows).alias("riga", "_row"))
    d = d.where(F.col("_row").rlike(platform.holds)) if platform.holds else d
    return d.where(F.size(F.regexp_extract_all("_row", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), 1)) >= platform.cells) if platform.cells else d


def read(pages: DataFrame, name: str, html: str = "html", **options: str) -> DataFrame:
    """The acts of list pages of a platform: the pages' other columns, riga (order in the page) and FIELDS; rows of other senders are left out.

    Of rows with one address on a page the first counts where the platform repeats its links.
    """
    p = PLATFORMS[name]
    missing = [o for o in p.options if o not in options]
    if missing:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    keep = [c for c in pages.columns if c != html]
    d = _each(pages, p, html)
    f = p.fields(Row(F.col("_row"), F.col(html), options))
    own = f.get("_proprio", F.lit(True))
    out = d.where(own).select(*keep, "riga", *[f.get(c, F.lit(None).cast("string")).alias(c) for c in FIELDS])
    if name == "agrigento":
        first = out.groupBy(*keep, "url_fonte").agg(F.min("riga").alias("riga"))
        out = out.join(first.select(*[F.col(k).alias(f"_{k}") for k in keep], F.col("riga").alias("_r")), (F.col("riga") == F.col("_r")) & _same(keep), "left_semi")
    return out


def _same(keep: list[str]) -> Column:
    out = F.lit(True)
    for k in keep:
        out &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def row_counts(pages: DataFrame, name: str, html: str = "html") -> DataFrame:
    """Rows of each page, those of other senders too, so that an empty page differs from one whose rows are all left out."""
    keep = [c for c in pages.columns if c != html]
    n = _each(pages, PLATFORMS[name], html).groupBy(*keep).agg(F.count(F.lit(1)).alias("righe"))
    return pages.select(*keep).join(n.select(*[F.col(k).alias(f"_{k}") for k in keep], "righe"), _same(keep), "left").select(*keep, F.coalesce("righe", F.lit(0)).alias("righe"))


def detail_amount(title: Column) -> Column:
    """The first amount in euro that a title states."""
    return italian_amount(one(title, r"(?i)(?:€|euro)\s*([0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]{1,2})?)"))


def categories(pages: DataFrame, html: str = "html") -> DataFrame:
    """Categories of an entrance page: label, link, type; unknown labels are of type atto."""
    card = r"(?s)<h5[^>]*class='card-title[^>]*>([^<]+)</h5>.*?location\.href='([^']*scelta_tipo_documento\.jsp[^']*)'"
    keep = [c for c in pages.columns if c != html]
    z = F.arrays_zip(F.regexp_extract_all(html, F.lit(card), 1).alias("etichetta"), F.regexp_extract_all(html, F.lit(card), 2).alias("url"))
    d = pages.select(*keep, F.inline(z)).withColumn("etichetta", strip_tags(F.col("etichetta"))).withColumn("url", unescape(F.col("url")))
    kind = F.lit("atto")
    for label, k in CATEGORIES.items():
        kind = F.when(F.lower("etichetta") == label, k).otherwise(kind)
    return d.withColumn("tipo", kind).withColumn("predefinita", F.col("tipo").isin(*DEFAULT_CATEGORIES))


def page_of_pages(html: Column) -> Column:
    """(pagina, di) of a text ``pagina x di y``; 1 of 1 where there is none."""
    n = lambda g: F.coalesce(one(html, r"(?i)pagina\s+([0-9]+)\s+di\s+([0-9]+)", g).try_cast("int"), F.lit(1))
    return F.struct(n(1).alias("pagina"), n(2).alias("di"))


def span_asked(today: Column, start: Column | None = None, end: Column | None = None, margin: int = MARGIN) -> Column:
    """(dal, al) that a reader asks for: from the first of January to ``margin`` days from today unless given."""
    return F.struct(F.coalesce(*([start] if start is not None else []), F.trunc(today, "year")).alias("dal"), F.coalesce(*([end] if end is not None else []), F.date_add(today, margin)).alias("al"))
