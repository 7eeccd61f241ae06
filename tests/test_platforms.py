"""List pages of each platform, in small pages of our own."""

import pytest

from actaspark.sources import platforms as P


def acts(spark, name, html, **o):
    d = spark.createDataFrame([("p", html, None), ("leer", "<p>niente</p>", "x"), ("null", None, "x")], "pagina string, html string, tipo_pagina string")
    return [tuple(r[c] for c in P.FIELDS) for r in P.read(d, name, **o).orderBy("riga").collect()]


CELLS = lambda *c: "".join(f"<td class='x'>{x}</td>" for x in c)
CASES = {
    "icity": ("<tr><th>N.</th></tr><tr>" + CELLS("12", "Delibera", "<a href='/d/1'>Oggetto &egrave; qui</a>", "01/02/2024", "16/02/2024") + "</tr>", {"base_url": "https://a.example/lista"}, [("delibera", "12", "Oggetto è qui", None, "2024-02-01", "2024-02-16", "https://a.example/d/1")]),
    "jcitygov": (
        '<th>Anno e Numero</th><tr class="master-detail-list-line odd" data-id="7">' + CELLS('<span class="categoria_categoria">Bandi</span> <span class="categoria_sottocategoria">Gare</span>', "2026/1031", "T", "01/02/2024  32/02/2024") + "</tr>",
        {"base_url": "u"}, [("bandi / gare", "1031", "T", None, "2024-02-01", None, "u?action=mostraDettaglio&id=7")],
    ),
    "portalepa": ('<tr class="paginated_element">' + CELLS("3", "<a href='albo_dettagli.php?id=9&amp;x=1'>T</a>", "Determina del settore", "01/02/2024", "") + '</tr><tr class="paginated_element"><td>1</td></tr>', {"base_url": "u"}, [("determina", "3", "T", "2024-02-01", None, None, "u/albo_dettagli.php?id=9&x=1")]),
    "siracusa": ('<tr class="paginated_element">' + CELLS("3", "<a href='/albo_dettagli.php?id=9'>T</a>", "") + "</tr>", {"base_url": "u"}, [("atto", "3", "T", None, None, None, "u/albo_dettagli.php?id=9")]),
    "halley": (
        '<tr><td><strong>Numero pubblicazione</strong><div>1</div><strong>Tipo</strong><br><div>Ordinanza</div><strong>Oggetto</strong> <a href="x?id_pubbl=5"><div>T</div></a><strong>Oggetto</strong><div>U</div><strong>Numero atto</strong><div>Non definito</div><strong>Data atto</strong><div>01/02/2024</div></td></tr>',
        {"base_url": "u"}, [("ordinanza", None, "T", "2024-02-01", None, None, "u?id_pubbl=5")],
    ),
    "hspromila": ('<tr class="">' + CELLS("", "k1", "", "", "44", "T", "Gara d'appalto", "", "01/02/2024", "2024-03-01") + '</tr><tr class="">' + CELLS("a") + "</tr>", {"base_url": "u"}, [("bando", "44", "T", None, "2024-02-01", "2024-03-01", "u#k1")]),
    "urbi": (
        "".join(f"<tr><td>Ente Mittente <strong>{e}</strong> Tipologia Atto <strong>Determinazione</strong><br><strong>T {e}</strong> <br> in pubblicazione dal 01-02-2024 al 16-02-2024 (reg. 5/2024) IdMePubblica={i}</td></tr>" for i, e in ((1, "Comune di Alfa"), (2, "Altro"))),
        {"base_url": "u", "qs_base": "q", "ente_mittente": "COMUNE DI ALFA"}, [("determina", "5/2024", "T Comune di Alfa", None, "2024-02-01", "2024-02-16", "u?q&IdMePubblica=1")],
    ),
    "palermo": ("<tr><td><a href='tabella-modifica.do?row=1'>1</a></td>" + CELLS("88", "01/02/2024", "T", "02/02/2024", "17/02/2024") + "</tr>", {"base_url": "u", "tipo": "delibera"}, [("delibera", "88", "T", "2024-02-01", "2024-02-02", "2024-02-17", "u#prot-88")]),
    "ribera": ("<tr>" + CELLS("9", '<a href="?action=visatto&amp;id=3">T</a>', "dal 01/02/2024 al 16/02/2024", "Avviso di deposito", "") + "</tr>", {"base_url": "u"}, [("avviso", "9", "T", None, "2024-02-01", "2024-02-16", "u?action=visatto&id=3")]),
    "trapani": (
        '<div class="panel panel-primary"><div class="panel-heading titolo-albo">Registrazione Albo n. 4/2024 Oggetto: Prima</div>Tipo pubblicazione: <div class="testata-dati x"> Bando </div> Pubblicazione dal 01/02/2024 al 16/02/2024</div><div class="panel panel-primary"><div class="panel-heading titolo-albo">Senza numero</div></div>',
        {"base_url": "u"}, [("bando", "4/2024", "Prima", "2024-02-01", None, "2024-02-16", "u/AlboOnline/albo/4/2024")],
    ),
    "agrigento": (
        '<a data-link="https://h.example/?anno=2024&amp;numero=8"></a><a data-link="https://h.example/?anno=2024&amp;numero=8"></a><b data-target="#collapse8_2024"><span class="text text-custom p-1">8/2024 del 01/02/2024 - Delibera - <em>T</em></span>',
        {}, [("delibera", "8/2024", "T", "2024-02-01", None, None, "https://h.example/?anno=2024&numero=8")],
    ),
}
CASES["catania"] = CASES["urbi"]


@pytest.mark.parametrize("name", sorted(P.PLATFORMS))
def test_platform(spark, name):
    html, options, want = CASES[name]
    assert acts(spark, name, html, **options) == want


def test_counts_options_and_pages(spark):
    d = spark.createDataFrame([("p", CASES["urbi"][0]), ("leer", ""), (None, None)], "pagina string, html string")
    assert {(r[0], r[1]) for r in P.row_counts(d, "urbi").collect()} == {("p", 2), ("leer", 0), (None, 0)}
    with pytest.raises(ValueError):
        P.read(d, "urbi")
    card = "<h5 class='card-title a'>Delibere</h5> <a onclick=\"location.href='x/scelta_tipo_documento.jsp?a=1&amp;b=2'\">"
    c = spark.createDataFrame([(1, card + card.replace("Delibere", "Cose"), "pagina 2 di 7")], "id int, html string, piede string")
    assert [(r["url"], r["tipo"], r["predefinita"]) for r in P.categories(c).collect()] == [("x/scelta_tipo_documento.jsp?a=1&b=2", "delibera", True), ("x/scelta_tipo_documento.jsp?a=1&b=2", "atto", False)]
    r = c.select(P.page_of_pages(P.F.col("piede")).alias("p"), P.page_of_pages(P.F.lit("")).alias("q"), P.span_asked(P.F.lit("2024-11-20").cast("date")).alias("s"), P.detail_amount(P.F.lit("impegno di € 1.250,50 e euro 3")).alias("a")).first()
    assert (tuple(r["p"]), tuple(r["q"]), str(r["s"]["dal"]), str(r["s"]["al"]), str(r["a"])) == ((2, 7), (1, 1), "2024-01-01", "2025-01-19", "1250.50")
