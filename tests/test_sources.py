from pyspark.sql import functions as F

from actaspark.functions import spans
from actaspark.sources import html, pages, registry


def test_table_rows_and_labels(spark):
    page = "<table><tr><td>1</td><td><b>Uno &amp; due</b></td></tr><tr><th>x</th></tr><tr><td>2</td><td><a href='/p?a=1&amp;b=2'> Tre </a></td></tr></table><dl><dt>Oggetto:</dt><dd>Gara</dd><dt>oggetto</dt><dd>Altro</dd></dl>"
    d = spark.createDataFrame([(1, page, "k"), (2, None, "k"), (3, "", "k")], "pagina long, h string, altro string")
    got = {(r["pagina"], r["n"], r["t"], r["z"], r["href"]) for r in html.table_rows(d, "h", ["n", "t", "z"]).collect()}
    assert got == {(1, "1", "Uno & due", None, None), (1, "2", "Tre", None, "/p?a=1&b=2")}
    assert {(r["pagina"], r["t"]) for r in html.labelled(d, "h", {"t": ["Titolo", "Oggetto"]}).collect()} == {(1, "Gara"), (2, None), (3, None)}


def test_attachments_keep_their_place(spark):
    d = spark.createDataFrame([(1, "<tr data-key=\"a\"><tr data-key=\"b\"> atob('!') atob('aHR0cA==')".replace("'!'", "'a'"))], "i long, h string")
    assert {(r["chiave"], r["url"]) for r in html.attachments(d, "h").collect()} == {("a", None), ("b", "http")}


def test_pages_give_the_text_back(spark):
    texts = ["a\fbc\f", "", "x" * 100_000 + "\f\f😀y", None]
    d = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    p = pages.split_pages(d, "i", "t").orderBy("i", "numero").collect()
    for i, t in enumerate(texts):
        mine = [r for r in p if r["i"] == i]
        assert (t is None and not mine) or "\f".join(r["testo"] for r in mine) == t
        assert all(t[r["offset_inizio"] : r["offset_fine"]] == r["testo"] for r in mine)
    one = spark.createDataFrame([("abc  def\nghi",)], "t string").select(pages.snippet(F.col("t"), F.lit(5), F.lit(8), 2).alias("s")).collect()[0]["s"]
    assert one == "def g"


def test_registry_problems(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_text("slug,denominazione,codice_istat,modulo,piattaforma_tecnica,base_url,stato,provincia,qs_base,ente_mittente,skip_ssl,note\na,A,123456,m,,http://x,ok,,,,,\na,B,12,z,,,ok,,q,,1,\n")
    d = registry.read(spark, str(f))
    got = {(r["slug"], r["problema"]) for r in registry.problems(d, ["m"]).collect()}
    assert {"slug ripetuto", "modulo ignoto", "codice non di sei caratteri", "manca base_url", "qs_base fuori posto", "skip_ssl fuori posto"} == {p for _, p in got}


def test_spans(spark):
    t = "Determina n. 12/2024 del 3 marzo 2024, art. 21-nonies e art. 5 della legge n. 241/1990. CIG: a1b2c3d4e5, € 1.234,50; 31/02/2024.\nF.to Mario Rossi"
    d = spark.createDataFrame([(1, t), (2, None), (3, "")], "id long, testo string")
    got = [tuple(r) for r in spans.extract(d, "id", "testo").collect()]
    assert {(k, v) for _, k, v, *_ in got} == {("atto", "determina 12/2024"), ("data", "2024-03-03"), ("norma", "241/1990"), ("norma", "art. 21-nonies 241/1990"), ("norma", "art. 5 241/1990"), ("cig", "A1B2C3D4E5"), ("importo", "1234.50"), ("firmatario", "Mario Rossi")}
    assert all(t[s:e] == o for _, _, _, o, s, e in got)
    assert spans.canonical_name("Dott. Mario L. Rossi") == spans.canonical_name("ROSSI MARIO")


def test_act_references():
    t = "nota 4867/2023, deliberazione della Giunta Comunale n. 55 del 18.04.2024; nota prot. n. 18443/2026 del 25-05-2026, determina dirigenziale nr. 7 / 2024, avviso 7, nota 4867/2023, annota n. 3"
    got = list(spans.acts(t))
    assert [v for _, v, _, _ in got] == ["nota 4867/2023", "deliberazione 55", "nota 18443/2026", "determina 7/2024", "nota 4867/2023"]
    assert t[got[1][2] : got[1][3]].endswith("18.04.2024") and t[got[2][2] : got[2][3]].endswith("25-05-2026") and got[0][2] != got[4][2]


def test_amounts_and_codes():
    t = "euro 1.234,50 e 12,5 € poi € 1.23 o 45 euro; €7. CIG n. ABCDE12345, CIG NNNNN12345 CIG:123 CUP A12345678901234 CUP 112345678901234"
    assert [v for _, v, _, _ in spans.amounts(t)] == ["1234.50", "12.50", "45.00", "7.00"]
    assert [(k, v) for k, v, _, _ in spans.codes(t)] == [("cig", "ABCDE12345"), ("cig", "NNNNN12345"), ("cup", "A12345678901234")]
    assert all(t[s:e].upper() == v for _, v, s, e in spans.codes(t))
    assert [spans.number(x) for x in ("1.2345", "1234.567", "1,234", "", "1.000.000")] == [None, None, None, None, spans.Decimal("1000000.00")]


def test_norms_and_signatures():
    t = "art. 5 della legge n. 241/1990 e comma 1-bis; 21 nonies\nart. 13 senza altro.\nCCNL comparto Funzioni Locali del 16.11.2022. legge 241/1990"
    assert [v for _, v, _, _ in spans.norms(t)] == ["art. 5 241/1990", "241/1990", "art. 21-nonies 241/1990", "CCNL comparto Funzioni Locali del 2022-11-16"]
    assert [v for _, v, _, _ in spans.signatories("dott. Mario Rossi Il\nF.to Anna Visto, ing. Ugo De Luca")] == ["Mario Rossi", "Ugo De Luca"]


def test_actors(spark):
    gap = " e così via" * 12
    t = f"Il Segretario  generale dott. Mario Rossi.{gap} IL SINDACO: ANNA MARIA VERDI.{gap} Il Dirigente.{gap} Il Sindaco{gap} Il Segretario Generale F.to Rossi Mario Luca.{gap} Il RUP COMUNE DI ALFA"
    assert [(r, n) for r, n, _, _ in spans.actors(t)] == [("Segretario Generale", "Rossi Mario Luca"), ("Sindaco", "Anna Maria Verdi"), ("Dirigente", None), ("RUP", None)]
    assert t[list(spans.actors(t))[1][2] :].startswith("SINDACO")
    d = spark.createDataFrame([(1, "Il Sindaco dott. Mario Rossi", "x"), (2, "Presidente F.to Rossi Mario", "x"), (3, None, "x"), (4, "", "x")], "id long, testo string, persona string")
    got = [tuple(r) for r in spans.recurring_people(spans.extract(d, "id", "testo"), "id").collect()]
    assert got == [("MARIO ROSSI", 2, 2, "Presidente, Sindaco", "Mario Rossi")]
