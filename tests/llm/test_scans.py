from actaspark.llm import scans as S

GOOD = "il consiglio approva la graduatoria degli idonei con efficacia immediata dopo ampia discussione della giunta socio-sanitari economico-finanziario per una competenza"
HEAD = "Comune di Alfa - atto n. 12 - la graduatoria"


def tables(spark):
    acts = [(100 + i, "7", "titolo", GOOD) for i in range(6)] + [(1, "12/2024", "la graduatoria degli idonei", None), (2, "5", None, None), (3, None, None, None)]
    pages = [
        (1, 1, HEAD + "\nil consigllo approva la gradua-\ntoria degli idonei 12/O5/2024\ncon efficacia socio-\nsanitari immediata dopo compe¬\n— 1 —", "ocr"),
        (1, 2, "COMUNE DI ALFA - ATT0 N. 12 - LA GRADUATORIA\ntenza arnpia discussi0ne della giunta\nPag. 2 di 3", "ocr"),
        (1, 3, "della giunta con efficacia\n\n" + HEAD + "  3", "misto"),
        (2, 1, None, "ocr"), (2, 2, "", "ocr"), (3, 1, "III", "ocr"), (3, 3, "III", "ocr"), (3, 4, "approva " * 30_000, "nativo"),
    ]
    a = spark.createDataFrame(acts, "id long, numero string, oggetto string, testo_estratto string")
    return spark.createDataFrame([(*p, "x") for p in pages], "atto_id long, numero int, testo string, fonte string, parola string"), a


def test_found(spark):
    got = [tuple(r) for r in S.found(*tables(spark)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {
        (1, 1, 1, "intestazione", ""), (1, 1, 6, "numero_pagina", ""), (1, 2, 1, "intestazione", ""), (1, 2, 3, "numero_pagina", ""), (1, 3, 3, "intestazione", ""), (3, 3, 1, "numero_pagina", ""),
        (1, 1, 2, "carattere", "consiglio"), (1, 1, 2, "sillabazione", "graduatoria"), (1, 1, 3, "carattere", "12/05/2024"), (1, 1, 5, "sillabazione", "competenza"), (1, 2, 2, "carattere", "ampia"), (1, 2, 2, "carattere", "discussione"),
    }


def test_repaired(spark):
    got = {(r["atto_id"], r["numero"]): r["testo"] for r in S.repaired(*tables(spark)).collect()}
    assert got[1, 1] == "il consiglio approva la graduatoria degli idonei 12/05/2024 con efficacia socio- sanitari immediata dopo compe"
    assert got[1, 2] == "tenza ampia discussione della giunta" and got[2, 1] is None and got[2, 2] == ""


def test_texts(spark):
    p, a = tables(spark)
    p = p.unionByName(spark.createDataFrame([(4, 2, "tcnza della giunta\n", "ocr", "x"), (4, 1, "dopo ampia Compe-", "ocr", "x"), (4, 3, "\n approva.", "ocr", "x"), (4, 4, "\nil consiglio", "ocr", "x"), (4, 6, "la giunta", "ocr", "x")], p.schema))
    rows = [(r["atto_id"], r["testo"]) for r in S.texts(p, a).collect()]
    got = dict(rows)
    assert len(rows) == len(got) == 4
    # a word cut at the page's end, a compound, a paragraph over pages
    assert got[1] == "il consiglio approva la graduatoria degli idonei 12/05/2024 con efficacia socio-sanitari immediata dopo competenza ampia discussione della giunta della giunta con efficacia"
    assert got[2] == "" and got[3].split("\n\n")[0] == "III"
    # a misread cut word, blank lines at pages' edges, a missing page
    assert got[4] == "dopo ampia Competenza della giunta approva.\n\nil consiglio\n\nla giunta"


def test_assembled():
    assert S.assembled([(1, None, set(), {}, {})]) is None
    text = "il dirigente (AMMI-\nNLSTRATORE), con dell'ammi-\nni-\nstratore\n\nsocio-\n\nsanitari. E\n\nvia"
    cuts = {1: "amministratore", 2: "ammini", 3: "nistratore", 6: None}
    assert S.assembled([(1, text, set(), cuts, {"ammi": "ammo"})]) == "il dirigente (AMMINISTRATORE), con dell'amministratore\n\nsocio-sanitari. E\n\nvia"


def test_empty(spark):
    p, a = tables(spark)
    assert S.found(p.limit(0), a).count() == 0 and S.found(p, a.limit(0)).where("difetto = 'intestazione'").count() == 3


def test_page_numbers():
    for s in ("Pag. 2 di 5", "pagina 2", "- 2 -", "— 2 —", "2/5", " 2", "II", "Foglio n. 2", "pag. 2."):
        assert S.page_number(s, 2), s
    for s in ("16/12/2020.", "144/2025.", "12", "visto", "2 giorni", "III"):
        assert not S.page_number(s, 2), s


def test_headers_of_two_lines_and_every_third_page(spark):
    body = ["il consiglio approva la graduatoria", "la giunta rinvia ogni decisione", "il dirigente liquida la somma dovuta", "la seduta termina senza altri interventi", "il segretario legge il verbale di ieri", "nessuno chiede la parola sul punto", "si passa al voto per alzata di mano"]
    head = "COMUNE DI ALFA SETTORE TECNICO\nufficio lavori pubblici e manutenzioni\n"
    pages = [(1, n, head + f"{b}\nfine della pagina {b[::-1]}", "ocr") for n, b in enumerate(body[:3], 1)]
    pages += [(2, n, (head if n in (1, 4, 7) else "") + b, "ocr") for n, b in enumerate(body, 1)]
    # a body line that comes again at another place is no header, nor is one behind a line that does not come again
    pages += [(3, 1, "prima riga della prima pagina\nuna riga che torna sempre uguale", "ocr"), (3, 2, "seconda pagina senza testata alcuna\nuna riga che torna sempre uguale\naltro testo in fondo alla pagina", "ocr")]
    p = spark.createDataFrame([(*x, "x") for x in pages], "atto_id long, numero int, testo string, fonte string, parola string")
    a = spark.createDataFrame([], "id long, numero string, oggetto string, testo_estratto string")
    got = {(r["atto_id"], r["numero"], r["riga"]) for r in S.found(p, a).where("difetto = 'intestazione'").collect()}
    assert got == {(1, n, i) for n in (1, 2, 3) for i in (1, 2)} | {(2, n, i) for n in (1, 4, 7) for i in (1, 2)}


def test_short_and_long_words(spark):
    long = "precipitevolissimevolmentescrittosenzaspazinelmezzo"
    a = spark.createDataFrame([(100 + i, None, None, f"la via del mare {long}") for i in range(30)], "id long, numero string, oggetto string, testo_estratto string")
    p = spark.createDataFrame([(1, 1, f"la via de1 mare {long[:10]}0{long[11:]}" if long[10] == "o" else f"la via de1 mare {long.replace('o', '0', 1)}", "ocr")], "atto_id long, numero int, testo string, fonte string")
    assert {r["forma"] for r in S.found(p, a).collect()} == {"del", long}


def test_page_number_in_a_long_line():
    assert S.page_number("pagina      n.        2          di            15", 2) and not S.page_number("pagina 2 " * 10_000, 2)
