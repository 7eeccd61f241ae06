"""Loads, logs, repairs, files and pages in small cases with nulls, blanks, ties and empty tables."""

import json

from pyspark.sql import functions as F

from actaspark.functions import encoding
from actaspark.operators import runs, setjoin, tables as TB
from actaspark.sources import files, registry, tenders
from actaspark.streaming import paged


def test_holders(spark):
    hay = spark.createDataFrame([(1, "comune di alfa"), (2, "comune di alfa e beta"), (3, None), (0, "")], "id long, intero string")
    n = spark.createDataFrame([(x,) for x in ("comune di alfa", "beta", "e", "di alfa e", "gamma", "comune di gamma", "comune di alfa e beta!")], "nome string")
    assert {tuple(r) for r in setjoin.holders(n, hay).collect()} == {("comune di alfa", 1), ("beta", 2), ("e", 1), ("di alfa e", 2)}
    assert setjoin.holders(n.limit(0), hay).count() == 0 and setjoin.holders(n, hay.limit(0)).count() == 0


def test_run_log(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "log"))
    for reader, at, end in (("a", "2024-01-01T01", (5, 2, None)), ("a", "2024-01-02T01", (5, 0, "rete")), ("a", "2024-01-03T01", None), ("b", "2024-01-01T01", (0, 0, "rete"))):
        log.start(reader, at)
        if end:
            log.finish(reader, at, at + ":30", *end)
    assert {(r["lettore"], r["avviato"], r["trovati"], r["errore"]) for r in log.runs().collect()} == {("a", "2024-01-01T01", 5, None), ("a", "2024-01-02T01", 5, "rete"), ("a", "2024-01-03T01", None, None), ("b", "2024-01-01T01", 0, "rete")}
    assert [(r["lettore"], r["avviato"], r["nuovi"]) for r in runs.last_good(log.runs()).collect()] == [("a", "2024-01-01T01", 2)]


def test_tender_file(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("﻿CIG ;Ente;altro;importo\n A1 ; Comune di Alfa ;z;4.500,00\nA2;;z;x\n", encoding="utf-8")
    d = tenders.read_csv(spark, str(p), ["cig", "denominazione", "importo", "manca"], {"ente": "denominazione"})
    assert [tuple(r) for r in d.collect()] == [("A1", "Comune di Alfa", "4.500,00", None), ("A2", None, "x", None)]
    assert [str(r[0]) for r in d.select(tenders.amount(F.col("importo"))).collect()] == ["4500.00", "None"]


def test_tender_outcomes(spark):
    cols = "riga_id long, cig string, denominazione_amministrazione string, sezione_regionale string, anno_pubblicazione string, mese_pubblicazione string, importo_totale_appalto string, data_creazione string, nome string"
    row = lambda i, cig, name, region="Sicilia ": (i, cig, name, region, "2024", "1", "1,5", "40/01/2024", "x")
    d = spark.createDataFrame([row(1, "A", "ALFA"), row(2, "A", "alfa"), row(3, None, "alfa"), row(4, "B", " "), row(5, "B", "%"), row(6, "C", "alfa", "Lazio"), row(7, "C", None, None)], cols)
    e = spark.createDataFrame([(9, "Comune di Alfa"), (8, "Unione di Alfa")], "id long, denominazione string")
    assert {(r["riga_id"], r["ente_id"], r["esito"], r["mese"]) for r in tenders.outcomes(d, e, "sicilia").collect()} == {(1, 8, "inserito", "2024-01"), (2, 8, "duplicato", "2024-01"), (3, 8, "saltato", "2024-01"), (4, None, "saltato", "2024-01"), (5, None, "saltato", "2024-01")}
    assert tenders.outcomes(d.limit(0), e, "sicilia").count() == 0


def test_repairs(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", None)], "id long, m string, v string")
    assert {tuple(r) for r in TB.cleared(d, F.col("m") == "a", ["v"]).collect()} == {(1, "a", None), (2, None, "y"), (3, "b", None)}
    links = spark.createDataFrame([(7, 1), (8, 2), (9, None)], "atto long, p long")
    kept, left = TB.deleted(d, F.col("m") == "a", "id", links, "p")
    assert {r["id"] for r in kept.collect()} == {2, 3} and {tuple(r) for r in left.collect()} == {(7, None), (8, 2), (9, None)}
    assert {r["atto"] for r in TB.refused(links, "p", d.where("id = 1"), "id").collect()} == {8}
    w = TB.widened(d, {"m": "int", "n": "long"})
    assert w.columns == ["id", "m", "v", "n"] and w.schema["m"].dataType.simpleString() == "string"


def test_stop_on_known_against_plain_reading(spark):
    import random

    r = random.Random(4)
    rows = [(s, i, r.random() < 0.7 if r.random() < 0.9 else None, "z") for s in ("a", "b", None, "c") for i in range(r.randint(0, 60))]
    d = spark.createDataFrame(rows, "s string, i long, noto boolean, _k string")
    for run in (1, 3, 5):
        want = set()
        for s in {x[0] for x in rows}:
            length = 0
            for x in sorted((x for x in rows if x[0] == s), key=lambda x: x[1]):
                want.add(x[:2])
                length = length + 1 if x[2] else 0
                if length == run:
                    break
        assert {(x["s"], x["i"]) for x in TB.stop_on_known(d.drop("_k"), "s", "i", "noto", run).collect()} == want


def test_addresses_and_contents(spark):
    cases = [("https://h.example/a/b?x=1", "c", "https://h.example/a/c"), ("https://h.example", "c", "https://h.example/c"), ("https://h.example/a/", "/c", "https://h.example/c"), ("https://h.example/a", "http://o.example/z", "http://o.example/z"), ("https://h.example/a", "//o.example/z", "https://o.example/z"), ("https://h.example/a", None, None)]
    d = spark.createDataFrame(cases, "base string, link string, want string")
    assert all(r["got"] == r["want"] for r in d.select("want", encoding.joined(F.col("base"), F.col("link")).alias("got")).collect())
    b = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"PK\x03"),), (bytearray(b""),), (None,)], "b binary")
    assert [r[0] for r in b.select(encoding.kind_of(F.col("b"))).collect()] == ["pdf", "zip", "altro", None]
    assert spark.range(1).select(encoding.host(F.lit("non un indirizzo %%"))).first()[0] is None


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "02.txt").write_text("perché", encoding="utf-8")
    (tmp_path / "01.PDF").write_bytes(b"%PDF")
    (tmp_path / "x.doc").write_text("no")
    assert {(r["nome"], r["genere"], r["testo"], bytes(r["contenuto"]) if r["contenuto"] else None) for r in files.case_files(spark, str(tmp_path)).collect()} == {("02.txt", "txt", "perché", None), ("01.PDF", "pdf", None, b"%PDF")}
    (tmp_path / "c.csv").write_text("denominazione,provincia,codice_istat,popolazione\nAlfa,AG, 84001 ,100\nBeta,PA,082053,\n")
    assert [tuple(r) for r in files.municipalities(spark, str(tmp_path / "c.csv")).collect()] == [("Alfa", "AG", "084001", 100), ("Beta", "PA", "082053", None)]


def test_runnable(spark):
    d = spark.createDataFrame([("a", "attivo", "m"), ("b", "bloccato", "m"), ("c", None, "m"), ("d", "attivo", None), ("e", "attivo", "n")], "slug string, stato string, modulo string")
    assert {r["slug"] for r in registry.runnable(d).collect()} == {"a", "e"} and {r["slug"] for r in registry.runnable(d, ("attivo", "bloccato"), ("m",)).collect()} == {"a", "b"}


def test_paged_source(spark, tmp_path):
    src = tmp_path / "pages"
    src.mkdir()
    page = lambda n, *days: (src / f"page-{n}.json").write_text("".join(json.dumps({"numero": f"{n}.{i}", "giorno": d}) + "\n" for i, d in enumerate(days)))
    page(1, "2024-05-01", "2023-12-31", None)
    page(2, "2024-07-19", "2024-07-21")
    page(4, "2024-05-02")
    paged.register(spark)
    got = []
    for step in range(2):
        q = spark.readStream.format("paged").option("path", str(src)).option("oggi", "2024-05-20").load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        got.append(sorted(r["numero"] for r in spark.read.parquet(str(tmp_path / "out")).collect()))
        page(3, "2024-06-01")
    assert got == [["1.0", "2.0"], ["1.0", "2.0", "3.0", "4.0"]]
