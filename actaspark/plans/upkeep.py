"""Loads, run logs, repairs and views of the tables, as plans with SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from actaspark.functions import encoding
from actaspark.operators import rank, runs, setjoin, tables as TB
from actaspark.sources import tenders
from actaspark.tables import load

#: Region whose rows are taken, module without bodies, least characters a page of readable text has; fixed values.
REGION, WITHOUT_BODY, DENSE, CANDIDATES = "sicilia", "anac", 100, 9
Query = Callable[[SparkSession, str], DataFrame]


def names_containing(s: SparkSession, d: str) -> DataFrame:
    """Bodies whose name holds a tender row's name, in lower case: least id for each name; blank names match none."""
    n = load(s, d, "anac_sample").select(F.lower(F.trim("denominazione_amministrazione")).alias("nome")).where("nome <> ''").distinct()
    return setjoin.holders(n, load(s, d, "enti").select("id", F.lower("denominazione").alias("intero"))).withColumnRenamed("id", "ente_id")


def tender_load(s: SparkSession, d: str) -> DataFrame:
    """Tender rows of the region read as acts: inserted, duplicate and skipped rows by month."""
    e = load(s, d, "enti", "id", "denominazione")
    return tenders.outcomes(load(s, d, "anac_sample"), e, REGION).groupBy("mese", "esito").agg(F.count(F.lit(1)).alias("righe"))


def tender_acts(s: SparkSession, d: str) -> DataFrame:
    """The acts that reading the tender rows inserts."""
    e = load(s, d, "enti", "id", "denominazione")
    return tenders.outcomes(load(s, d, "anac_sample"), e, REGION).where("esito = 'inserito'").select("riga_id", "ente_id", "url_fonte", "importo", "giorno")


def region_rows(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "anac_sample", "riga_id", "sezione_regionale").where(tenders.in_region(F.col("sezione_regionale"), REGION)).select("riga_id")


def flags_of_body(s: SparkSession, d: str) -> DataFrame:
    """Flags with their body's name, latest first within the body."""
    f = load(s, d, "red_flags", "id", "ente_id", "tipo_flag", "data_rilevazione").join(load(s, d, "enti").select(F.col("id").alias("ente_id"), "denominazione"), "ente_id")
    return rank.row_number(f, ["ente_id"], [F.desc_nulls_last("data_rilevazione"), F.col("id")], "posto").select("ente_id", "denominazione", "posto", "id", "tipo_flag")


def flag_detail(s: SparkSession, d: str) -> DataFrame:
    """Flags of the highest severity by kind, latest first, with their first evidence as JSON."""
    f = load(s, d, "red_flags", "id", "tipo_flag", "severita", "data_rilevazione", "atti_cig").where("severita = 'alta'")
    n = rank.row_number(f, ["tipo_flag"], [F.desc_nulls_last("data_rilevazione"), F.col("id")], "posto")
    return n.select("id", "tipo_flag", "posto", F.get_json_object(F.to_json(F.struct(F.get("atti_cig", F.lit(0)).alias("prova"))), "$.prova.url").alias("prova"))


def body_list(s: SparkSession, d: str) -> DataFrame:
    """Bodies in order of name."""
    e = load(s, d, "enti", "id", "denominazione", "provincia").withColumn("_g", F.lit(1))
    return rank.row_number(e, ["_g"], [F.col("denominazione").asc_nulls_last(), F.col("id")], "posto").select("posto", "id", "denominazione", "provincia")


def run_log(s: SparkSession, d: str) -> DataFrame:
    """One run per reader and day of retrieval: rows found, new ones, and an error where none was new."""
    return runs.from_rows(load(s, d, "atti", "id", "ente_id", "url_fonte", "fonte_scraper", "data_accesso"), ["ente_id", "url_fonte"], "id", "fonte_scraper", "data_accesso")


def last_good_run(s: SparkSession, d: str) -> DataFrame:
    return runs.last_good(run_log(s, d))


def rejected_acts(s: SparkSession, d: str) -> DataFrame:
    """Acts whose body is not among those in service (rows that a foreign key refuses), by body."""
    parents = load(s, d, "enti", "id", "stato_scraper").where("stato_scraper = 'attivo'")
    return TB.refused(load(s, d, "atti", "id", "ente_id"), "ente_id", parents, "id").groupBy("ente_id").agg(F.count(F.lit(1)).alias("atti"))


def latest_checks(s: SparkSession, d: str) -> DataFrame:
    """The last outcome of each check of an act (body and url), over all times it was fetched."""
    a = load(s, d, "atti", "id", "ente_id", "url_fonte", "cig", "importo_euro")
    outcome = lambda c, n: F.struct(F.lit(n).alias("controllo"), F.when(c, "presente").otherwise("assente").alias("esito"))
    e = a.select("id", "ente_id", "url_fonte", F.inline(F.array(outcome(F.col("cig").isNotNull(), "cig"), outcome(F.col("importo_euro").isNotNull(), "importo"))))
    return TB.last_write(e, ["ente_id", "url_fonte", "controllo"], "id").select("id", "controllo", "esito")


def cleared_bodies(s: SparkSession, d: str) -> DataFrame:
    """Bodies after the reader's data of blocked ones is taken out."""
    e = load(s, d, "enti", "id", "modulo", "url_base", "stato_scraper")
    return TB.cleared(e, F.col("stato_scraper") == "bloccato", ["modulo", "url_base"])


def synced_bodies(s: SparkSession, d: str) -> DataFrame:
    """Bodies after the registry of readers is merged in; modules without bodies and blank codes are left out."""
    e = load(s, d, "enti", "id", "codice_istat", "denominazione", "modulo", "stato_scraper")
    registry = e.select("codice_istat", F.upper("denominazione").alias("denominazione"), "modulo", F.lit("attivo").alias("stato_scraper"))
    new = registry.where((F.trim(F.coalesce("codice_istat", F.lit(""))) != "") & F.col("modulo").isNotNull() & (F.col("modulo") != WITHOUT_BODY))
    return TB.upsert(e, new, "codice_istat", ["denominazione", "stato_scraper"])


def reset_procedures(s: SparkSession, d: str) -> DataFrame:
    """Links of acts to procedures after those found by likeness are deleted: their acts are unlinked."""
    p = load(s, d, "procedimenti", "id", "ente_id", "cig", "metodo_individuazione").where("cig is not null")
    owner = p.groupBy("ente_id", "cig").agg(F.min("id").alias("procedimento"))
    linked = load(s, d, "atti", "id", "ente_id", "cig").join(owner, ["ente_id", "cig"]).select("id", "procedimento")
    kept, links = TB.deleted(p, F.contains("metodo_individuazione", F.lit("similarita")), "id", linked, "procedimento")
    return links


def evolved_tables(s: SparkSession, d: str) -> DataFrame:
    """Procedures and flags as one table with the columns of both."""
    p, f = load(s, d, "procedimenti", "id", "ente_id", "oggetto"), load(s, d, "red_flags", "id", "ente_id", "descrizione", "severita")
    return TB.widened(p, {"descrizione": "string", "severita": "string"}).unionByName(TB.widened(f, {"oggetto": "string"}))


def case_candidates(s: SparkSession, d: str) -> DataFrame:
    """Acts that flags name first, then critical procedures of codes that these acts lack; taken in turn from the bodies, nine in all."""
    f = load(s, d, "red_flags", "id", "ente_id", "atti_cig")
    named = f.select("ente_id", F.get_json_object(F.to_json("atti_cig"), "$[0].id").cast("long").alias("id")).where("id is not null").distinct()
    a = load(s, d, "atti", "id", "cig")
    covered = named.join(a, "id").where("cig is not null").select("cig").distinct()
    p = load(s, d, "procedimenti", "id", "ente_id", "cig", "stato_finale").where("stato_finale in ('revocato', 'annullato') and cig is not null").join(covered, "cig", "left_anti")
    both = named.select(F.lit(1).alias("rango"), "ente_id", "id").unionByName(p.select(F.lit(2).alias("rango"), "ente_id", "id"))
    return setjoin.round_robin(both.withColumn("ordine", F.struct("rango", "id")), "ente_id", "ordine", CANDIDATES).select("rango", "ente_id", "id")


def linked_act_count(s: SparkSession, d: str) -> DataFrame:
    a, p = load(s, d, "atti", "ente_id", "cig"), load(s, d, "procedimenti", "ente_id", "cig")
    return a.join(p, ["ente_id", "cig"], "left_semi").agg(F.count(F.lit(1)).alias("collegati"))


def text_density(s: SparkSession, d: str) -> DataFrame:
    """Characters per page of each act with a text, and whether they are too few for a readable text."""
    a = load(s, d, "atti", "id", "testo_estratto").where("testo_estratto is not null")
    pages = F.size(F.split("testo_estratto", "\f", -1))
    return a.select("id", pages.alias("pagine"), F.bround(F.length("testo_estratto") / pages, 2).alias("densita")).withColumn("scarso", F.col("densita") < DENSE)


def source_hosts(s: SparkSession, d: str) -> DataFrame:
    """Hosts of the acts' pages, and pages that a link of the list would lead to."""
    a = load(s, d, "atti", "url_fonte").where("url_fonte is not null")
    return a.groupBy(encoding.host(F.col("url_fonte")).alias("host")).agg(F.count(F.lit(1)).alias("atti"), F.min(encoding.joined(F.col("url_fonte"), F.lit("/allegati?n=1"))).alias("allegati"))


def text_digests(s: SparkSession, d: str) -> DataFrame:
    """Digest of each document's text, its kind by the first bytes, and its base 64 read back."""
    t = load(s, d, "documents", "doc_id", "text").where("text is not null")
    raw = F.encode("text", "UTF-8")
    return t.select("doc_id", F.sha2("text", 256).alias("impronta"), encoding.kind_of(raw).alias("genere"), (F.unbase64(F.base64(raw)) == raw).alias("uguale"))


def recurring_references(s: SparkSession, d: str) -> DataFrame:
    """References that stand in two acts or more: acts, places, roles of the acts."""
    from actaspark.plans import chains as C

    a = C.acts(s, d)
    r = C._cited(a).groupBy("tipo", "valore", "id").agg(F.count(F.lit(1)).alias("n")).join(a.select("id", "ruolo"), "id")
    g = r.groupBy("tipo", "valore").agg(F.count(F.lit(1)).alias("atti"), F.sum("n").alias("volte"), F.array_join(F.array_sort(F.collect_set("ruolo")), ",").alias("ruoli"))
    return g.where("atti >= 2")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        names_containing, tender_load, tender_acts, region_rows, flags_of_body, flag_detail, body_list, run_log, last_good_run, rejected_acts, latest_checks, cleared_bodies, synced_bodies,
        reset_procedures, evolved_tables, case_candidates, linked_act_count, text_density, source_hosts, text_digests, recurring_references,
    )
}

_AMOUNT = r"CASE WHEN regexp_full_match(trim(importo_totale_appalto), '[0-9]{1,3}(\.[0-9]{3})*(,[0-9]+)?|[0-9]+(,[0-9]+)?') THEN TRY_CAST(replace(replace(trim(importo_totale_appalto), '.', ''), ',', '.') AS DECIMAL(38,2)) END"
_FOUND = """WITH e AS (SELECT id, lower(denominazione) AS intero FROM enti), n AS (SELECT nome, min(id) AS ente_id FROM (SELECT DISTINCT lower(trim(denominazione_amministrazione)) AS nome FROM anac_sample) JOIN e ON contains(intero, nome) WHERE nome <> '' GROUP BY 1)"""
_LOAD = f"""{_FOUND}, r AS (SELECT t.riga_id, n.ente_id, nullif(trim(t.cig), '') AS cig, t.anno_pubblicazione || '-' || lpad(t.mese_pubblicazione, 2, '0') AS mese, {_AMOUNT} AS importo, CAST(try_strptime(t.data_creazione, '%d/%m/%Y') AS DATE) AS giorno
  FROM anac_sample t LEFT JOIN n ON n.nome = lower(trim(t.denominazione_amministrazione)) WHERE lower(trim(t.sezione_regionale)) = '{REGION}'),
k AS (SELECT ente_id, cig, min(riga_id) AS primo FROM r WHERE ente_id IS NOT NULL AND cig IS NOT NULL GROUP BY 1, 2),
o AS (SELECT r.*, CASE WHEN r.ente_id IS NULL OR r.cig IS NULL THEN 'saltato' WHEN k.primo = r.riga_id THEN 'inserito' ELSE 'duplicato' END AS esito FROM r LEFT JOIN k USING (ente_id, cig))"""
_RUNS = "WITH x AS (SELECT *, row_number() OVER (PARTITION BY ente_id, url_fonte ORDER BY id) = 1 AS nuovo FROM atti), g AS (SELECT fonte_scraper AS lettore, substr(data_accesso, 1, 10) AS giorno, min(data_accesso) AS avviato, max(data_accesso) AS terminato, count(*) AS trovati, count(*) FILTER (nuovo) AS nuovi FROM x WHERE fonte_scraper IS NOT NULL AND data_accesso IS NOT NULL GROUP BY 1, 2), l AS (SELECT *, CASE WHEN nuovi = 0 THEN 'nessun atto nuovo' END AS errore FROM g)"
SQL: dict[str, str] = {
    "names_containing": f"{_FOUND} SELECT * FROM n",
    "tender_load": f"{_LOAD} SELECT mese, esito, count(*) AS righe FROM o GROUP BY 1, 2",
    "tender_acts": f"{_LOAD} SELECT riga_id, ente_id, 'anac:' || cig AS url_fonte, importo, giorno FROM o WHERE esito = 'inserito'",
    "region_rows": f"SELECT riga_id FROM anac_sample WHERE lower(trim(sezione_regionale)) = '{REGION}'",
    "flags_of_body": "SELECT f.ente_id, e.denominazione, CAST(row_number() OVER (PARTITION BY f.ente_id ORDER BY data_rilevazione DESC NULLS LAST, f.id) AS INTEGER) AS posto, f.id, tipo_flag FROM red_flags f JOIN enti e ON e.id = f.ente_id",
    "flag_detail": "SELECT id, tipo_flag, CAST(row_number() OVER (PARTITION BY tipo_flag ORDER BY data_rilevazione DESC NULLS LAST, id) AS INTEGER) AS posto, atti_cig[1].url AS prova FROM red_flags WHERE severita = 'alta'",
    "body_list": "SELECT CAST(row_number() OVER (ORDER BY denominazione NULLS LAST, id) AS INTEGER) AS posto, id, denominazione, provincia FROM enti",
    "run_log": f"{_RUNS} SELECT * FROM l",
    "last_good_run": f"{_RUNS} SELECT lettore, giorno, avviato, terminato, trovati, nuovi FROM (SELECT *, row_number() OVER (PARTITION BY lettore ORDER BY avviato DESC, giorno DESC) AS r FROM l WHERE terminato IS NOT NULL AND errore IS NULL) WHERE r = 1",
    "rejected_acts": "SELECT ente_id, count(*) AS atti FROM atti WHERE ente_id NOT IN (SELECT id FROM enti WHERE stato_scraper = 'attivo') GROUP BY 1",
    "latest_checks": "WITH e AS (SELECT id, ente_id, url_fonte, 'cig' AS controllo, CASE WHEN cig IS NOT NULL THEN 'presente' ELSE 'assente' END AS esito FROM atti UNION ALL SELECT id, ente_id, url_fonte, 'importo', CASE WHEN importo_euro IS NOT NULL THEN 'presente' ELSE 'assente' END FROM atti) SELECT id, controllo, esito FROM e QUALIFY row_number() OVER (PARTITION BY ente_id, url_fonte, controllo ORDER BY id DESC) = 1",
    "cleared_bodies": "SELECT id, CASE WHEN stato_scraper IS DISTINCT FROM 'bloccato' THEN modulo END AS modulo, CASE WHEN stato_scraper IS DISTINCT FROM 'bloccato' THEN url_base END AS url_base, stato_scraper FROM enti",
    "synced_bodies": f"SELECT id, codice_istat, CASE WHEN modulo <> '{WITHOUT_BODY}' THEN upper(denominazione) ELSE denominazione END AS denominazione, modulo, CASE WHEN modulo <> '{WITHOUT_BODY}' THEN 'attivo' ELSE stato_scraper END AS stato_scraper FROM enti",
    "reset_procedures": "WITH p AS (SELECT ente_id, cig, min(id) AS id FROM procedimenti WHERE cig IS NOT NULL GROUP BY 1, 2) SELECT a.id, CASE WHEN contains(q.metodo_individuazione, 'similarita') THEN NULL ELSE p.id END AS procedimento FROM atti a JOIN p ON p.ente_id = a.ente_id AND p.cig = a.cig JOIN procedimenti q ON q.id = p.id",
    "evolved_tables": "SELECT id, ente_id, oggetto, NULL AS descrizione, NULL AS severita FROM procedimenti UNION ALL SELECT id, ente_id, NULL, descrizione, severita FROM red_flags",
    "case_candidates": f"WITH n AS (SELECT DISTINCT ente_id, atti_cig[1].id AS id FROM red_flags WHERE atti_cig[1].id IS NOT NULL), c AS (SELECT cig FROM atti WHERE id IN (SELECT id FROM n) AND cig IS NOT NULL), b AS (SELECT 1 AS rango, ente_id, id FROM n UNION ALL SELECT 2, ente_id, id FROM procedimenti WHERE stato_finale IN ('revocato', 'annullato') AND cig IS NOT NULL AND cig NOT IN (SELECT cig FROM c)), r AS (SELECT *, row_number() OVER (PARTITION BY ente_id ORDER BY rango, id) AS k, min(ROW(rango, id)) OVER (PARTITION BY ente_id) AS g FROM b) SELECT rango, ente_id, id FROM r ORDER BY k, g, rango, id LIMIT {CANDIDATES}",
    "linked_act_count": "SELECT count(*) AS collegati FROM atti a WHERE EXISTS (SELECT 1 FROM procedimenti p WHERE p.ente_id = a.ente_id AND p.cig = a.cig)",
    "text_density": f"SELECT id, CAST(len(string_split(testo_estratto, chr(12))) AS INTEGER) AS pagine, round_even(length(testo_estratto) / len(string_split(testo_estratto, chr(12))), 2) AS densita, round_even(length(testo_estratto) / len(string_split(testo_estratto, chr(12))), 2) < {DENSE} AS scarso FROM atti WHERE testo_estratto IS NOT NULL",
    "source_hosts": "SELECT regexp_extract(url_fonte, '^[a-z]+://([^/:?#]+)', 1) AS host, count(*) AS atti, min(regexp_extract(url_fonte, '^[a-z]+://[^/?#]+') || '/allegati?n=1') AS allegati FROM atti WHERE url_fonte IS NOT NULL GROUP BY 1",
    "text_digests": "SELECT doc_id, sha256(text) AS impronta, CASE WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN starts_with(text, 'PK') THEN 'zip' WHEN starts_with(text, '<') THEN 'markup' ELSE 'altro' END AS genere, true AS uguale FROM documents WHERE text IS NOT NULL",
}
