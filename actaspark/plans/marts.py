"""Relational queries over bodies, acts, procedures and flags, each a declarative plan; SQL states the same for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from actaspark.functions import text as X
from actaspark.operators import rank, setjoin, tables as TB
from actaspark.plans import chains as C
from actaspark.storage import materialise, spread
from actaspark.tables import load

#: Bodies of fewer inhabitants are masked; rows of a top list; fixed values.
SMALL, TOP, LIMIT = 5_000, 5, 20
Query = Callable[[SparkSession, str], DataFrame]
_DAY = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({0} AS DATE) END"
_EVENT = f"coalesce({_DAY.format('data_atto')}, {_DAY.format('data_pub')})"


#: Characters by which subjects and descriptions meet.
HEAD = 8
#: Trigram Jaccard of like titles, and from which contradictory titles are twins; fixed values of E08.
ALIKE, TWINS = 0.35, 0.75


def _acts(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Acts with ``giorno``, the day they count from."""
    a = load(s, d, "atti", *{*columns, "id", "ente_id", "data_atto", "data_pub"})
    return a.withColumn("giorno", X.event_date(F.col("data_atto"), F.col("data_pub")))


def global_counts(s: SparkSession, d: str) -> DataFrame:
    each = lambda t: load(s, d, t).select(F.lit(t).alias("t"))
    all_ = each("enti").unionByName(each("atti")).unionByName(each("red_flags"))
    return all_.agg(*[F.count_if(F.col("t") == t).alias(c) for t, c in (("enti", "enti"), ("atti", "atti"), ("red_flags", "segnali"))])


def acts_by_body(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "atti", "ente_id").groupBy("ente_id").agg(F.count(F.lit(1)).alias("atti"))


def act_order(s: SparkSession, d: str) -> DataFrame:
    """The place of each act among its body's, latest first; acts without a date come last."""
    a = load(s, d, "atti", "id", "ente_id", "data_atto", "data_accesso").join(load(s, d, "enti").select(F.col("id").alias("ente_id")), "ente_id")
    order = [F.col("data_atto").desc_nulls_last(), F.col("data_accesso").desc_nulls_last(), F.col("id")]
    return rank.row_number(a, ["ente_id"], order, "posto").select("ente_id", "id", "posto")


def flag_overview(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "red_flags", "id", "ente_id", "severita")
    n = f.groupBy("ente_id").agg(F.count("id").alias("segnali"), *[F.count_if(F.col("severita") == x).alias(x) for x in ("alta", "media", "bassa")])
    e = load(s, d, "enti", "id", "denominazione")
    return e.join(n, e["id"] == n["ente_id"], "left").select("id", "denominazione", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("segnali", "alta", "media", "bassa")])


def unflagged_bodies(s: SparkSession, d: str) -> DataFrame:
    e, f = load(s, d, "enti", "id", "denominazione"), load(s, d, "red_flags", "ente_id")
    return e.join(f, e["id"] == f["ente_id"], "left_anti")


def masked_flags(s: SparkSession, d: str) -> DataFrame:
    f, e = load(s, d, "red_flags"), load(s, d, "enti", "id", "popolazione").withColumnRenamed("id", "e")
    small = F.col("popolazione").isNotNull() & (F.col("popolazione") < SMALL)
    j = f.join(e, f["ente_id"] == e["e"])
    return j.select("id", "ente_id", "tipo_flag", F.when(~small, F.col("descrizione")).alias("descrizione"), F.when(~small, F.size("atti_cig")).alias("prove"))


def flag_evidence(s: SparkSession, d: str) -> DataFrame:
    """Each piece of evidence of a flag with the act it names, n/d where there is none."""
    f = load(s, d, "red_flags").select(F.col("id").alias("flag_id"), F.posexplode("atti_cig").alias("posto", "prova"))
    a = load(s, d, "atti", "id", "oggetto")
    j = f.join(a, f["prova.id"] == a["id"], "left")
    return j.select("flag_id", "posto", F.col("prova.id").alias("atto_id"), F.coalesce("oggetto", F.lit("n/d")).alias("oggetto"))


def procedure_overview(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "procedimenti", "id", "ente_id", "cig", "data_avvio")
    a = load(s, d, "atti", "ente_id", "cig").where("cig is not null").groupBy("ente_id", "cig").agg(F.count(F.lit(1)).alias("n"))
    return p.join(a, ["ente_id", "cig"], "left").select("id", "ente_id", "data_avvio", F.coalesce("n", F.lit(0)).alias("atti"))


def act_timeline(s: SparkSession, d: str) -> DataFrame:
    a = _acts(s, d, "cig").where("cig is not null and cig <> ''")
    n = materialise(rank.row_number(a.select("cig", "id", "giorno"), ["cig"], [F.col("giorno").asc_nulls_last(), F.col("id")], "posto"), "timeline")
    before = n.select("cig", (F.col("posto") + 1).alias("posto"), F.col("giorno").alias("ieri"))
    return n.join(before, ["cig", "posto"], "left").select("cig", "id", "giorno", "posto", F.datediff("giorno", "ieri").alias("giorni"))


def coverage(s: SparkSession, d: str) -> DataFrame:
    a = load(s, d, "atti", "ente_id", "data_pub", "data_atto").withColumn("g", F.coalesce("data_pub", "data_atto"))
    return a.groupBy("ente_id").agg(F.min("g").alias("dal"), F.max("g").alias("al"), F.count(F.lit(1)).alias("atti"), F.substring(F.min(F.coalesce("data_atto", "data_pub")), 1, 4).alias("anno"))


def null_rates(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "procedimenti")
    return p.agg(F.count(F.lit(1)).alias("righe"), *[F.count_if(F.col(c).isNull()).alias(c) for c in ("data_avvio", "data_chiusura", "cig")])


def closed_with_acts(s: SparkSession, d: str) -> DataFrame:
    """Procedures in two final states that have an act (semi join)."""
    p = load(s, d, "procedimenti", "id", "ente_id", "cig", "stato_finale").where(F.col("stato_finale").isin("revocato", "annullato"))
    return p.join(load(s, d, "atti", "ente_id", "cig"), ["ente_id", "cig"], "left_semi").select("id", "ente_id", "stato_finale")


def flags_with_source(s: SparkSession, d: str) -> DataFrame:
    """Flags of bodies that one reader serves (EXISTS)."""
    f = load(s, d, "red_flags", "id", "ente_id", "tipo_flag")
    return f.join(load(s, d, "atti", "ente_id", "fonte_scraper").where("fonte_scraper = 'jcitygov'"), "ente_id", "left_semi")


def round_robin_procedures(s: SparkSession, d: str) -> DataFrame:
    return setjoin.round_robin(load(s, d, "procedimenti", "id", "ente_id", "stato_finale").where("stato_finale = 'revocato'"), "ente_id", "id", LIMIT).select("id", "ente_id")


def candidate_union(s: SparkSession, d: str) -> DataFrame:
    """Union with priority: bodies by flags first, then bodies by procedures that the first do not cover."""
    first = load(s, d, "red_flags", "ente_id").distinct().withColumn("da", F.lit("segnale"))
    second = load(s, d, "procedimenti", "ente_id", "stato_finale").where("stato_finale in ('revocato', 'annullato')").select("ente_id").distinct()
    return first.unionByName(second.join(first, "ente_id", "left_anti").withColumn("da", F.lit("procedimento")))


def distinct_codes(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "atti", "cig").where("cig is not null and cig <> ''").distinct()


def latest_delivery(s: SparkSession, d: str) -> DataFrame:
    """The last file of each feed (top one per group)."""
    return load(s, d, "anac_file").groupBy("flusso").agg(F.max_by("file_id", F.struct("caricato_il", "file_id")).alias("file_id"), F.max("caricato_il").alias("caricato_il"))


def flags_naming_subject(s: SparkSession, d: str) -> DataFrame:
    """Procedures and flags of one body where the first 60 characters of the subject stand in the flag's description.

    A pair meets by the hash of the subject's first eight characters (all, if it has fewer), which stand somewhere in the description.
    """
    p = load(s, d, "procedimenti").select(F.col("id").alias("procedimento_id"), "ente_id", F.substring("oggetto", 1, 60).alias("inizio")).where("inizio <> ''")
    f = load(s, d, "red_flags").select(F.col("id").alias("flag_id"), "ente_id", "descrizione").where("descrizione is not null")
    p = p.withColumn("n", F.least(F.length("inizio"), F.lit(HEAD))).withColumn("k", F.xxhash64(F.substring("inizio", 1, HEAD)))
    short = [r["n"] for r in p.where(F.col("n") < HEAD).select("n").distinct().collect()]  # fewer than HEAD values
    runs = F.flatten(F.array(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("descrizione") - n + 1, F.lit(1))), lambda i, n=n: F.struct(F.lit(n).alias("n"), F.xxhash64(F.substring("descrizione", i, F.lit(n))).alias("k"))) for n in sorted({HEAD, *short})]))
    f = f.select("flag_id", "ente_id", "descrizione", F.inline(F.array_distinct(runs)))
    return p.join(f, ["ente_id", "n", "k"]).where(F.contains("descrizione", F.col("inizio"))).select("procedimento_id", "flag_id")


def share_by_year(s: SparkSession, d: str) -> DataFrame:
    """Per body and year: acts, and those that are no tender; at least ten acts, more than four fifths."""
    a = _acts(s, d, "tipo").where("giorno is not null").groupBy("ente_id", F.year("giorno").alias("anno"))
    g = a.agg(F.count(F.lit(1)).alias("atti"), F.count_if(F.lower("tipo") != "bando").alias("diretti"))
    return g.where((F.col("atti") >= 10) & (F.col("diretti") * 5 > F.col("atti") * 4)).withColumn("quota", F.bround(F.col("diretti") / F.col("atti"), 4))


def share_samples(s: SparkSession, d: str) -> DataFrame:
    """The five latest acts that are no tender of each body and year (top k per group)."""
    a = _acts(s, d, "tipo").where("giorno is not null and lower(tipo) <> 'bando'").withColumn("anno", F.year("giorno"))
    return rank.top(a.select("ente_id", "anno", "giorno", "id"), ["ente_id", "anno"], [F.desc("giorno"), F.col("id")], TOP, "posto").select("ente_id", "anno", "posto", "id")


def windows_90d(s: SparkSession, d: str) -> DataFrame:
    """Runs of three or more acts under an amount within 90 days that exceed it together; one row per body and first day."""
    a = _acts(s, d, "importo_euro").where("giorno is not null and importo_euro > 0 and importo_euro < 140000")
    day = a.groupBy("ente_id", "giorno").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("importo_euro").cast("decimal(18,2)")).alias("v"))  # pre-aggregated, so a frame holds days
    w = Window.partitionBy("ente_id").orderBy(F.datediff("giorno", F.lit("1970-01-01"))).rangeBetween(0, 90)
    r = day.select("ente_id", F.col("giorno").alias("dal"), F.max("giorno").over(w).alias("al"), F.sum("k").over(w).alias("n"), F.sum("v").over(w).cast("decimal(28,2)").alias("totale"))
    return r.where("n >= 3 and totale > 140000")


def short_intervals(s: SparkSession, d: str) -> DataFrame:
    """Tenders published for fewer days than their amount asks for."""
    a = load(s, d, "atti", "id", "tipo", "data_pub", "data_scadenza", "importo_euro").where("lower(tipo) = 'bando'")
    a = a.withColumn("giorni", F.datediff(X.iso_date(F.col("data_scadenza")), X.iso_date(F.col("data_pub"))))
    return a.where(F.col("giorni").between(0, F.when(F.col("importo_euro") >= 215000, 29).otherwise(14))).select("id", "giorni")


def role_classification(s: SparkSession, d: str) -> DataFrame:
    a = spread(load(s, d, "atti", "id", "tipo", "oggetto", "testo_estratto"))
    return a.select("id", X.role(F.col("oggetto"), F.col("tipo"), F.col("testo_estratto")).alias("ruolo"))


def extract_codes(s: SparkSession, d: str) -> DataFrame:
    """Labelled tender codes in texts, one row per act and code."""
    a = load(s, d, "atti", "id", "testo_estratto").where("testo_estratto is not null")
    return a.select("id", F.explode(F.array_distinct(F.regexp_extract_all("testo_estratto", F.lit(r"CIG[ :.\-]*([A-Z0-9]{10})([^A-Z0-9]|$)"), 1))).alias("codice"))


def extract_dates(s: SparkSession, d: str) -> DataFrame:
    """Numeric dates in texts that are in the calendar: their number, first and last."""
    a = load(s, d, "atti", "id", "testo_estratto").where("testo_estratto is not null")
    found = F.regexp_extract_all("testo_estratto", F.lit(r"([0-9]{2}/[0-9]{2}/[0-9]{4})"), 1)
    e = a.select("id", F.explode(found).alias("t")).withColumn("g", F.try_to_date("t", "dd/MM/yyyy")).where("g is not null")
    return e.groupBy("id").agg(F.count(F.lit(1)).alias("date"), F.min("g").alias("prima"), F.max("g").alias("ultima"))


def extract_amounts(s: SparkSession, d: str) -> DataFrame:
    """Amounts with the euro sign before them: number and largest."""
    a = spread(load(s, d, "atti", "id", "testo_estratto").where("testo_estratto is not null"))
    e = a.select("id", F.explode(F.regexp_extract_all("testo_estratto", F.lit(r"€ ?([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})"), 1)).alias("t"))
    return e.groupBy("id").agg(F.count(F.lit(1)).alias("importi"), F.max(X.italian_amount(F.col("t"))).cast("decimal(18,2)").alias("massimo"))


def insert_outcomes(s: SparkSession, d: str) -> DataFrame:
    """Reading the acts into an empty table: rows inserted and duplicates by reader."""
    a = load(s, d, "atti", "id", "ente_id", "url_fonte", "fonte_scraper")
    return TB.insert_new(a.limit(0), a, ["ente_id", "url_fonte"], "id").groupBy("fonte_scraper", "esito").agg(F.count(F.lit(1)).alias("righe"))


def first_writes(s: SparkSession, d: str) -> DataFrame:
    return TB.first_write(load(s, d, "atti", "id", "ente_id", "url_fonte"), ["ente_id", "url_fonte"], "id")


def upserted_bodies(s: SparkSession, d: str) -> DataFrame:
    """Bodies after a delivery that renames every third one and knows no web sites."""
    e = load(s, d, "enti", "id", "codice_istat", "denominazione", "provincia", "popolazione", "sito_web")
    new = e.where("id % 3 = 0").select("codice_istat", F.upper("denominazione").alias("denominazione"), F.lit("QZ").alias("provincia"), F.lit(None).cast("string").alias("sito_web"))
    return TB.upsert(e, new, "codice_istat", ["denominazione"])


def replaced_flags(s: SparkSession, d: str) -> DataFrame:
    f = load(s, d, "red_flags", "id", "ente_id", "tipo_flag", "periodo_da", "periodo_a")
    return TB.last_write(f, ["ente_id", "tipo_flag", F.coalesce("periodo_da", F.lit("")), F.coalesce("periodo_a", F.lit(""))], "id").select("id")


def read_until_known(s: SparkSession, d: str) -> DataFrame:
    """Rows seen per body by a reader that stops after three rows in a row whose url an earlier row has."""
    a = load(s, d, "atti", "id", "ente_id", "url_fonte")
    first = TB.first_write(a, ["ente_id", "url_fonte"], "id").select(F.col("id").alias("primo"))
    a = a.join(first, a["id"] == first["primo"], "left").withColumn("noto", F.col("primo").isNull())
    return TB.stop_on_known(a, "ente_id", "id", "noto", 3).groupBy("ente_id").agg(F.count(F.lit(1)).alias("viste"), F.max("id").alias("ultima"))


def title_classes(s: SparkSession, d: str) -> DataFrame:
    """Every act with the class of its title's word set and the number of acts of its body with a word Jaccard of 0.8 or more."""
    a = load(s, d, "atti", "id", "ente_id", "oggetto")
    return setjoin.linked(a, "ente_id", "id", X.token_set(F.col("oggetto")), 0.8)


def title_containment(s: SparkSession, d: str) -> DataFrame:
    """Titles of a body whose last words (five, or half of them) stand in another title: contained titles with the number of titles that hold them.

    Distinct titles only. Holders are counted by the hash of each run of words before they meet a title's end, so no pairs are formed.
    """
    t = load(s, d, "atti", "ente_id", "oggetto").where("oggetto is not null").distinct().withColumn("w", X.tokens(F.col("oggetto")))
    t = materialise(t, "titles")
    holders = C.runs(t, ["ente_id"], C.longest_tail(t)).groupBy("ente_id", "chiave").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return C.tails(t).join(holders, ["ente_id", "chiave"]).select("ente_id", F.col("oggetto").alias("contenuto"), (F.col("n") - 1).alias("contenitori"))


def title_stars(a: DataFrame) -> DataFrame:
    """(id, ente_id, capo): acts (id, ente_id, oggetto, giorno) of a body grouped under the first, by day, with a like title.

    Titles are alike from a trigram Jaccard of ALIKE on; from TWINS on only if they do not contradict each other. Titles of the same words in order are one node.
    """
    a = a.where("oggetto is not null").withColumn("parole", F.array_join(X.tokens(F.col("oggetto")), " "))
    c = materialise(setjoin.classes(a, "ente_id", "id", X.trigrams(F.col("oggetto"))).join(a.select("id", "parole", "giorno"), "id"), "trigrams")
    place = F.struct(F.col("giorno").isNull().alias("n"), "giorno", "id")
    node = materialise(c.groupBy("ente_id", "classe", "parole").agg(F.min(place).alias("posto")).withColumn("nodo", F.col("posto.id")), "nodes")
    pairs = setjoin.jaccard_pairs(c, "ente_id", ALIKE)
    side = lambda s_: node.select("ente_id", F.col("classe").alias(f"classe_{s_}"), F.col("nodo").alias(s_), F.split("parole", " ").alias(f"w{s_}"))
    e = pairs.join(side("a"), ["ente_id", "classe_a"]).join(side("b"), ["ente_id", "classe_b"])
    e = e.where((F.col("a") != F.col("b")) & ((F.col("somiglianza") < TWINS) | ~X.contradictory(F.col("wa"), F.col("wb")))).select("a", "b")
    lead = setjoin.greedy_leaders(e, node.select("nodo", "posto"))
    return c.join(node.select("ente_id", "classe", "parole", "nodo"), ["ente_id", "classe", "parole"]).join(lead, "nodo").select("id", "ente_id", "capo")


def fuzzy_clusters(s: SparkSession, d: str) -> DataFrame:
    """Every act with a title under the first act of its group (E08); acts that codes or references link are not left out."""
    return title_stars(_acts(s, d, "oggetto"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        global_counts, acts_by_body, act_order, flag_overview, unflagged_bodies, masked_flags, flag_evidence, procedure_overview, act_timeline, coverage, null_rates, closed_with_acts, flags_with_source,
        round_robin_procedures, candidate_union, distinct_codes, latest_delivery, flags_naming_subject, share_by_year, share_samples, windows_90d, short_intervals, role_classification,
        extract_codes, extract_dates, extract_amounts, insert_outcomes, first_writes, upserted_bodies, replaced_flags, read_until_known, title_classes,
        title_containment, fuzzy_clusters,
    )
}
_STOPLIST = ", ".join(f"'{w}'" for w in X.STOP)
_TOKENS = r"list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND NOT list_contains([" + _STOPLIST + "], w))"
_A = f"(SELECT *, {_EVENT} AS giorno FROM atti)"
SQL: dict[str, str] = {
    "global_counts": "SELECT (SELECT count(*) FROM enti) AS enti, (SELECT count(*) FROM atti) AS atti, (SELECT count(*) FROM red_flags) AS segnali",
    "acts_by_body": "SELECT ente_id, count(*) AS atti FROM atti GROUP BY 1",
    "act_order": "SELECT a.ente_id, a.id, CAST(row_number() OVER (PARTITION BY a.ente_id ORDER BY a.data_atto DESC NULLS LAST, a.data_accesso DESC NULLS LAST, a.id) AS INTEGER) AS posto FROM atti a JOIN enti e ON e.id = a.ente_id",
    "flag_overview": "SELECT e.id, e.denominazione, count(f.id) AS segnali, count(*) FILTER (f.severita = 'alta') AS alta, count(*) FILTER (f.severita = 'media') AS media, count(*) FILTER (f.severita = 'bassa') AS bassa FROM enti e LEFT JOIN red_flags f ON f.ente_id = e.id GROUP BY 1, 2",
    "unflagged_bodies": "SELECT id, denominazione FROM enti WHERE NOT EXISTS (SELECT 1 FROM red_flags f WHERE f.ente_id = enti.id)",
    "masked_flags": f"SELECT f.id, f.ente_id, f.tipo_flag, CASE WHEN NOT (e.popolazione IS NOT NULL AND e.popolazione < {SMALL}) THEN f.descrizione END AS descrizione, CAST(CASE WHEN NOT (e.popolazione IS NOT NULL AND e.popolazione < {SMALL}) THEN len(f.atti_cig) END AS INTEGER) AS prove FROM red_flags f JOIN enti e ON e.id = f.ente_id",
    "flag_evidence": "SELECT x.flag_id, CAST(x.posto - 1 AS INTEGER) AS posto, x.p.id AS atto_id, coalesce(a.oggetto, 'n/d') AS oggetto FROM (SELECT id AS flag_id, generate_subscripts(atti_cig, 1) AS posto, unnest(atti_cig) AS p FROM red_flags) x LEFT JOIN atti a ON a.id = x.p.id",
    "procedure_overview": "SELECT p.id, p.ente_id, p.data_avvio, count(a.id) AS atti FROM procedimenti p LEFT JOIN atti a ON a.ente_id = p.ente_id AND a.cig = p.cig GROUP BY 1, 2, 3",
    "act_timeline": f"SELECT cig, id, giorno, CAST(row_number() OVER w AS INTEGER) AS posto, CAST(giorno - lag(giorno) OVER w AS INTEGER) AS giorni FROM {_A} WHERE cig IS NOT NULL AND cig <> '' WINDOW w AS (PARTITION BY cig ORDER BY giorno ASC NULLS LAST, id)",
    "coverage": "SELECT ente_id, min(coalesce(data_pub, data_atto)) AS dal, max(coalesce(data_pub, data_atto)) AS al, count(*) AS atti, substr(min(coalesce(data_atto, data_pub)), 1, 4) AS anno FROM atti GROUP BY 1",
    "null_rates": "SELECT count(*) AS righe, count(*) FILTER (data_avvio IS NULL) AS data_avvio, count(*) FILTER (data_chiusura IS NULL) AS data_chiusura, count(*) FILTER (cig IS NULL) AS cig FROM procedimenti",
    "closed_with_acts": "SELECT id, ente_id, stato_finale FROM procedimenti p WHERE stato_finale IN ('revocato', 'annullato') AND EXISTS (SELECT 1 FROM atti a WHERE a.ente_id = p.ente_id AND a.cig = p.cig)",
    "flags_with_source": "SELECT id, ente_id, tipo_flag FROM red_flags f WHERE EXISTS (SELECT 1 FROM atti a WHERE a.ente_id = f.ente_id AND a.fonte_scraper = 'jcitygov')",
    "round_robin_procedures": f"SELECT id, ente_id FROM (SELECT id, ente_id, row_number() OVER (PARTITION BY ente_id ORDER BY id) AS r, min(id) OVER (PARTITION BY ente_id) AS g FROM procedimenti WHERE stato_finale = 'revocato') ORDER BY r, g, id LIMIT {LIMIT}",
    "candidate_union": "SELECT DISTINCT ente_id, 'segnale' AS da FROM red_flags UNION ALL SELECT DISTINCT ente_id, 'procedimento' FROM procedimenti WHERE stato_finale IN ('revocato', 'annullato') AND ente_id NOT IN (SELECT ente_id FROM red_flags)",
    "distinct_codes": "SELECT DISTINCT cig FROM atti WHERE cig IS NOT NULL AND cig <> ''",
    "latest_delivery": "SELECT flusso, file_id, caricato_il FROM (SELECT *, row_number() OVER (PARTITION BY flusso ORDER BY caricato_il DESC, file_id DESC) AS r FROM anac_file) WHERE r = 1",
    "flags_naming_subject": "SELECT p.id AS procedimento_id, f.id AS flag_id FROM procedimenti p JOIN red_flags f ON f.ente_id = p.ente_id AND p.oggetto <> '' AND contains(f.descrizione, substr(p.oggetto, 1, 60))",
    "share_by_year": f"SELECT ente_id, CAST(year(giorno) AS INTEGER) AS anno, count(*) AS atti, count(*) FILTER (lower(tipo) <> 'bando') AS diretti, round_even(count(*) FILTER (lower(tipo) <> 'bando') / count(*), 4) AS quota FROM {_A} WHERE giorno IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (lower(tipo) <> 'bando') * 5 > count(*) * 4",
    "share_samples": f"SELECT * FROM (SELECT ente_id, CAST(year(giorno) AS INTEGER) AS anno, CAST(row_number() OVER (PARTITION BY ente_id, year(giorno) ORDER BY giorno DESC, id) AS INTEGER) AS posto, id FROM {_A} WHERE giorno IS NOT NULL AND lower(tipo) <> 'bando') WHERE posto <= {TOP}",
    "windows_90d": f"SELECT DISTINCT ente_id, giorno AS dal, max(giorno) OVER w AS al, count(*) OVER w AS n, CAST(sum(CAST(importo_euro AS DECIMAL(18,2))) OVER w AS DECIMAL(28,2)) AS totale FROM {_A} WHERE giorno IS NOT NULL AND importo_euro > 0 AND importo_euro < 140000 WINDOW w AS (PARTITION BY ente_id ORDER BY giorno RANGE BETWEEN CURRENT ROW AND INTERVAL 90 DAYS FOLLOWING) QUALIFY count(*) OVER w >= 3 AND sum(CAST(importo_euro AS DECIMAL(18,2))) OVER w > 140000",
    "title_containment": f"WITH t AS (SELECT DISTINCT ente_id, oggetto, {_TOKENS.format('oggetto')} AS w FROM atti WHERE oggetto IS NOT NULL) SELECT a.ente_id, a.oggetto AS contenuto, count(*) AS contenitori FROM t a JOIN t b ON a.ente_id IS NOT DISTINCT FROM b.ente_id AND a.oggetto <> b.oggetto AND len(a.w) >= 5 AND contains(' ' || array_to_string(b.w, ' ') || ' ', ' ' || array_to_string(a.w[-greatest(5, CAST(ceil(len(a.w) / 2) AS INTEGER)):], ' ') || ' ') GROUP BY 1, 2",
    "short_intervals": f"SELECT id, CAST(giorni AS INTEGER) AS giorni FROM (SELECT id, importo_euro, {_DAY.format('data_scadenza')} - {_DAY.format('data_pub')} AS giorni FROM atti WHERE lower(tipo) = 'bando') WHERE giorni >= 0 AND giorni < CASE WHEN importo_euro >= 215000 THEN 30 ELSE 15 END",
    "extract_codes": r"SELECT DISTINCT id, unnest(regexp_extract_all(testo_estratto, 'CIG[ :.\-]*([A-Z0-9]{10})([^A-Z0-9]|$)', 1)) AS codice FROM atti",
    "extract_dates": "SELECT id, count(*) AS date, min(g) AS prima, max(g) AS ultima FROM (SELECT id, CAST(try_strptime(unnest(regexp_extract_all(testo_estratto, '([0-9]{2}/[0-9]{2}/[0-9]{4})', 1)), '%d/%m/%Y') AS DATE) AS g FROM atti) WHERE g IS NOT NULL GROUP BY 1",
    "extract_amounts": r"SELECT id, count(*) AS importi, CAST(max(CAST(replace(replace(t, '.', ''), ',', '.') AS DECIMAL(38,2))) AS DECIMAL(18,2)) AS massimo FROM (SELECT id, unnest(regexp_extract_all(testo_estratto, '€ ?([0-9]{1,3}(?:\.[0-9]{3})*,[0-9]{2})', 1)) AS t FROM atti) GROUP BY 1",
    "insert_outcomes": "SELECT fonte_scraper, CASE WHEN r = 1 THEN 'inserito' ELSE 'duplicato' END AS esito, count(*) AS righe FROM (SELECT fonte_scraper, row_number() OVER (PARTITION BY ente_id, url_fonte ORDER BY id) AS r FROM atti) GROUP BY 1, 2",
    "first_writes": "SELECT id, ente_id, url_fonte FROM (SELECT *, row_number() OVER (PARTITION BY ente_id, url_fonte ORDER BY id) AS r FROM atti) WHERE r = 1",
    "upserted_bodies": "SELECT id, codice_istat, CASE WHEN id % 3 = 0 THEN upper(denominazione) ELSE denominazione END AS denominazione, CASE WHEN id % 3 = 0 THEN 'QZ' ELSE provincia END AS provincia, popolazione, sito_web FROM enti",
    "replaced_flags": "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY ente_id, tipo_flag, coalesce(periodo_da, ''), coalesce(periodo_a, '') ORDER BY id DESC) AS r FROM red_flags) WHERE r = 1",
    "read_until_known": "WITH a AS (SELECT id, ente_id, row_number() OVER (PARTITION BY ente_id, url_fonte ORDER BY id) > 1 AS noto FROM atti), b AS (SELECT *, count(*) FILTER (NOT noto) OVER (PARTITION BY ente_id ORDER BY id) AS isola FROM a), c AS (SELECT *, count(*) FILTER (noto) OVER (PARTITION BY ente_id, isola ORDER BY id) AS lung FROM b), x AS (SELECT ente_id, min(id) AS fine FROM c WHERE lung = 3 GROUP BY 1) SELECT c.ente_id, count(*) AS viste, max(c.id) AS ultima FROM c LEFT JOIN x USING (ente_id) WHERE x.fine IS NULL OR c.id <= x.fine GROUP BY 1",
}
