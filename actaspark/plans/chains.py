"""Chains of acts of one procedure: by tender code, by references, by titles that hold another, by like titles.

Each stage links acts that the stages before left unlinked; what a stage links is written before the next reads it. A procedure is
named by its origin: ``cig|CODE``, ``atto|ID`` of an act whose title others hold, ``simile|ID`` of the first of like titles.
Null or blank codes, numbers, titles and texts link nothing. Repeated acts link each; ties of day are broken by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from actaspark.functions import text as X
from actaspark.operators import setjoin
from actaspark.storage import materialise, spread
from actaspark.tables import load

#: Words before a number that cite an act, in full and short; fixed values.
KINDS = "determinazione determina deliberazione delibera decreto ordinanza nota".split()
SHORT = "determinazione determina deliberazione delibera ordinanza decreto det delib ord dec".split()
#: Fixed values of E07 and D05.
LEAST_WORDS, COVER, REOPENED, RECURRENT = 5, 0.5, 0.5, 3
_FULL = rf"(?i)(?:{'|'.join(KINDS)})\s+n[°.]?\s*([0-9]+)\s*del\s+([0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}})"
_BRIEF = rf"(?i)\b(?:{'|'.join(SHORT)})[.\s]*n[°.]?\s*([0-9]+)[/\s]+([0-9]{{4}})\b"
_CIG, _CUP = r"(?i)\bCIG\s*[:=]?\s*([A-Z0-9]{10})\b", r"(?i)\bCUP\s*[:=]?\s*([A-Z][A-Z0-9]{14})\b"


def acts(s: SparkSession, d: str) -> DataFrame:
    """id, ente_id, tipo, numero, cig, oggetto, testo, giorno, ruolo; blank codes are null."""
    a = spread(load(s, d, "atti", "id", "ente_id", "tipo", "numero", "cig", "oggetto", "testo_estratto", "data_atto", "data_pub"))
    return a.select(
        "id", "ente_id", "tipo", "numero", F.when(F.col("cig") != "", F.col("cig")).alias("cig"), "oggetto", F.col("testo_estratto").alias("testo"),
        X.event_date(F.col("data_atto"), F.col("data_pub")).alias("giorno"), X.role(F.col("oggetto"), F.col("tipo"), F.col("testo_estratto")).alias("ruolo"),
    )


def _place() -> Column:
    """Order of acts in a chain: by day, those without last, then by id."""
    return F.struct(F.col("giorno").isNull().alias("n"), "giorno", "id")


def references(text: Column) -> Column:
    """Array of (tipo, numero, valore) in the order of the forms: long, short, codes of tenders, codes of projects."""

    def pairs(pattern: str, show) -> Column:
        z = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("b"))
        return F.transform(z, lambda x: F.struct(F.lit("numero_atto").alias("tipo"), x["a"].alias("numero"), show(x["a"], x["b"]).alias("valore")))

    def codes(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda x: F.struct(F.lit(kind).alias("tipo"), F.lit(None).cast("string").alias("numero"), F.upper(x).alias("valore")))

    full = pairs(_FULL, lambda n, day: F.concat(F.lit("n."), n, F.lit(" del "), day))
    brief = pairs(_BRIEF, lambda n, year: F.concat(F.lit("n."), n, F.lit("/"), year))
    return F.concat(full, brief, codes("cig", _CIG), codes("cup", _CUP))


def _cited(a: DataFrame) -> DataFrame:
    """(id, ente_id, posto, tipo, numero, valore): every reference in title and text."""
    t = F.concat(F.coalesce("oggetto", F.lit("")), F.lit(" "), F.coalesce("testo", F.lit("")))
    r = a.select("id", "ente_id", t.alias("t")).where(F.col("t").rlike(r"(?i)\bC[IU][GP]|[0-9]")).select("id", "ente_id", F.posexplode(references(F.col("t"))).alias("posto", "r"))
    return r.select("id", "ente_id", "posto", "r.tipo", "r.numero", "r.valore")


def code_links(a: DataFrame) -> DataFrame:
    return a.where("cig is not null").select("id", F.concat(F.lit("cig|"), "cig").alias("procedimento"))


def code_owners(a: DataFrame) -> DataFrame:
    """(valore, ente_id, procedimento): the body of each code's first act, by which references find the procedure."""
    return a.where("cig is not null").groupBy(F.col("cig").alias("valore")).agg(F.min_by("ente_id", _place()).alias("ente_id")).withColumn("procedimento", F.concat(F.lit("cig|"), "valore"))


def reference_links(a: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, procedimento) of unlinked acts that cite a code's procedure of their body, or an act of it by number.

    Of an act's references the last that leads to a procedure counts. A cited act leads to the procedure it had before, or, if it has a
    lower id, to the one its own references give; rounds follow these pointers and carry undecided acts only.
    """
    cited = _cited(a.join(linked, "id", "left_anti")).where("tipo <> 'cup'")
    owner = code_owners(a)
    by_code = cited.where("tipo = 'cig'").join(owner, ["valore", "ente_id"]).select("id", "posto", "procedimento", F.lit(None).cast("long").alias("citato"))
    number = F.regexp_extract("numero", r"^([^/]*)", 1)
    target = a.where("numero <> ''").select("ente_id", number.alias("numero"), "id").groupBy("ente_id", "numero").agg(F.min("id").alias("citato"))
    by_number = cited.where("tipo = 'numero_atto'").join(target, ["ente_id", "numero"]).join(linked.select(F.col("id").alias("citato"), "procedimento"), "citato", "left")
    by_number = by_number.where("procedimento is not null or citato < id").select("id", "posto", "procedimento", F.when(F.col("procedimento").isNull(), F.col("citato")).alias("citato"))
    rest = materialise(by_code.unionByName(by_number), "references")
    found: DataFrame | None = None
    while rest.limit(1).count():
        last = rest.groupBy("id").agg(F.max_by("procedimento", "posto").alias("procedimento"))
        sure = materialise(last.where("procedimento is not null"), "cited")
        found = sure if found is None else found.unionByName(sure)
        open_ = rest.join(sure, "id", "left_anti")
        waits = open_.select(F.col("id").alias("citato")).distinct().withColumn("aperto", F.lit(True))
        j = open_.join(sure.withColumnsRenamed({"id": "citato", "procedimento": "suo"}), "citato", "left").join(waits, "citato", "left")
        j = j.where("procedimento is not null or suo is not null or aperto")
        rest = materialise(j.select("id", "posto", F.coalesce("procedimento", "suo").alias("procedimento"), F.when(F.coalesce("procedimento", "suo").isNull(), F.col("citato")).alias("citato")), "references")
    return found if found is not None else linked.limit(0)


def _tail(w: Column) -> Column:
    """How many of a title's last words another must hold: five or half of them."""
    return F.greatest(F.lit(LEAST_WORDS), F.ceil(F.size(w) * COVER).cast("int"))


def _run_key(w: Column, start: Column, length: Column) -> Column:
    return F.sha2(F.array_join(F.slice(w, start, length), " "), 256)


def tails(titles: DataFrame) -> DataFrame:
    """Adds ``chiave`` to titles (w: their words) of five words or more: the hash of the words that a holder must have in a row."""
    k = _tail(F.col("w"))
    return titles.where(F.size("w") >= LEAST_WORDS).withColumn("chiave", _run_key(F.col("w"), F.size("w") - k + 1, k))


def runs(titles: DataFrame, keep: list[str], longest: int) -> DataFrame:
    """(keep, chiave): the hashes of all runs of 5 to ``longest`` words of each title, each once. longest: of the tails asked for."""
    w, size = F.col("w"), F.size("w")
    each = F.flatten(F.transform(F.sequence(F.lit(LEAST_WORDS), F.least(size, F.lit(longest))), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _run_key(w, i, n))))
    return titles.where(size >= LEAST_WORDS).select(*keep, F.explode(F.array_distinct(each)).alias("chiave"))


def longest_tail(titles: DataFrame) -> int:
    return titles.where(F.size("w") >= LEAST_WORDS).agg(F.max(_tail(F.col("w")))).first()[0] or LEAST_WORDS


def containment_links(a: DataFrame, linked: DataFrame) -> DataFrame:
    """(id, procedimento): derived acts whose title holds the end of one other act's title, and those acts if they had no procedure.

    Titles that may be held are added up by the words a holder needs before they meet, so a title of many acts is one row; several
    originals link only if all have one procedure already.
    """
    t = a.where("oggetto <> ''").withColumn("w", X.tokens(F.col("oggetto"))).select("id", "ente_id", "w", "ruolo")
    t = materialise(t.join(linked, "id", "left"), "titles")
    derived = F.col("ruolo").isin(*X.DERIVED)
    held = tails(t.where(~derived)).groupBy("ente_id", "chiave").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("originale"), F.count("procedimento").alias("noti"), F.min("procedimento").alias("p1"), F.max("procedimento").alias("p2")
    )
    mine = t.where(derived & F.col("procedimento").isNull())
    j = runs(mine.select("id", "ente_id", "w"), ["id", "ente_id"], longest_tail(t.where(~derived))).join(held, ["ente_id", "chiave"])
    m = j.groupBy("id").agg(F.sum("n").alias("n"), F.min("originale").alias("originale"), F.sum("noti").alias("noti"), F.min("p1").alias("p1"), F.max("p2").alias("p2"))
    one, shared = F.col("n") == 1, (F.col("noti") == F.col("n")) & (F.col("p1") == F.col("p2"))
    m = materialise(m.where(one | shared).select("id", "n", "originale", F.coalesce("p1", F.concat(F.lit("atto|"), F.col("originale").cast("string"))).alias("procedimento"), (one & (F.col("noti") == 0)).alias("nuovo")), "held")
    return m.select("id", "procedimento").unionByName(m.where("nuovo").select(F.col("originale").alias("id"), "procedimento").distinct())


def similar_links(a: DataFrame, linked: DataFrame, stars) -> DataFrame:
    """(id, procedimento) of unlinked acts grouped under the first act with a like title; groups of two or more."""
    g = stars(a.join(linked, "id", "left_anti").where("oggetto <> ''").select("id", "ente_id", "oggetto", "giorno"))
    n = g.groupBy("capo").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return g.join(n, "capo").select("id", F.concat(F.lit("simile|"), F.col("capo").cast("string")).alias("procedimento"))


def procedures(a: DataFrame, links: DataFrame) -> DataFrame:
    """One row per procedure: first and last day by method, title, state and type by the roles of its acts.

    The start is the first day, with held titles that of the first act that is not derived; the end is the last day if two acts have one.
    """
    j = links.join(a.select("id", "ente_id", "oggetto", "giorno", "ruolo"), "id")
    g = j.groupBy("procedimento", "metodo").agg(
        F.count(F.lit(1)).alias("atti"), F.min_by("ente_id", _place()).alias("ente_id"), F.min_by("oggetto", F.when(F.col("oggetto") != "", _place())).alias("oggetto"),
        F.min("giorno").alias("_primo"), F.min(F.when(~F.col("ruolo").isin(*X.DERIVED), F.col("giorno"))).alias("_originale"), F.max("giorno").alias("_ultimo"), F.count("giorno").alias("_datati"), F.collect_set("ruolo").alias("_ruoli"),
    )
    start = F.when(F.col("metodo") == "contenimento_oggetto", F.coalesce("_originale", "_primo")).otherwise(F.col("_primo"))
    return g.select("procedimento", "metodo", "ente_id", "oggetto", "atti", start.alias("avvio"), F.when(F.col("_datati") > 1, F.col("_ultimo")).alias("chiusura"), X.state(F.col("_ruoli")).alias("stato"), X.chain_type(F.col("_ruoli")).alias("tipo"))


METHODS = {"cig": "cig", "atto": "contenimento_oggetto", "simile": "oggetto_simile_da_verificare"}


def method(procedure: Column) -> Column:
    """The method by which a procedure was found first."""
    out = F.lit(None).cast("string")
    for k, v in METHODS.items():
        out = F.when(procedure.startswith(k + "|"), v).otherwise(out)
    return out


def links(a: DataFrame, stars) -> DataFrame:
    """(id, procedimento, metodo, passo) of every linked act, by the stages in order. stars: groups acts of like titles."""
    out = materialise(code_links(a).withColumn("passo", F.lit("codice")), "links")
    for step, stage in (("riferimento", reference_links), ("contenimento", containment_links), ("somiglianza", lambda x, y: similar_links(x, y, stars))):
        new = stage(a, out.select("id", "procedimento"))
        out = materialise(out.unionByName(new.withColumn("passo", F.lit(step))), "links")
    return out.withColumn("metodo", method(F.col("procedimento")))


def code_chains(a: DataFrame) -> DataFrame:
    """One chain per tender code over all bodies: first day, last act's day, first title, body of the first act, state and type."""
    k = _place()
    g = a.where("cig is not null").groupBy("cig").agg(
        F.count(F.lit(1)).alias("atti"), F.min_by("ente_id", k).alias("ente_id"), F.min("giorno").alias("avvio"), F.max_by("giorno", k).alias("_c"),
        F.min_by("oggetto", F.when(F.col("oggetto") != "", k)).alias("oggetto"), F.collect_set("ruolo").alias("_r"),
    )
    return g.select("cig", "atti", "ente_id", "avvio", F.when(F.col("atti") > 1, F.col("_c")).alias("chiusura"), "oggetto", X.state(F.col("_r")).alias("stato"), X.chain_type(F.col("_r")).alias("tipo"))


def revocations(a: DataFrame) -> DataFrame:
    """Revoked or annulled code chains that hold a starting act: day of the first revoking act, else the chain's end, and days since the start."""
    k = _place()
    ends = F.col("ruolo").isin("revoca", "annullamento")
    c = code_chains(a).where("stato in ('revocato', 'annullato') and tipo = 'gara'")
    r = a.where(F.col("cig").isNotNull() & ends).groupBy("cig").agg(F.min_by("giorno", k).alias("_r"), F.min("id").alias("_id"))
    j = c.join(r, "cig").withColumn("revoca", F.col("_r"))
    return j.select("cig", "ente_id", "stato", "atti", "avvio", "revoca", F.datediff("revoca", "avvio").alias("giorni"))


def reopenings(a: DataFrame, least: float = REOPENED, recurrent: int = RECURRENT) -> DataFrame:
    """(cig, id, giorno, somiglianza): acts of a body after a revoked chain's last revoking act with a like title.

    A title with ``recurrent`` or more like acts in its body, whatever their day, is routine and is left out; so a chain gives fewer rows than that.
    """
    if not 0 <= least <= 1:
        raise ValueError("the similarity lies between 0 and 1")
    ends = a.where(F.col("cig").isNotNull() & F.col("ruolo").isin("revoca", "annullamento")).groupBy("cig").agg(F.max("giorno").alias("fine")).where("fine is not null")
    p = code_chains(a).where("stato in ('revocato', 'annullato')").join(ends, "cig").select("cig", "ente_id", "oggetto", "fine")
    words = lambda: X.token_set(F.col("oggetto"), X.REOPENING_STOP)
    left = materialise(setjoin.classes(p, "ente_id", "cig", words()).join(p.select("cig", "fine"), "cig"), "closed")
    right = materialise(setjoin.classes(a, "ente_id", "id", words()).join(a.select("id", "giorno"), "id"), "later")
    pairs = materialise(setjoin.jaccard_join(left, right, "ente_id", least), "pairs")
    size = right.groupBy("ente_id", F.col("classe").alias("classe_b")).agg(F.count(F.lit(1)).alias("n"))
    few = pairs.join(size, ["ente_id", "classe_b"]).groupBy("ente_id", "classe_a").agg(F.sum("n").alias("n")).where(F.col("n") < recurrent)
    j = pairs.join(few.select("ente_id", "classe_a"), ["ente_id", "classe_a"]).join(left.select("ente_id", F.col("classe").alias("classe_a"), "cig", "fine"), ["ente_id", "classe_a"])
    j = j.join(right.select("ente_id", F.col("classe").alias("classe_b"), "id", "giorno"), ["ente_id", "classe_b"]).where("giorno > fine")
    return j.select("cig", "id", "giorno", F.round("somiglianza", 6).alias("somiglianza"))


def find_or_create(existing: DataFrame, chains: DataFrame) -> DataFrame:
    """existing procedures (id, ente_id, cig, oggetto, stato_finale, data_avvio, data_chiusura, metodo_individuazione) with chains merged in by (cig, ente_id).

    A procedure found takes state, end and a title that is not blank; start and method stay. Of several found the first by id is
    changed. Chains without one are added with a null id.
    """
    first = existing.where("cig is not null").groupBy("cig", "ente_id").agg(F.min("id").alias("_id"))
    c = chains.select("cig", "ente_id", *[F.col(x).alias(f"_{x}") for x in ("oggetto", "stato", "avvio", "chiusura")]).join(first, ["cig", "ente_id"], "left")
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    known = existing.join(c.where("_id is not null").drop("cig", "ente_id").withColumnRenamed("_id", "id").withColumn("_m", F.lit(True)), "id", "left")
    keep = lambda new, old: F.when(F.col("_m"), new).otherwise(F.col(old)).alias(old)
    title = F.coalesce(F.when(F.col("_oggetto") != "", F.col("_oggetto")), F.col("oggetto"))
    changed = known.select("id", "ente_id", "cig", title.alias("oggetto"), keep(F.col("_stato"), "stato_finale"), "data_avvio", keep(day("_chiusura"), "data_chiusura"), "metodo_individuazione")
    new = c.where("_id is null").select(F.lit(None).cast("long").alias("id"), "ente_id", "cig", F.col("_oggetto").alias("oggetto"), F.col("_stato").alias("stato_finale"), day("_avvio").alias("data_avvio"), day("_chiusura").alias("data_chiusura"), F.lit("cig").alias("metodo_individuazione"))
    return changed.unionByName(new)


def backfill(existing: DataFrame, a: DataFrame) -> DataFrame:
    """(id, avvio, chiusura, stato) of existing procedures from the acts of their code and body: the start by method, end and state anew."""
    j = existing.select(F.col("id").alias("procedimento"), "ente_id", "cig", "metodo_individuazione").join(a.where("cig is not null").select("ente_id", "cig", "giorno", "ruolo"), ["ente_id", "cig"])
    g = j.groupBy("procedimento", "metodo_individuazione").agg(
        F.min("giorno").alias("p"), F.min(F.when(~F.col("ruolo").isin(*X.DERIVED), F.col("giorno"))).alias("o"), F.max("giorno").alias("u"), F.count("giorno").alias("n"), F.collect_set("ruolo").alias("r")
    )
    start = F.when(F.col("metodo_individuazione") == "contenimento_oggetto", F.coalesce("o", "p")).otherwise(F.col("p"))
    return g.select(F.col("procedimento").alias("id"), start.alias("avvio"), F.when(F.col("n") > 1, F.col("u")).alias("chiusura"), X.state(F.col("r")).alias("stato"))


def text_chains(docs: DataFrame, case: str) -> DataFrame:
    """One chain per case of documents (case, id, tipo, testo, giorno) that belong together: first code found, events in order of day, state by the roles of their texts."""
    d = docs.where(F.col(case).isNotNull()).select(case, "id", "giorno", F.upper(F.regexp_extract("testo", _CIG, 1)).alias("_cig"), X.role(F.lit(None).cast("string"), F.col("tipo"), F.col("testo")).alias("_r"))
    g = d.groupBy(case).agg(F.count(F.lit(1)).alias("eventi"), F.min_by("_cig", F.when(F.col("_cig") != "", F.col("id"))).alias("cig"), F.min_by("id", _place()).alias("primo"), F.max_by("id", _place()).alias("ultimo"), F.collect_set("_r").alias("_r"))
    return g.select(case, "eventi", "cig", "primo", "ultimo", X.state(F.col("_r")).alias("stato"))
