"""Queries over chains of acts, and SQL that states the same by other means (nested loops, plain lists of words)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from actaspark.functions import text as X
from actaspark.plans import chains as C, marts as M
from actaspark.tables import load


def chain_by_code(s: SparkSession, d: str) -> DataFrame:
    return C.code_chains(C.acts(s, d))


def act_references(s: SparkSession, d: str) -> DataFrame:
    """References to acts and codes in titles and texts, and how often each stands there."""
    return C._cited(C.acts(s, d)).groupBy("id", "tipo", "valore").agg(F.count(F.lit(1)).alias("volte"))


def reference_links(s: SparkSession, d: str) -> DataFrame:
    """Acts without a code that references lead to a code's chain."""
    a = C.acts(s, d)
    return C.reference_links(a, C.code_links(a))


def containment_links(s: SparkSession, d: str) -> DataFrame:
    """Acts linked by titles that hold another's, after the links by code."""
    a = C.acts(s, d)
    return C.containment_links(a, C.code_links(a))


def chains(s: SparkSession, d: str) -> DataFrame:
    """Procedures of all acts by all stages."""
    a = C.acts(s, d)
    return C.procedures(a, C.links(a, M.title_stars))


def chain_stages(s: SparkSession, d: str) -> DataFrame:
    """Acts linked and procedures reached by each stage."""
    return C.links(C.acts(s, d), M.title_stars).groupBy("passo").agg(F.count(F.lit(1)).alias("atti"), F.countDistinct("procedimento").alias("procedimenti"))


def revocations(s: SparkSession, d: str) -> DataFrame:
    return C.revocations(C.acts(s, d))


def reopenings(s: SparkSession, d: str) -> DataFrame:
    return C.reopenings(C.acts(s, d))


_PROCEDURE = ("id", "ente_id", "cig", "oggetto", "stato_finale", "data_avvio", "data_chiusura", "metodo_individuazione")


def merged_procedures(s: SparkSession, d: str) -> DataFrame:
    return C.find_or_create(load(s, d, "procedimenti", *_PROCEDURE), C.code_chains(C.acts(s, d)))


def backfilled_dates(s: SparkSession, d: str) -> DataFrame:
    return C.backfill(load(s, d, "procedimenti", *_PROCEDURE), C.acts(s, d))


def text_chains(s: SparkSession, d: str) -> DataFrame:
    """A chain of all texts of each body (as if they lay in one file)."""
    return C.text_chains(C.acts(s, d).where("testo is not null"), "ente_id")


QUERIES = {f.__name__: f for f in (chain_by_code, act_references, reference_links, containment_links, chains, chain_stages, revocations, reopenings, merged_procedures, backfilled_dates, text_chains)}

_S = "concat_ws(' ', {title}, tipo, substr(testo_estratto, 1, 2000))"
_WORDS = {
    "revoca": "revoca|revoch|revoci", "annullamento": "annulla|annullamento|annullato|annullati", "aggiudicazione": "aggiudica|aggiudicazione|aggiudicato|aggiudicati|affidamento|affidamenti",
    "liquidazione": "liquidazione", "proroga": "proroga|prorogato", "modifica": "rettifica|rettificato", "avvio": "bando|indizione",
}
_PHRASES = {
    "aggiudicazione": r"approvazione\s+graduatoria", "liquidazione": r"pagamento\s+fattura", "proroga": r"estensione\s+(dei\s+)?termini", "modifica": r"(modifica|integrazione|integrazione\s+al)\s+bando",
    "avvio": r"(avviso\s+pubblico|procedura\s+(aperta|negoziata|ristretta)|concorso\s+pubblico|manifestazione\s+d''interesse|avviso\s+di\s+selezione|selezione\s+interna|approvazione\s+avviso)",
}


def role_sql(title: str = "oggetto") -> str:
    out = ""
    for r, w in _WORDS.items():
        test = rf"regexp_matches(lower({_S}), '(^|[^\p{{L}}\p{{N}}_])({w})($|[^\p{{L}}\p{{N}}_])')"
        if r in _PHRASES:
            test += rf" OR regexp_matches(lower({_S}), '(^|[^\p{{L}}\p{{N}}_]){_PHRASES[r]}')"
        out += f" WHEN {test} THEN '{r}'"
    return f"CASE{out} ELSE 'altro' END".replace("{title}", title)


_STATE = "CASE WHEN bool_or({0} = 'annullamento') THEN 'annullato' WHEN bool_or({0} = 'revoca') THEN 'revocato' WHEN bool_or({0} = 'liquidazione') THEN 'concluso' WHEN bool_or({0} = 'aggiudicazione') THEN 'aggiudicato' WHEN bool_or({0} = 'avvio') THEN 'in_corso' ELSE 'sconosciuto' END"
_ACTS = f"a AS (SELECT id, ente_id, tipo, numero, nullif(cig, '') AS cig, oggetto, testo_estratto AS testo, {M._EVENT} AS giorno, {role_sql()} AS ruolo FROM atti)"
_O = "ORDER BY giorno ASC NULLS LAST, id"
_CODES = f"c AS (SELECT cig, count(*) AS atti, first(ente_id {_O}) AS ente_id, min(giorno) AS avvio, CASE WHEN count(*) > 1 THEN last(giorno {_O}) END AS chiusura, first(oggetto {_O}) FILTER (oggetto <> '') AS oggetto, {_STATE.format('ruolo')} AS stato, CASE WHEN bool_or(ruolo = 'avvio') THEN 'gara' ELSE 'generico' END AS tipo FROM a WHERE cig IS NOT NULL GROUP BY 1)"
_DERIVED = "('revoca', 'annullamento', 'modifica', 'proroga')"
_BODY = "(SELECT id, coalesce(oggetto, '') || ' ' || coalesce(testo_estratto, '') AS t FROM atti)"
_REOPENING = ", ".join(f"'{w}'" for w in X.REOPENING_STOP)
_SET = rf"list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(oggetto, '')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND NOT list_contains([{_REOPENING}], w)))"
_REFERENCES = f"""r AS (
  SELECT id, 'numero_atto' AS tipo, unnest(list_transform(list_zip(regexp_extract_all(t, '{C._FULL}', 1), regexp_extract_all(t, '{C._FULL}', 2)), lambda x: 'n.' || x[1] || ' del ' || x[2])) AS valore FROM {_BODY}
  UNION ALL SELECT id, 'numero_atto', unnest(list_transform(list_zip(regexp_extract_all(t, '{C._BRIEF}', 1), regexp_extract_all(t, '{C._BRIEF}', 2)), lambda x: 'n.' || x[1] || '/' || x[2])) FROM {_BODY}
  UNION ALL SELECT id, 'cig', upper(unnest(regexp_extract_all(t, '{C._CIG}', 1))) FROM {_BODY}
  UNION ALL SELECT id, 'cup', upper(unnest(regexp_extract_all(t, '{C._CUP}', 1))) FROM {_BODY})"""
SQL = {
    "chain_by_code": f"WITH {_ACTS}, {_CODES} SELECT * FROM c",
    "act_references": f"WITH {_REFERENCES} SELECT id, tipo, valore, count(*) AS volte FROM r GROUP BY 1, 2, 3",
    "containment_links": f"""
WITH {_ACTS}, w AS (SELECT *, {M._TOKENS.format('oggetto')} AS w FROM a WHERE oggetto <> ''),
o AS (SELECT id, ente_id, cig, ' ' || array_to_string(w[-greatest(5, CAST(ceil(len(w) / 2) AS INTEGER)):], ' ') || ' ' AS coda FROM w WHERE ruolo NOT IN {_DERIVED} AND len(w) >= 5),
m AS (SELECT d.id, count(*) AS n, min(o.id) AS originale, count(o.cig) AS noti, min(o.cig) AS p1, max(o.cig) AS p2 FROM w d JOIN o ON o.ente_id = d.ente_id AND contains(' ' || array_to_string(d.w, ' ') || ' ', o.coda) WHERE d.ruolo IN {_DERIVED} AND d.cig IS NULL GROUP BY 1),
k AS (SELECT id, n, noti, originale, CASE WHEN noti > 0 THEN 'cig|' || p1 ELSE 'atto|' || originale END AS procedimento FROM m WHERE n = 1 OR (noti = n AND p1 = p2))
SELECT id, procedimento FROM k UNION ALL SELECT DISTINCT originale, procedimento FROM k WHERE n = 1 AND noti = 0""",
    "revocations": f"WITH {_ACTS}, {_CODES}, r AS (SELECT cig, first(giorno {_O}) AS revoca FROM a WHERE cig IS NOT NULL AND ruolo IN ('revoca', 'annullamento') GROUP BY 1) SELECT cig, ente_id, stato, atti, avvio, revoca, CAST(revoca - avvio AS INTEGER) AS giorni FROM c JOIN r USING (cig) WHERE stato IN ('revocato', 'annullato') AND tipo = 'gara'",
    "reopenings": f"""
WITH {_ACTS}, {_CODES}, e AS (SELECT cig, max(giorno) AS fine FROM a WHERE cig IS NOT NULL AND ruolo IN ('revoca', 'annullamento') GROUP BY 1 HAVING max(giorno) IS NOT NULL),
p AS (SELECT cig, ente_id, fine, {_SET} AS x FROM c JOIN e USING (cig) WHERE stato IN ('revocato', 'annullato')), t AS (SELECT id, ente_id, giorno, {_SET} AS y FROM a),
m AS (SELECT cig, id, giorno, fine, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS j FROM p JOIN t USING (ente_id) WHERE len(x) > 0 AND len(y) > 0)
SELECT cig, id, giorno, round(j, 6) AS somiglianza FROM m WHERE j >= 0.5 AND giorno > fine AND cig IN (SELECT cig FROM m WHERE j >= 0.5 GROUP BY 1 HAVING count(*) < 3)""",
    "merged_procedures": f"""
WITH {_ACTS}, {_CODES}, f AS (SELECT cig, ente_id, min(id) AS id FROM procedimenti WHERE cig IS NOT NULL GROUP BY 1, 2), k AS (SELECT f.id AS pid, c.* FROM c LEFT JOIN f ON f.cig = c.cig AND f.ente_id = c.ente_id)
SELECT p.id, p.ente_id, p.cig, coalesce(k.oggetto, p.oggetto) AS oggetto, CASE WHEN k.pid IS NULL THEN p.stato_finale ELSE k.stato END AS stato_finale, p.data_avvio, CASE WHEN k.pid IS NULL THEN p.data_chiusura ELSE CAST(k.chiusura AS VARCHAR) END AS data_chiusura, p.metodo_individuazione FROM procedimenti p LEFT JOIN k ON k.pid = p.id
UNION ALL SELECT NULL, ente_id, cig, oggetto, stato, CAST(avvio AS VARCHAR), CAST(chiusura AS VARCHAR), 'cig' FROM k WHERE pid IS NULL""",
    "backfilled_dates": f"WITH {_ACTS} SELECT p.id, CASE WHEN any_value(p.metodo_individuazione) = 'contenimento_oggetto' THEN coalesce(min(giorno) FILTER (ruolo NOT IN {_DERIVED}), min(giorno)) ELSE min(giorno) END AS avvio, CASE WHEN count(giorno) > 1 THEN max(giorno) END AS chiusura, {_STATE.format('ruolo')} AS stato FROM procedimenti p JOIN a ON a.ente_id = p.ente_id AND a.cig = p.cig GROUP BY 1",
    "text_chains": f"WITH b AS (SELECT id, ente_id, {M._EVENT} AS giorno, upper(regexp_extract(testo_estratto, '{C._CIG}', 1)) AS k, {role_sql('NULL')} AS ruolo FROM atti WHERE testo_estratto IS NOT NULL) SELECT ente_id, count(*) AS eventi, first(k ORDER BY id) FILTER (k <> '') AS cig, first(id {_O}) AS primo, last(id {_O}) AS ultimo, {_STATE.format('ruolo')} AS stato FROM b GROUP BY 1",
}
