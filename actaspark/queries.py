"""Queries of the core, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from actaspark.functions import spans
from actaspark.operators import profile, schema_drift
from actaspark.plans import chain_queries, marts, upkeep
from actaspark.sources import html, pages
from actaspark.storage import spread
from actaspark.streaming import feeds
from actaspark.tables import load

QUERIES = {
    **marts.QUERIES,
    **chain_queries.QUERIES,
    **upkeep.QUERIES,
    "event_windows": lambda s, d: feeds.tumbling(load(s, d, "events"), "ts", "event_type"),
    "event_sessions": lambda s, d: feeds.sessions(load(s, d, "events"), "ts", "user_id"),
    "text_pages": lambda s, d: pages.split_pages(load(s, d, "atti", "id", "testo_estratto"), "id", "testo_estratto"),
    "markup_stripped": lambda s, d: spread(load(s, d, "documents", "doc_id", "text")).select("doc_id", html.strip_tags(F.col("text")).alias("testo")),
    "entity_spans": lambda s, d: spans.extract(load(s, d, "atti", "id", "testo_estratto"), "id", "testo_estratto"),
    "people_in_office": lambda s, d: spans.recurring_people(spans.extract(load(s, d, "atti", "id", "testo_estratto"), "id", "testo_estratto", (spans.actor_spans,)), "id"),
    "p2_found": lambda s, d: profile.found(load(s, d, "atti")),
    "p2_profile": lambda s, d: profile.profile(load(s, d, "atti")),
    "p2_loads": lambda s, d: profile.profile_by_load(load(s, d, "atti")),
    "p3_found": lambda s, d: schema_drift.found(load(s, d, "anac_file"), load(s, d, "anac_righe")),
    "p3_unified": lambda s, d: schema_drift.unified(load(s, d, "anac_file"), load(s, d, "anac_righe")),
}
_GOOD_DATE = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND NOT starts_with({0}, '0000') THEN TRY_CAST({0} AS DATE) END"
_PLAIN = "text"
for _k, _v in html.ENTITIES.items():
    _PLAIN = "replace({}, '{}', '{}')".format(_PLAIN, _k.replace("'", "''"), _v.replace("'", "''"))
_VALUES = f"""
WITH a AS (SELECT id, substr(data_accesso, 1, 10) AS carico, data_atto, importo_euro, cig, {_GOOD_DATE.format("data_atto")} AS g, {_GOOD_DATE.format("substr(data_accesso, 1, 10)")} AS giorno FROM atti),
v AS (
  SELECT id, carico, 'data_atto' AS campo, data_atto IS NULL AS vuoto, data_atto AS valore, CASE WHEN data_atto IS NULL THEN NULL WHEN g IS NULL THEN 'formato' WHEN g < DATE '1990-01-01' OR g > giorno THEN 'intervallo' END AS difetto, CAST(giorno - g AS DOUBLE) AS x FROM a
  UNION ALL SELECT id, carico, 'importo_euro', importo_euro IS NULL, CAST(importo_euro AS VARCHAR), CASE WHEN importo_euro IS NULL THEN NULL WHEN isnan(importo_euro) THEN 'formato' WHEN importo_euro < 0 OR importo_euro > 100000000 THEN 'intervallo' END, importo_euro FROM a
  UNION ALL SELECT id, carico, 'cig', cig IS NULL, cig, CASE WHEN cig IS NULL THEN NULL WHEN NOT regexp_full_match(cig, '[A-Z0-9]{{10}}') OR cig = repeat(substr(cig, 1, 1), 10) THEN 'formato' END, NULL FROM a)"""
SQL: dict[str, str] = {
    **marts.SQL,
    **chain_queries.SQL,
    **upkeep.SQL,
    "title_classes": f"WITH t AS (SELECT id, ente_id, list_sort(list_distinct({marts._TOKENS.format('oggetto')})) AS w FROM atti), c AS (SELECT *, CASE WHEN len(w) > 0 AND ente_id IS NOT NULL THEN sha256(array_to_string(w, chr(31))) END AS classe FROM t), k AS (SELECT ente_id, classe, any_value(w) AS w, count(*) AS n FROM c WHERE classe IS NOT NULL GROUP BY 1, 2), p AS (SELECT a.ente_id, a.classe, sum(b.n) - 1 AS legami FROM k a JOIN k b ON a.ente_id = b.ente_id AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9 GROUP BY 1, 2) SELECT c.ente_id, c.id, c.classe, CAST(coalesce(legami, 0) AS BIGINT) AS legami FROM c LEFT JOIN p USING (ente_id, classe)",
    "recurring_references": f"WITH {chain_queries._ACTS}, {chain_queries._REFERENCES} SELECT r.tipo, valore, count(DISTINCT r.id) AS atti, count(*) AS volte, string_agg(DISTINCT ruolo, ',' ORDER BY ruolo) AS ruoli FROM r JOIN a ON a.id = r.id GROUP BY 1, 2 HAVING count(DISTINCT r.id) >= 2",
    "role_classification": f"SELECT id, {chain_queries.role_sql()} AS ruolo FROM atti",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS dal, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS somma FROM events GROUP BY 1, 2",
    "event_sessions": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS k FROM events), b AS (SELECT user_id, ts, sum(k) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT min(ts) AS dal, user_id, count(*) AS n FROM b GROUP BY user_id, g",
    "text_pages": "WITH p AS (SELECT id, generate_subscripts(x, 1) AS numero, unnest(x) AS testo FROM (SELECT id, string_split(testo_estratto, chr(12)) AS x FROM atti WHERE testo_estratto IS NOT NULL)) SELECT id, CAST(numero AS INTEGER) AS numero, testo, CAST(coalesce(sum(length(testo) + 1) OVER (PARTITION BY id ORDER BY numero ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS offset_inizio, CAST(coalesce(sum(length(testo) + 1) OVER (PARTITION BY id ORDER BY numero ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(testo) AS INTEGER) AS offset_fine FROM p",
    "markup_stripped": rf"SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace({_PLAIN}, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s' || chr(11) || ']+', ' ', 'g')), '') AS testo FROM documents",
    "p2_loads": f"{_VALUES}, n AS (SELECT carico, campo, max(k) AS massimo FROM (SELECT carico, campo, valore, count(*) AS k FROM v WHERE NOT vuoto AND difetto IS NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT l.*, n.massimo FROM (SELECT carico, campo, count(*) AS righe, count(*) FILTER (vuoto) AS nulli, count(*) FILTER (NOT vuoto AND difetto IS NULL) AS buoni, median(x) FILTER (NOT vuoto AND difetto IS NULL) AS mediana FROM v GROUP BY 1, 2) l LEFT JOIN n ON n.carico IS NOT DISTINCT FROM l.carico AND n.campo = l.campo",
    "p2_profile": f"{_VALUES}, n AS (SELECT campo, valore, count(*) AS k FROM v WHERE NOT vuoto GROUP BY 1, 2), h AS (SELECT campo, count(*) AS distinti, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 6) AS entropia FROM n GROUP BY 1) SELECT campo, count(*) AS righe, count(*) FILTER (vuoto) AS nulli, distinti, count(*) FILTER (difetto = 'formato') AS formato, count(*) FILTER (difetto = 'intervallo') AS intervallo, CASE WHEN campo = 'importo_euro' THEN printf('%.2f', min(x) FILTER (NOT vuoto AND difetto IS NULL)) ELSE min(valore) FILTER (NOT vuoto AND difetto IS NULL) END AS minimo, CASE WHEN campo = 'importo_euro' THEN printf('%.2f', max(x) FILTER (NOT vuoto AND difetto IS NULL)) ELSE max(valore) FILTER (NOT vuoto AND difetto IS NULL) END AS massimo, entropia FROM v JOIN h USING (campo) GROUP BY campo, distinti, entropia",
    "p2_found": f"""
WITH a AS (SELECT id, substr(data_accesso, 1, 10) AS carico, data_atto, importo_euro, cig, {_GOOD_DATE.format("data_atto")} AS g, {_GOOD_DATE.format("substr(data_accesso, 1, 10)")} AS giorno FROM atti),
v AS (
  SELECT id, carico, 'data_atto' AS campo, data_atto IS NULL AS vuoto, data_atto AS valore, CASE WHEN data_atto IS NULL THEN NULL WHEN g IS NULL THEN 'formato' WHEN g < DATE '1990-01-01' OR g > giorno THEN 'intervallo' END AS difetto, CAST(giorno - g AS DOUBLE) AS x FROM a
  UNION ALL SELECT id, carico, 'importo_euro', importo_euro IS NULL, NULL, CASE WHEN importo_euro IS NULL THEN NULL WHEN isnan(importo_euro) THEN 'formato' WHEN importo_euro < 0 OR importo_euro > 100000000 THEN 'intervallo' END, importo_euro FROM a
  UNION ALL SELECT id, carico, 'cig', cig IS NULL, cig, CASE WHEN cig IS NULL THEN NULL WHEN NOT regexp_full_match(cig, '[A-Z0-9]{{10}}') OR cig = repeat(substr(cig, 1, 1), 10) THEN 'formato' END, NULL FROM a),
t AS (SELECT campo, avg(CAST(vuoto AS INTEGER)) AS q, median(x) FILTER (NOT vuoto AND difetto IS NULL) AS m FROM v GROUP BY 1),
c AS (SELECT carico, campo, max(n) AS top FROM (SELECT carico, campo, valore, count(*) AS n FROM v WHERE NOT vuoto AND difetto IS NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
l AS (SELECT carico, campo, count(*) AS n, avg(CAST(vuoto AS INTEGER)) AS q, median(x) FILTER (NOT vuoto AND difetto IS NULL) AS m, count(*) FILTER (NOT vuoto AND difetto IS NULL) AS buoni FROM v WHERE carico IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20)
SELECT 'riga' AS ambito, CAST(id AS VARCHAR) AS chiave, campo, difetto FROM v WHERE difetto IS NOT NULL
UNION ALL SELECT 'carico', l.carico, l.campo, 'nulli' FROM l JOIN t USING (campo) WHERE l.q - t.q > 0.25
UNION ALL SELECT 'carico', l.carico, l.campo, 'spostamento' FROM l JOIN t USING (campo) LEFT JOIN c ON c.carico = l.carico AND c.campo = l.campo
WHERE (l.campo = 'data_atto' AND abs(l.m - t.m) > 180) OR (l.campo = 'importo_euro' AND (l.m * 8 < t.m OR l.m > t.m * 8)) OR (l.campo = 'cig' AND c.top * 4 > l.buoni AND c.top >= 5)""",
}
