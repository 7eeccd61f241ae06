"""Chains against a plain restatement act by act, and small cases."""

import random
import re

import pytest

from actaspark.plans import chain_queries, chains as C, marts as M

TITLES = [f"servizio di {a} presso la scuola {b} lotto {c}" for a in ("pulizia locali", "mensa scolastica") for b in ("Verga", "Pirandello") for c in ("primo", "secondo")]
LAYOUT = "id long, ente_id long, tipo string, numero string, cig string, oggetto string, testo string, giorno date, ruolo string, extra string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LAYOUT)


def random_acts(r, n):
    out = []
    for i in range(1, n + 1):
        role = r.choice(["avvio", "altro", "revoca", "proroga", "aggiudicazione"])
        title = r.choice(TITLES) + r.choice(["", f" via {r.randint(1, 9)}"])
        if role in ("revoca", "proroga"):
            title = f"{role} dell'atto relativo a {title}"
        refs = [r.choice([f"determinazione n. {r.randint(1, n)} del 01/02/2023", f"det. n. {r.randint(1, n)}/2023", f"CIG: COD000000{r.randint(0, 3)}", "niente"]) for _ in range(r.randint(0, 3))]
        cig = f"COD000000{r.randint(0, 3)}" if r.random() < 0.2 else None
        out.append((i, r.randint(1, 2), "determina", r.choice([str(i), f"{i}/2023", None]), cig, r.choice([title, title, None, ""]), r.choice([" ; ".join(refs), None]), None, role))
    return out


def by_hand(acts):
    """Stages one to three, act after act in order of id."""
    links = {a[0]: f"cig|{a[4]}" for a in acts if a[4]}
    owner = {}
    for a in acts:
        if a[4]:
            owner.setdefault(a[4], a[1])
    first = {}
    for a in acts:
        if a[3]:
            first.setdefault((a[1], a[3].split("/")[0]), a[0])
    before = dict(links)
    for a in acts:
        if a[0] in before:
            continue
        t = f"{a[5] or ''} {a[6] or ''}"
        refs = [("n", n) for n in re.findall(r"determinazione n\. (\d+) del \d\d/\d\d/\d{4}", t)] + [("n", n) for n in re.findall(r"det\. n\. (\d+)/\d{4}", t)] + [("c", c) for c in re.findall(r"CIG: (\w{10})", t)]
        for kind, v in refs:
            to = f"cig|{v}" if kind == "c" and owner.get(v) == a[1] else links.get(first.get((a[1], v))) if kind == "n" and first.get((a[1], v)) != a[0] else None
            if to:
                links[a[0]] = to
    references = {k: v for k, v in links.items() if k not in before}
    prior, held = dict(links), {}
    words = lambda s: [w for w in re.split(r"[^\w]+", (s or "").lower()) if len(w) > 2 and w not in C.X.STOP]
    for d in acts:
        if d[8] not in C.X.DERIVED or d[0] in prior or not d[5]:
            continue
        box = f" {' '.join(words(d[5]))} "
        hit = []
        for o in acts:
            w = words(o[5])
            if o[1] == d[1] and o[8] not in C.X.DERIVED and len(w) >= 5 and f" {' '.join(w[-max(5, -(-len(w) // 2)):])} " in box:
                hit.append(o[0])
        known = {prior.get(x) for x in hit}
        if len(hit) == 1:
            held[d[0]] = prior.get(hit[0]) or f"atto|{hit[0]}"
            if not prior.get(hit[0]):
                held[hit[0]] = f"atto|{hit[0]}"
        elif hit and len(known) == 1 and None not in known:
            held[d[0]] = known.pop()
    return references, held


@pytest.mark.parametrize("seed", range(4))
def test_links_against_plain_restatement(spark, seed):
    acts = random_acts(random.Random(seed), 60)
    a = table(spark, acts)
    codes = C.code_links(a)
    pairs = lambda df: {(x["id"], x["procedimento"]) for x in df.collect()}
    references, held = by_hand(acts)
    refs = C.reference_links(a, codes)
    assert pairs(refs) == set(references.items()) and references
    assert pairs(C.containment_links(a, codes.unionByName(refs))) == set(held.items()) and held


def golden(spark):
    """Three notices and three revocations that share their beginning and differ in their end; one revocation cites a wrong number."""
    head = "avviso pubblico di selezione interna per la progressione tra le aree riservata al personale dipendente con contratto a tempo indeterminato"
    ends = [f"per la copertura di {n} posti di {q} da assegnare al settore {s}" for n, q, s in ((7, "operatore esperto", "tecnico"), (3, "istruttore amministrativo", "finanze"), (2, "funzionario contabile", "tributi"))]
    day = __import__("datetime").date
    rows = [(i + 1, 1, "bando", str(10 + i), None, f"{head} {e}", None, day(2024, 1, 10 + i), "avvio") for i, e in enumerate(ends)]
    rows += [(i + 4, 1, "determina", str(20 + i), None, f"revoca in autotutela dell'avviso approvato con determinazione n. 99 del 01/01/2024: {head} {e}", None, day(2024, 3, 1 + i), "revoca") for i, e in enumerate(ends)]
    return rows


def test_golden_set(spark):
    a = table(spark, golden(spark))
    p = C.procedures(a, C.links(a, M.title_stars)).collect()
    assert {(x["procedimento"], x["atti"], x["stato"], x["tipo"], x["metodo"], str(x["avvio"]), str(x["chiusura"])) for x in p} == {(f"atto|{i}", 2, "revocato", "gara", "contenimento_oggetto", f"2024-01-{9 + i}", f"2024-03-0{i}") for i in (1, 2, 3)}


def test_ambiguous_originals_link_nothing(spark):
    rows = golden(spark)
    twice = [rows[0], (7, *rows[0][1:]), rows[3]]
    assert C.containment_links(table(spark, twice), C.code_links(table(spark, twice))).count() == 0


def test_empty_and_null(spark):
    for rows in ([], [(1, None, None, None, None, None, None, None, "altro"), (2, None, None, "", "", "", "", None, "revoca")]):
        a = table(spark, rows).withColumn("cig", C.F.when(C.F.col("cig") != "", C.F.col("cig")))
        assert C.links(a, M.title_stars).count() == 0 and C.code_chains(a).count() == 0 and C.reopenings(a).count() == 0 and C.revocations(a).count() == 0


def test_reopening_and_routine(spark):
    day = __import__("datetime").date
    t = "affidamento servizio pulizia palestra via Garibaldi"
    rows = [
        (1, 1, "bando", "1", "AAAAAAAAA1", t, None, day(2024, 1, 1), "avvio"), (2, 1, "d", "2", "AAAAAAAAA1", "revoca gara mensa", None, day(2024, 2, 1), "revoca"), (3, 1, "d", "3", None, t + " nuova", None, day(2024, 2, 19), "avvio"),
        (4, 1, "d", "4", "BBBBBBBBB1", "rapporto trimestrale consumi energia edifici", None, day(2024, 1, 1), "avvio"), (5, 1, "d", "5", "BBBBBBBBB1", "revoca", None, day(2024, 1, 2), "revoca"),
        *[(6 + i, 1, "d", "9", None, "rapporto trimestrale consumi energia edifici", None, day(2024, 4 + i, 1), "altro") for i in range(3)],
        (20, 2, "d", "3", None, t, None, day(2024, 3, 1), "avvio"),
    ]
    a = table(spark, rows)
    assert {(x["cig"], x["id"]) for x in C.reopenings(a).collect()} == {("AAAAAAAAA1", 3)}
    assert {(x["cig"], x["giorni"]) for x in C.revocations(a).collect()} == {("AAAAAAAAA1", 31), ("BBBBBBBBB1", 1)}
    with pytest.raises(ValueError):
        C.reopenings(a, 1.5)


def test_every_query_is_listed():
    assert set(chain_queries.SQL) | {"reference_links", "chains", "chain_stages"} == set(chain_queries.QUERIES)
