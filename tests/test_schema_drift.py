import itertools
import json
import random

from actaspark.operators import schema_drift as S

BODIES = [f"Comune di {x}" for x in ("Alfa", "Beta", "Gamma", "Delta")]


def files(spark, feeds):
    """feeds: list of (file_id, flusso, formato, when, lines)."""
    f = spark.createDataFrame([(i, fl, "x", fo, w, len(li)) for i, fl, fo, w, li in feeds], "file_id long, flusso string, nome_file string, formato string, caricato_il string, n_righe int")
    k = {"csv": 0, "jsonl": 1}
    r = spark.createDataFrame([(i, n + k[fo], c, "z") for i, _, fo, _, li in feeds for n, c in enumerate(li)], "file_id long, riga int, contenuto string, campo string")
    return f, r


def record(r, names, **over):
    v = {"cig": f"{r.randint(10**8, 10**9)}AB", "ente": r.choice(BODIES), "importo": f"{r.randint(100, 99999)},{r.randint(10, 99)}", "data": f"{r.randint(10, 28)}/0{r.randint(1, 9)}/2023", "flag": r.choice(["true", "false"])}
    v |= {k: f(v) for k, f in over.items()}
    return {names.get(k, k): v[k] for k in v if k in names}


def changes(df):
    return {(x["file_id"], x["modifica"], x["campo"], x["precedente"]) for x in df.collect()}


def test_changes(spark):
    r = random.Random(2)
    plain = {k: k for k in ("cig", "ente", "importo", "data")}
    js = lambda names, **o: [json.dumps(record(r, names, **o)) for _ in range(20)]
    feeds = [
        (9, "a", "jsonl", "2023-01-01", js(plain)),
        (3, "a", "jsonl", "2023-02-01", js(plain | {"ente": "stazione_appaltante"})),
        (5, "a", "jsonl", "2023-03-01", js({k: v for k, v in (plain | {"ente": "stazione_appaltante", "flag": "flag"}).items() if k != "data"})),
        (1, "a", "jsonl", "2023-04-01", js({"cig": "cig", "ente": "stazione_appaltante", "importo": "valore", "flag": "flag"}, importo=lambda v: float(v["importo"].replace(",", ".")))),
        (2, "a", "jsonl", "2023-05-01", js({"cig": "cig", "ente": "stazione_appaltante", "importo": "valore", "flag": "flag"}, importo=lambda v: None)),
        (4, "a", "jsonl", "2023-06-01", js({"cig": "cig", "ente": "stazione_appaltante", "importo": "valore", "flag": "flag"}, importo=lambda v: None)),
        (6, "a", "jsonl", "2023-07-01", js({"cig": "cig", "ente": "stazione_appaltante", "importo": "valore", "flag": "flag"})),
        (8, "b", "csv", "2023-01-01", ["﻿CIG; Ente;\"Importo\"", "A1;Comune di Alfa;1,50", "A2;\"Comune; di Beta\";", "A3"]),
        (7, "b", "csv", "2023-02-01", ["importo;cig;ente", "2,50;A1;Comune di Alfa"]),
    ]
    f, l = files(spark, feeds)
    assert changes(S.found(f, l)) == {
        (3, "rinominato", "stazione_appaltante", "ente"), (5, "aggiunto", "flag", ""), (5, "rimosso", "data", ""), (1, "rinominato", "valore", "importo"), (1, "tipo", "valore", ""), (6, "tipo", "valore", ""),
    }


def test_unified(spark):
    f, l = files(spark, [(1, "a", "csv", "2023-01-01", ["cig;importo_totale_appalto;data_creazione;denominazione_amministrazione", "A;12,50;01/02/2023;X", "B;;;"])])
    got = {(x["cig"], x["importo_totale_appalto"], x["data_creazione"], x["denominazione_amministrazione"]) for x in S.unified(f, l).collect()}
    assert got == {("A", "12,50", "01/02/2023", "X"), ("B", None, None, None)}
    f, l = files(spark, [(1, "a", "jsonl", "2023-01-01", [json.dumps({"importo_totale_appalto": 1250, "data_creazione": 20230201, "denominazione_amministrazione": {"nome": "X", "prov": "QA"}, "oggetto_principale_contratto": ["t", "u"]}), "not json", "null"])])
    got = [(x["importo_totale_appalto"], x["data_creazione"], x["denominazione_amministrazione"], x["oggetto_principale_contratto"]) for x in S.unified(f, l).collect()]
    assert got == [("12,50", "01/02/2023", "X", "t")]


def test_words_behind_the_first_hundreds_count(spark):
    """Values whose first 150 words are alike are told apart by the words after them."""
    r = random.Random(5)
    same = " ".join(f"parola{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150))
    tail = {"uno": ["gatto", "cane", "cavallo", "mulo"], "due": ["nave", "faro", "scoglio", "vela"]}
    text = lambda k: same + " " + " ".join(r.choice(tail[k]) for _ in range(50))
    lines = lambda a, b: [json.dumps({a: text("uno"), b: text("due")}) for _ in range(20)]
    p = S.profiles(S.entries(*files(spark, [(1, "a", "jsonl", "2023-01-01", lines("uno", "due"))]))).collect()
    a, b = ({k for k in x["sketch"] if k[0] == "t"} for x in p)
    assert a - b and b - a


def test_assignment_matches_brute_force():
    r = random.Random(3)
    for _ in range(60):
        n, m = r.randint(1, 4), r.randint(1, 5)
        s = [[r.random() for _ in range(m)] for _ in range(n)]
        got = S.assign(s)
        total = sum(s[i][j] for i, j in enumerate(got) if j >= 0)
        small, large = (n, m) if n <= m else (m, n)
        best = max(sum(s[i][p[i]] if n <= m else s[p[i]][i] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert abs(total - best) < 1e-9 and len({j for j in got if j >= 0}) == small


def test_empty_and_null(spark):
    f, l = files(spark, [(1, "a", "csv", "2023-01-01", [None, "x"])])
    assert S.found(f, l).count() == 0
    assert S.found(f.limit(0), l.limit(0)).count() == 0 and S.unified(f.limit(0), l.limit(0)).count() == 0
