import random
import re
from collections import defaultdict

from actaspark.llm import boilerplate as B


def brute(data):
    acts, lines = defaultdict(int), defaultdict(set)
    norm = lambda x: "".join(c for c in x.lower() if c.isalpha())
    for i, e, t in data:
        if t is not None:
            acts[e] += 1
            for x in re.split("[\n\f]", t):
                lines[e, norm(x)].add(i)
    return {(i, n) for i, e, t in data if t is not None for n, x in enumerate(re.split("[\n\f]", t), 1) if len(k := norm(x)) >= 20 and len(lines[e, k]) >= 4 and len(lines[e, k]) * 10 >= acts[e]}


def docs(spark, data):
    return spark.createDataFrame([(*r, 0, 0) for r in data], "id long, ente_id long, testo_estratto string, _doc int, riga int")


def make(seed=1, n=300):
    r = random.Random(seed)
    site = ["Questo sito usa soltanto cookie tècnici!", "COPIA CONFORME ALL'ORIGINALE DIGITALE 12", "riga corta", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaa"]
    data = []
    for i in range(n):
        e = r.choice([1, 1, 1, 2, 3, None])
        parts = [r.choice(site) if r.random() < 0.4 else f"riga numero {'abcdefghij'[r.randint(0, 9)] * 15} di prova" for _ in range(r.randint(0, 6))]
        data.append((i, e, r.choice(["\n", "\f", "\n\n"]).join(parts).upper() if r.random() < 0.2 else "\n".join(parts)))
    return data + [(1000, 1, None), (1001, 2, ""), (1002, 2, site[0] + "\n" + site[0]), (1003, 1, "x" * 200_000)]


def test_found_matches_brute_force(spark):
    data = make()
    got = [tuple(r) for r in B.found(docs(spark, data)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_clean_deletes_what_is_found(spark):
    data = make(2)
    found = brute(data)
    for i, t in B.cleaned(docs(spark, data)).collect():
        old = next(x for k, _, x in data if k == i)
        if old is None:
            assert t is None
            continue
        parts = re.findall("[^\n\f]*(?:[\n\f]|$)", old)[: len(re.split("[\n\f]", old))]
        assert t == "".join(p for n, p in enumerate(parts, 1) if (i, n) not in found)


def test_blocks(spark):
    a, b, c = "prima riga del modello di pagina", "seconda riga del modello di pagina", "altra riga che sta sempre da sola"
    data = [(i, 1, f"{a}\n{b}\nTesto {'xyz'[i % 3] * 25}{'q' * i}\n{c}") for i in range(12)]
    got = sorted((r["righe"], r["atti_max"]) for r in B.block_report(docs(spark, data)).collect())
    assert (2, 12) in got and (1, 12) in got


def test_empty(spark):
    d = docs(spark, [(1, 1, "x")]).limit(0)
    assert B.found(d).count() == 0 and B.cleaned(d).count() == 0
