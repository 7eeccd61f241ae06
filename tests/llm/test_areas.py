import random
from collections import Counter

from actaspark.llm import areas as A


def test_sentences():
    t = "VERBALE N. 12\nLa giunta approva il piano, nota prot. 5 del 2020. Il dott. Rossi legge la nota del sindaco!\n1\t2,5\t3\n<p>Altra frase di quattro parole</p>"
    assert [len(s.split()) for s in A.sentences(t)] == [10, 8, 5]
    assert A.sentences("La giunta approva il piano. 24 alberi sono piantati nel parco, art. 5 e d.p.r. 207 compresi.") == ["la giunta approva il piano", "24 alberi sono piantati nel parco art 5 e d p r 207 compresi"]
    assert A.sentences(None) == A.sentences("") == A.sentences(" \n\t") == []


def test_counts_match_plain_counting():
    r = random.Random(1)
    lex = A.Lexicon({"gatto": ("animali", 2.0), "il cane": ("animali", 2.0), "nave": ("mare", 2.0)}, 0.1)
    found = [[" ".join(r.choice(["gatto", "il", "cane", "nave", "12", "vento", "mare"]) for _ in range(r.randint(4, 9))) for _ in range(r.randint(0, 4))] for _ in range(80)]
    want = Counter()
    for doc in found:
        want.update({(t, a) for w in doc for a in lex.label(w) or [""] for t in A.terms(w)})
    got = {(t, a): n for t, a, n in A.count_terms(found, lex).itertuples(index=False) if t}
    assert got == dict(want)


def test_assign(spark):
    r = random.Random(2)
    topics = {"mare": ["la nave salpa dal porto vecchio", "il faro illumina gli scogli bianchi", "la rete dei pescatori resta vuota"], "cielo": ["la stella brilla sopra le nuvole", "il vento spinge le nuvole grigie", "la luna sorge dietro la collina"]}
    tails = ["come detto ieri", "secondo il verbale", "a richiesta di tutti", "senza altra spesa"]
    s = lambda a: r.choice(topics[a]).capitalize() + " " + r.choice(tails) + "."
    plain = lambda: "La seduta finisce dopo molte parole " + r.choice(tails) + "."
    ex = spark.createDataFrame([(i, a, " ".join(s(a) for _ in range(3))) for i, a in enumerate(list(topics) * 20)] + [(90, None, "x"), (91, "mare", None)], "esempio_id long, area string, text string")
    docs, want = [], set()
    for i in range(60):
        kind = i % 4
        t = [[s("mare")] * 5, [s("cielo") for _ in range(3)] + [s("mare")] * 2, [plain() for _ in range(5)] + [s("cielo")], [plain() for _ in range(4)]][kind]
        docs.append((i, " ".join(t), "altro"))
        want |= {(i, a) for a in [["mare"], ["mare", "cielo"], [], []][kind]}
    docs += [(100, None, "x"), (101, "", "x"), (102, " \n", "x"), (103, (s("mare") + " ") * 3000, "x")]
    want |= {(103, "mare")}
    d = spark.createDataFrame(docs, "doc_id long, text string, area string")
    got = {(x["doc_id"], x["area"]) for x in A.assign(d, ex).collect()}
    assert got == want
    assert A.assign(d.limit(0), ex).count() == 0
