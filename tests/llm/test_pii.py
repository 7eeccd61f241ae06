import os
import random

import numpy as np
import pytest

from actaspark.llm import pii as P, pii_train as R


def test_gradients_match_differences():
    r = np.random.default_rng(0)
    m = P.Tagger.fresh(1, hidden=3)
    ids, y = r.integers(0, P.VOCABULARY, (6, 4)).astype(np.int16), r.integers(0, len(P.TAGS), (6, 4))
    for k in m.w:
        m.w[k] = m.w[k].astype(np.float64)
    _, g = R.gradients(m, ids, y)
    for k in m.w:
        for _ in range(4):
            at = tuple(r.integers(0, n) for n in m.w[k].shape)
            if k[0] == "x":
                at = (int(ids[r.integers(0, 6), r.integers(0, 4)]), at[1])
            old = m.w[k][at]
            m.w[k][at] = old + 1e-2
            up = R.gradients(m, ids, y)[0]
            m.w[k][at] = old - 1e-2
            down = R.gradients(m, ids, y)[0]
            m.w[k][at] = old
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-2 * max(1.0, abs(g[k][at])), k


def test_decoding_matches_brute_force():
    import itertools

    m = P.Tagger.fresh(2, hidden=4)
    r = np.random.default_rng(3)
    m.w["t"], m.w["s"] = r.normal(0, 1, m.w["t"].shape).astype(np.float32), r.normal(0, 1, m.w["s"].shape).astype(np.float32)
    ids = r.integers(0, P.VOCABULARY, (3, 5)).astype(np.int16)
    e, got = m.scores(ids), m.decode(ids)
    short = m.decode(ids, np.array([1, 2, 2, 3, 3]))
    assert (short[:, 3:] == got[:, 3:]).all() and not short[1:, 0].any()
    for j in range(5):
        best = max(itertools.product(range(len(P.TAGS)), repeat=3), key=lambda p: m.w["s"][p[0]] + sum(e[t, j, p[t]] for t in range(3)) + sum(m.w["t"][p[t - 1], p[t]] for t in (1, 2)))
        assert tuple(got[:, j]) == best


def test_learns(tmp_path):
    r = random.Random(1)
    texts = [f"Il dirigente {r.choice(R.GIVEN)} {''.join(r.choice(['Ro', 'Ma', 'li', 'no', 'ta']) for _ in range(3)).capitalize()} scrive a abc{r.randint(1, 99)}@posta.example oggi." for _ in range(300)]
    ids, y = R.examples(texts)
    said = []
    m = R.fit(ids, y, epochs=2, say=said.append)
    assert float(said[-1].split()[-1]) < float(said[0].split()[-1])
    m.save(str(tmp_path / "m.npz"))
    assert (P.Tagger.load(str(tmp_path / "m.npz")).decode(ids[:, :4]) == m.decode(ids[:, :4])).mean() > 0.99


def test_marks_cover_labels():
    t = "Notificare a Nunzio Rosi presso Via Larga Vecchia 12 int. 3, tel. 0971-55 54 80, a.b [at] posta.example, C.F. RSS MRA 80A01 H501U, C.I. CA12345AB, in C.so Roma n. 4. " + "z" * 300
    assert {k for *_, k in R.labels(t)} == set(range(5))
    for s, e, _ in R.labels(t):
        assert any(a <= s and e <= b for a, b in P.segments(t))


@pytest.mark.skipif(not os.path.exists(P.MODEL), reason="not trained")
class TestModel:
    texts = [
        ("Il responsabile del procedimento: Carmela Rossini", [("nome", "Carmela Rossini")]),
        ("Vista l'istanza con cui il dott. BIANCHETTI Vito, residente in Via Agata Moretti n. 12 bis, C.F. BNCVTI80A01H501U, chiede quanto in oggetto;", [("nome", "BIANCHETTI Vito"), ("indirizzo", "Via Agata Moretti n. 12 bis"), ("identita", "BNCVTI80A01H501U")]),
        ("Per chiarimenti scrivere a ufficio.gare [at]\nposta.esempio.example oppure telefonare al +39 0931 555212.", [("email", "ufficio.gare [at]\nposta.esempio.example"), ("telefono", "+39 0931 555212")]),
        ("Approvazione: il restauro nella scuola Ninfa Pellegrini", []),
        ("Accredito su conto IT40X88690673440739946179524, pratica 3415597045, codice CCC6A05236FBFF17;", []),
        ("L'intervento riguarda via Calarimbo, dal km 16 al km 32, foglio 41 particella 942;", []),
        ("La ditta Rossini Costruzioni S.r.l., con sede in largo Mazzini 5, P.IVA 49514954206, ha offerto 12,00 euro;", [("indirizzo", "largo Mazzini 5")]),
    ]

    def test_cases(self, spark):
        d = spark.createDataFrame([(i, None, t, "x") for i, (t, _) in enumerate(self.texts)] + [(90, None, None, "x"), (91, "", "", "x"), (92, "", "Visto il parere. " * 20_000 + self.texts[0][0], "x")], "id long, oggetto string, testo_estratto string, tipo string")
        got = {}
        for r in P.found(d).collect():
            t = self.texts[r["atto_id"]][0] if r["atto_id"] < 90 else "Visto il parere. " * 20_000 + self.texts[0][0]
            got.setdefault(r["atto_id"], []).append((r["tipo"], t[r["inizio"] : r["fine"]]))
        right = sum(sorted(got.get(i, [])) == sorted(w) for i, (_, w) in enumerate(self.texts))
        assert right >= len(self.texts) - 1 and got[92] == [("nome", "Carmela Rossini")] and not {90, 91} & set(got)
        assert P.found(d.limit(0)).count() == 0

    def test_held_out_accuracy(self):
        """On sentences of other words than those of the training tables."""
        r = random.Random(7)
        hit = said = there = 0
        texts = []
        for _ in range(300):
            name = f"{r.choice(R.GIVEN)} {''.join(r.choice(['bra', 'ne', 'ti', 'go', 'lu', 'ssi']) for _ in range(3)).capitalize()}"
            texts.append(r.choice(["Il dirigente {}", "Hanno partecipato {} e altri.", "Delegato alla firma: {}, cell. 345 555 1234, domicilio via Ballaro n. 3.", "F.to {}"]).format(name) + "\nLa seduta è tolta dopo 12 minuti.")
        for t, c in zip(texts, P.cases(texts)):
            g = {(s, e, P.TYPES[k]) for s, e, k in R.labels(t)}
            hit, said, there = hit + len(g & set(c)), said + len(c), there + len(g)
        assert hit >= 0.9 * said and hit >= 0.9 * there

    def test_rows_do_not_depend_on_the_batch(self):
        """Texts alone, in other company and in another order have the same cases."""
        r = random.Random(9)
        texts = [t for t, _ in self.texts] + [" ".join(r.sample([x for t, _ in self.texts for x in t.split()], r.randint(5, 60))) for _ in range(120)] + [None, ""]
        whole = P.cases(texts)
        assert [P.cases([t])[0] for t in texts] == whole
        order = r.sample(range(len(texts)), len(texts))
        assert P.cases([texts[i] for i in order]) == [whole[i] for i in order]

    def test_forms(self):
        """An address takes the form nearest to the decoded bounds; long names and names with particles or figures are forms too."""
        t = "in corso presso l'immobile di largo Salarivrale n. 185"
        assert P.checked(t, [(30, 54, 3)]) == [(30, 54, "indirizzo")]
        for a in ("via dei Mille 5", "piazza della Repubblica, 3", "via 4 Novembre 12", "via dei Caduti di tutte le guerre 7"):
            assert P.checked(f"in {a}, ", [(3, 3 + len(a), 3)]) == [(3, 3 + len(a), "indirizzo")]
        for x in ("via dei Mille 5", "tel. 06 123456", "Rosa D'Amico"):
            assert P.segments(x)

    def test_masked(self, spark):
        d = spark.createDataFrame([(1, "x", self.texts[0][0]), (2, None, None)], "id long, oggetto string, testo_estratto string")
        assert {tuple(r) for r in P.masked(d).collect()} == {(1, "x", "Il responsabile del procedimento: [NOME]"), (2, None, None)}
