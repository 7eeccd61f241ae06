from actaspark.llm import names as N

BODIES = [(1, "Comune di Monte Urelvata", "QA"), (2, "San Tenopeccile", "QB"), (3, "Braoloccino (QF)", "QF"), (4, "Comune di Braoloccino", "QB"), (5, "Azienda Sanitaria Provinciale di Quailarsino", "QC"), (6, "Rosiscara Terme", None), (7, "Rosiscara", "QD"), (8, "Valiscara", "QE")]
CASES = [
    ("COMUNE DI MONTE URELVATA", None, "Sicilia", 1), ("Com. M.te Urelvata", None, "Sicilia", 1), ("monteurelvata", None, None, 1), ("Comune di Monte Urelvaata - Area Tecnica", None, "Sicilia", 1), ("Monte Uelvata, Comune di", None, "Sicilia", 1),
    ("C.ne di S. Tenopeccile", None, "Sicilia", 2), ("Com.San Tenopeccile/Ufficio Gare", None, "Sicilia", 2), ("Comune di Braoloccino (QF)", "1" * 11, "Sicilia", 3), ("Braoloccino (QB)", "2" * 11, "Sicilia", 4), ("Comune di Braoloccino", "2" * 11, "Sicilia", 4),
    ("Comune di Braoloccino", None, "Sicilia", None), ("A.S.P. di Quailarsino", None, "Sicilia", 5), ("Quailarsino Azienda Sanitaria Prov.le", None, "Sicilia", 5), ("Rosiscara T.me", None, "Sicilia", 6), ("Comune di Rosiscara", None, "Sicilia", 7),
    ("Istituto Comprensivo Rosiscara", None, "Sicilia", None), ("Azienda Speciale Rosiscara Servizi", None, "Sicilia", None), ("Comune di Valiscaro", None, "Veneto", None), ("COMUNE DI VALISCARO", None, None, None), ("Comune di Valiscara", None, "Sicilia", 8),
    ("n.d.", None, None, None), ("-", None, None, None), ("", None, None, None), (None, None, None, None), ("Comune di Monte Urelvata (ZZ)", None, "Sicilia", None),
]


def tables(spark):
    t = spark.createDataFrame([(i, n, c, r, 0) for i, (n, c, r, _) in enumerate(CASES)], "riga_id long, denominazione_amministrazione string, cf_amministrazione string, sezione_regionale string, ente_id int")
    e = spark.createDataFrame([(i, n, p, "x") for i, n, p in BODIES], "id long, denominazione string, provincia string, profilo string")
    return t, e


def test_link(spark):
    t, e = tables(spark)
    got = [tuple(r) for r in N.link(t, e).collect()]
    assert len(got) == len(set(got))
    assert dict(got) == {i: x for i, (*_, x) in enumerate(CASES) if x}


def test_merged_spellings_pull_in_others(spark):
    """A spelling two edits from the registered name is found by way of a merged one."""
    t = spark.createDataFrame([(1, "Comune di Camopettora", None, "Sicilia"), (2, "Comune di Camopetora", None, "Sicilia"), (3, "Comune di Canopetora", None, "Sicilia")], "riga_id long, denominazione_amministrazione string, cf_amministrazione string, sezione_regionale string")
    e = spark.createDataFrame([(1, "Camopettora", "QA")], "id long, denominazione string, provincia string")
    assert {tuple(r) for r in N.link(t, e).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_empty(spark):
    t, e = tables(spark)
    assert N.link(t.limit(0), e).count() == 0 and N.link(t, e.limit(0)).count() == 0


def test_distance():
    assert N._distance("urelvata", "uerlvata", 2) == 1 and N._distance("abc", "xyz", 2) == 3 and N._distance("", "a", 2) == 1
    assert N.form_distance("m. urelvata", "monte urelvata") == 0 and N.form_distance("urelvata monte", "monte urelvata") == 0
