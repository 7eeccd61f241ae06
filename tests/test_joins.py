import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from actaspark.functions import text as X
from actaspark.operators import setjoin, tables
from actaspark.plans import marts


def test_linked_matches_brute_force(spark):
    r = random.Random(4)
    data = [(i, r.choice(["x", "y", None]), [r.choice("abcdefgh") for _ in range(r.randint(0, 6))]) for i in range(80)]
    data += [(100 + i, "x", ["a", "b"]) for i in range(30)] + [(200, "x", None)]
    got = {x["k"]: x["legami"] for x in setjoin.linked(spark.createDataFrame(data, "k long, b string, m array<string>"), "b", "k", F.coalesce("m", F.array().cast("array<string>")), 0.6).collect()}
    want = {}
    for k, b, m in data:
        s = set(m or [])
        want[k] = sum(1 for k2, b2, m2 in data if k2 != k and b and b2 == b and s and m2 and len(s & set(m2)) >= 0.6 * len(s | set(m2)))
    assert got == want


@settings(max_examples=5, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20))
def test_greedy_leaders_match_sequential(edges):
    from actaspark.session import local_session

    spark = local_session(4, "tests")
    both = {(a, b) for x, y in edges for a, b in ((x, y), (y, x)) if x != y}
    got = {x["nodo"]: x["capo"] for x in setjoin.greedy_leaders(spark.createDataFrame(sorted(both), "a long, b long"), spark.createDataFrame([(i, i) for i in range(10)], "nodo long, posto long")).collect()}
    want = {}
    for i in range(10):
        heads = sorted(j for j in range(i) if (i, j) in both and want[j] == j)
        want[i] = heads[0] if heads else i
    assert got == want


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([("a", "A", 1), ("b", "B", None)], "k string, n string, p int")
    new = spark.createDataFrame([("b", "C", 5), ("a", "D", None), ("c", "E", None)], "k string, n string, p int")
    assert {tuple(r) for r in tables.upsert(old, new, "k", ["n"]).collect()} == {("a", "D", 1), ("b", "C", 5), ("c", "E", None)}


def test_first_write_and_outcomes(spark):
    d = spark.createDataFrame([(1, "a", "u"), (2, "a", "u"), (3, None, "u"), (4, None, "u")], "id long, e string, u string")
    assert {r["id"] for r in tables.first_write(d, ["e", "u"], "id").collect()} == {1, 3}
    out = tables.insert_new(d.where("id = 1"), d.where("id > 1 and e is not null").unionByName(spark.createDataFrame([(9, "b", "u")], d.schema)), ["e", "u"], "id")
    assert {(r["id"], r["esito"]) for r in out.collect()} == {(2, "duplicato"), (9, "inserito")}


def test_stop_on_known(spark):
    seq = [0, 1, 1, 0, 1, 1, 1, 0, 0]
    d = spark.createDataFrame([("s", i, bool(k)) for i, k in enumerate(seq)], "f string, o long, k boolean")
    assert sorted(r["o"] for r in tables.stop_on_known(d, "f", "o", "k", 3).collect()) == list(range(7))


def test_round_robin(spark):
    d = spark.createDataFrame([("b", 1), ("b", 2), ("a", 3), ("b", 4), ("c", 5), ("a", 6)], "g string, i long")
    assert [r["i"] for r in setjoin.round_robin(d, "g", "i", 5).collect()] == [1, 3, 5, 2, 6]


def test_rank_matches_plain_order(spark):
    from actaspark.operators import rank

    r = random.Random(8)
    data = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, 1, 2, 3])) for i in range(300)]
    d = spark.createDataFrame(data, "i long, g string, v int").repartition(6)
    order = [F.col("v").desc_nulls_last(), F.col("i")]
    want = {}
    for g in ("a", "b", None):
        for n, (i, *_) in enumerate(sorted((x for x in data if x[1] == g), key=lambda x: (x[2] is None, -(x[2] or 0), x[0])), 1):
            want[i] = n
    assert {x["i"]: x["n"] for x in rank.row_number(d, ["g"], order, "n").collect()} == want
    assert {x["i"]: x["n"] for x in rank.top(d, ["g"], order, 3, "n").collect()} == {i: n for i, n in want.items() if n <= 3}
    assert rank.row_number(d.limit(0), ["g"], order, "n").count() == 0


def test_title_stars_match_sequential(spark, monkeypatch):
    """Against the scan of E08, with groups from 0.35 on, contradictory twins and undated acts."""
    monkeypatch.setattr(setjoin, "TILE", 5)
    monkeypatch.setattr(setjoin, "WIDE", 16)
    r = random.Random(3)
    base = ["lavori di manutenzione strade comunali", "fornitura arredi scuola media statale", "servizio mensa scolastica anno", "manutenzione straordinaria strade provinciali lotto"]
    rows = [(i, i % 2, f"{r.choice(base)} {r.choice(['', 'lotto 101', 'lotto 202', 'centro storico', 'zona mare nord'])}", r.choice([None, *(f"2024-01-{x:02}" for x in range(1, 29))])) for i in range(60)]
    rows += [(90, 0, None, None), (91, 0, "", "2024-01-01"), (92, None, "lavori strade", None)]
    a = spark.createDataFrame(rows, "id long, ente_id long, oggetto string, g string").withColumn("giorno", F.to_date("g")).drop("g")
    got = {x["id"]: x["capo"] for x in marts.title_stars(a).collect()}
    t = {x["id"]: x for x in a.where("oggetto <> '' and ente_id is not null").select("id", "ente_id", "giorno", X.trigrams(F.col("oggetto")).alias("t"), X.tokens(F.col("oggetto")).alias("w")).collect()}
    nums = lambda w: sorted(x for x in w if x.isdigit())
    twins = lambda p, q: bool(nums(p) and nums(q) and nums(p) != nums(q)) or (len(p) >= 6 and len(q) >= 6 and p[-6:] != q[-6:])
    want, low = {}, 0
    order = sorted(t.values(), key=lambda x: (x["giorno"] is None, str(x["giorno"]), x["id"]))
    for x in order:
        if x["id"] in want:
            continue
        want[x["id"]] = x["id"]
        for y in order:
            if y["id"] not in want and y["ente_id"] == x["ente_id"]:
                both = len(set(x["t"]) & set(y["t"]))
                jac = both / (len(x["t"]) + len(y["t"]) - both)
                if jac >= 0.35 and not (jac >= 0.75 and twins(x["w"], y["w"])):
                    want[y["id"]] = x["id"]
                    low += jac < 0.75
    assert got == want and low
