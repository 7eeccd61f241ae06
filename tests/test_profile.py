import random
from collections import defaultdict
from statistics import median

from pyspark.sql import functions as F

from actaspark.operators import profile
from actaspark.operators.quantile import grouped_median

LAYOUT = "id long, data_accesso string, data_atto string, importo_euro double, cig string, valore string, n long"


def rows(spark, data):
    return spark.createDataFrame([(i, *r, "x", 7) for i, r in enumerate(data)], LAYOUT)


def test_grouped_median_matches_brute_force(spark):
    r = random.Random(1)
    data = [(r.choice("abc"), float(r.randint(0, 40)), r.randint(1, 5)) for _ in range(500)] + [("a", None, 3), ("d", 1.0, 1)]
    got = {x["g"]: x["median"] for x in grouped_median(spark.createDataFrame(data, "g string, v double, k long").repartition(7), ["g"], "v", "k").collect()}
    want = defaultdict(list)
    for g, v, k in data:
        if v is not None:
            want[g] += [v] * k
    assert got == {g: median(v) for g, v in want.items()}


def test_row_defects(spark):
    day = "2024-05-10T01:00:00+00:00"
    d = rows(spark, [
        (day, "2024-02-30", float("nan"), "AAAAAAAAAA"), (day, "2024-05-11", -1.0, "abc"), (day, "1989-12-31", 1e8 + 1, "A1B2C3D4E5"), (day, "2024-5-1", 1e8, "A1B2C3D4E5\n"),
        (day, None, None, None), (day, "2024-05-10", 0.0, "0123456789"), (None, "2024-05-10", 1.0, ""), (day, "", 1.0, None),
    ])
    got = {(int(x["chiave"]), x["campo"], x["difetto"]) for x in profile.found(d).collect()}
    assert got == {
        (0, "data_atto", "formato"), (0, "importo_euro", "formato"), (0, "cig", "formato"), (1, "data_atto", "intervallo"), (1, "importo_euro", "intervallo"), (1, "cig", "formato"),
        (2, "data_atto", "intervallo"), (2, "importo_euro", "intervallo"), (3, "data_atto", "formato"), (3, "cig", "formato"), (6, "cig", "formato"), (7, "data_atto", "formato"),
    }


def test_load_defects(spark):
    good = [("2024-01-01", f"2023-12-{1 + i % 28:02d}", 100.0 + i, f"A{i:09d}") for i in range(60)]
    odd = [("2024-02-02", None, 100_000.0, "B123456789") for _ in range(20)]
    small = [("2024-03-03", None, None, None) for _ in range(19)]
    got = {(x["chiave"], x["campo"], x["difetto"]) for x in profile.found(rows(spark, good + odd + small)).where("ambito = 'carico'").collect()}
    assert got == {("2024-02-02", "data_atto", "nulli"), ("2024-02-02", "importo_euro", "spostamento"), ("2024-02-02", "cig", "spostamento")}


def test_deltas_take_back(spark):
    v = profile.ValueCounts(spark)
    a, b = rows(spark, [("2024-01-01", None, 1.0, "x")] * 3), rows(spark, [("2024-01-01", None, 1.0, "x")])
    v.apply(a, F.lit("l1"), ["cig"]).apply(b, F.lit("l1"), ["cig"], -1)
    assert [tuple(r) for r in v.counts().collect()] == [("l1", "cig", "x", 2)]
    assert [tuple(r) for r in v.compact().counts().collect()] == [("l1", "cig", "x", 2)]
    v.apply(b, F.lit("l1"), ["cig"], -1).apply(b, F.lit("l1"), ["cig"], -1)
    assert v.counts().count() == 0 and v.check().count() == 0
    v.drop()


def test_empty(spark):
    d = rows(spark, [("2024-01-01", None, None, None)]).limit(0)
    assert profile.found(d).count() == 0 and profile.profile(d).count() == 0
    p = {r["campo"]: r for r in profile.profile(rows(spark, [("2024-01-01", None, 5.0, "A1B2C3D4E5")] * 2 + [("2024-01-01", None, 6.0, None)] * 2)).collect()}
    assert p["importo_euro"]["entropia"] == 1.0 and p["importo_euro"]["distinti"] == 2 and p["data_atto"]["nulli"] == 4 and p["data_atto"]["minimo"] is None
