"""Schemas that drift between the files of a feed: one table, and a report of every change.

Each field of a file is profiled by mergeable sketches (hashed words, code shapes, magnitudes, months,
kinds). Fields that one file of a feed has and the next has not are matched by a bipartite assignment
over sketch and name similarity; matched pairs are renames. The chain of matches gives each field its
lineage, by which files are read into one table.

Nulls: a null line counts as a line without fields; a null header gives a file without fields. Lines that are not
valid JSON objects give no fields. Cells beyond the header are dropped, missing ones are null. Files with equal
delivery times follow each other by file_id; file rows repeated for one file_id count once.
"""

from __future__ import annotations

import csv
import io
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from actaspark.storage import materialise

#: Kinds by fixed pattern, the first that holds; what none matches is text.
KINDS = (
    ("list", r"(?s)\A\[.*\]\z"), ("object", r"(?s)\A\{.*\}\z"), ("boolean", r"(?i)\A(true|false)\z"), ("date_dmy", r"\A[0-9]{2}/[0-9]{2}/[0-9]{4}\z"),
    ("date_iso", r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([T ].*)?\z"), ("whole", r"\A[+-]?[0-9]+\z"), ("decimal_point", r"\A[+-]?[0-9]+\.[0-9]+([eE][+-]?[0-9]+)?\z"),
    ("decimal_comma", r"\A[+-]?[0-9]{1,3}(\.[0-9]{3})+,[0-9]+\z|\A[+-]?[0-9]+,[0-9]+\z"),
)
TARGET = (
    "cig", "anno_pubblicazione", "mese_pubblicazione", "cf_amministrazione", "denominazione_amministrazione", "sezione_regionale", "oggetto_principale_contratto",
    "tipo_appalto", "importo_totale_appalto", "codice_scelta_contraente", "descrizione_scelta_contraente", "numero_gara", "data_creazione",
)
#: Least similarity of a rename; buckets of hashed words.
LEAST, WORDS = 0.42, 128


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells(line: pd.Series) -> pd.Series:
    def one(s):
        if s is None:
            return None
        csv.field_size_limit(1 << 30)
        try:
            return next(csv.reader(io.StringIO(s, newline=""), delimiter=";", skipinitialspace=True), [])
        except csv.Error:
            return s.split(";")

    return line.map(one)


def field_name(c: Column) -> Column:
    """Trimmed, unquoted, lower case, without a byte order mark."""
    return F.lower(F.trim(F.regexp_replace(c, "^[\\s﻿\"']+|[\\s\"']+$", "")))


def entries(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every cell as (file_id, riga, campo, valore); an empty csv cell and a JSON null have a null valore.

    A csv header gives one entry per field on riga 0 with a null valore, so fields without any value are there too.
    """
    f = files.select("file_id", F.lower("formato").alias("formato")).dropDuplicates(["file_id"])
    rows = lines.select("file_id", "riga", "contenuto").join(f, "file_id")
    js = rows.where("formato = 'jsonl'").select("file_id", "riga", F.explode(F.map_entries(F.from_json("contenuto", "map<string,string>"))).alias("e"))
    js = js.select("file_id", "riga", field_name(F.col("e.key")).alias("campo"), F.col("e.value").alias("valore"))
    cells = rows.where("formato = 'csv'").select("file_id", "riga", _cells("contenuto").alias("cells"))
    head = cells.where("riga = 0").select("file_id", F.transform("cells", field_name).alias("head")).dropDuplicates(["file_id"])
    body = cells.join(head, "file_id").select("file_id", "riga", F.posexplode("head").alias("i", "campo"), "cells")
    value = F.when(F.col("riga") > 0, F.get("cells", F.col("i")))
    cs = body.select("file_id", "riga", "campo", F.when(F.trim(value) != "", F.trim(value)).alias("valore"))
    return js.unionByName(cs).where("campo <> ''")


def kind(v: Column) -> Column:
    out = F.lit("text")
    for name, pattern in reversed(KINDS):
        out = F.when(v.rlike(pattern), name).otherwise(out)
    return F.when(v.isNotNull(), out)


def _features(v: Column, k: Column) -> Column:
    """Features of a value as text, each from a bounded set: kind, month, magnitude, code shape, first letter, hashed words."""
    bare = F.regexp_replace(v, r"[^\p{L}\p{N}]", "")
    number = F.when(k == "decimal_comma", F.regexp_replace(F.regexp_replace(v, r"\.", ""), ",", ".")).when(k.isin("whole", "decimal_point"), v).try_cast("double")
    month = (
        F.when(k == "date_dmy", F.concat(F.substring(v, 7, 4), F.substring(v, 4, 2)))
        .when(k == "date_iso", F.concat(F.substring(v, 1, 4), F.substring(v, 6, 2)))
        .when((k == "whole") & v.rlike(r"\A(19|20)[0-9]{2}(0[1-9]|1[0-2])([0-2][0-9]|3[01])\z"), F.substring(v, 1, 6))
    )
    plain = F.lower(F.when(k == "object", F.regexp_replace(v, r'"[^"]*"\s*:', " ")).otherwise(v))
    # every word counts; a value has at most one feature of each bucket
    words = F.array_distinct(
        F.transform(F.filter(F.split(plain, r"[^\p{L}]+"), lambda w: F.length(w) >= 3), lambda w: F.concat(F.lit("t"), F.pmod(F.xxhash64(w), F.lit(WORDS)).cast("string")))
    )
    code = ~v.rlike(r"\s") & k.isin("text", "whole") & month.isNull()
    shape = F.concat(F.lit("c"), F.when(bare.rlike("[0-9]"), "9").otherwise(""), F.when(bare.rlike(r"\p{L}"), "a").otherwise(""), F.least(F.length(bare), F.lit(20)).cast("string"))
    magnitude = F.when(number.isNotNull() & month.isNull(), F.concat(F.lit("m"), F.coalesce(F.floor(F.log10(F.greatest(F.abs(number), F.lit(0.1))) * 2), F.lit(-2)).cast("string")))
    single = F.array(F.concat(F.lit("k"), k), F.concat(F.lit("y"), month), magnitude, F.when(code, shape), F.when(code & bare.rlike(r"\A\p{L}"), F.concat(F.lit("p"), F.upper(F.substring(bare, 1, 1)))))
    return F.concat(F.filter(single, lambda x: x.isNotNull()), F.when(k.isin("text", "list", "object"), words).otherwise(F.array().cast("array<string>")))


def profiles(cells: DataFrame) -> DataFrame:
    """(file_id, campo, n, sketch): n counts non-null values, sketch maps each feature to its count. Mergeable by addition."""
    k = cells.withColumn("k", kind(F.col("valore")))
    feats = F.when(F.col("valore").isNull(), F.array(F.lit("null"))).otherwise(F.concat(F.array(F.lit("n")), _features(F.col("valore"), F.col("k"))))
    counts = k.select("file_id", "campo", F.explode(feats).alias("x")).groupBy("file_id", "campo", "x").count()
    return counts.groupBy("file_id", "campo").agg(F.sum(F.when(F.col("x") == "n", F.col("count")).otherwise(0)).alias("n"), F.map_from_entries(F.collect_list(F.struct("x", "count"))).alias("sketch"))


def order(files: DataFrame) -> DataFrame:
    """(file_id, prima): each file and the one before it in its feed."""
    w = Window.partitionBy("flusso").orderBy("caricato_il", "file_id")
    return files.select("file_id", "flusso", "caricato_il").dropDuplicates(["file_id"]).select("file_id", F.lag("file_id").over(w).alias("prima"))


def _hist(sketch: dict, first: str) -> dict[str, float]:
    h = {k[1:]: float(v) for k, v in sketch.items() if k[0] == first and k not in ("n", "null")}
    s = sum(h.values())
    return {k: v / s for k, v in h.items()} if s else {}


def _overlap(a: dict, b: dict) -> float:
    return sum(min(v, b.get(k, 0.0)) for k, v in a.items())


def _cosine(a: dict, b: dict) -> float:
    d = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b.get(k, 0.0) for k, v in a.items()) / d if d else 0.0


def _near(a: dict, b: dict, shift: float = 0.0) -> float:
    """1 less the distance of two histograms over a scale, in steps, against a width of four steps."""
    mean = lambda h: sum(float(k) * v for k, v in h.items())
    return max(0.0, 1 - abs(mean(a) - mean(b) + shift) / 4)


def name_similarity(a: str, b: str) -> float:
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    x, y = grams(a), grams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def similarity(a: dict, b: dict, name_a: str, name_b: str) -> float:
    """How alike two fields are, from sketches and names, 0 to about 1."""
    name = name_similarity(name_a, name_b)
    na, nb = a.get("n", 0), b.get("n", 0)
    if not na or not nb:
        return name
    ka, kb = _hist(a, "k"), _hist(b, "k")
    ya, yb = _hist(a, "y"), _hist(b, "y")
    dated = lambda s, y: sum(v for k, v in s.items() if k[0] == "y") / s["n"]
    da, db = dated(a, ya), dated(b, yb)
    if max(da, db) > 0.5:
        if min(da, db) <= 0.5:
            return 0.3 * name
        months = lambda h: {str(int(k[:4]) * 12 + int(k[4:])): v for k, v in h.items()}
        return 0.45 + 0.25 * _near(months(ya), months(yb)) * (1.0 if ka.keys() & kb.keys() else 0.9) + 0.3 * name
    parts = []
    wa, wb = _hist(a, "t"), _hist(b, "t")
    ca, cb = _hist(a, "c"), _hist(b, "c")
    spaced = lambda s: 1 - sum(v for k, v in s.items() if k[0] == "c") / s["n"]
    numeric = lambda k: sum(k.get(x, 0) for x in ("whole", "decimal_point", "decimal_comma"))
    if numeric(ka) > 0.5 and numeric(kb) > 0.5:
        ma, mb = _hist(a, "m"), _hist(b, "m")
        cents = (ka.get("whole", 0) > 0.5) != (kb.get("whole", 0) > 0.5)
        # decimals that become whole numbers are counted in cents from then on, and back
        parts.append((1.0, _near(ma, mb, (-4.0 if ka.get("whole", 0) > 0.5 else 4.0) if cents else 0.0)))
    elif spaced(a) > 0.5 and spaced(b) > 0.5:
        parts.append((1.0, _cosine(wa, wb)))
    elif spaced(a) <= 0.5 and spaced(b) <= 0.5:
        words = bool(wa and wb) and not any("9" in x for x in {**ca, **cb})
        parts.append((1.0, _cosine(wa, wb) if words else 0.6 * _cosine(ca, cb) + 0.4 * _overlap(_hist(a, "p"), _hist(b, "p")) if (_hist(a, "p") and _hist(b, "p")) else _cosine(ca, cb)))
    else:
        parts.append((1.0, 0.5 * _cosine(wa, wb)))
    return 0.7 * sum(w * s for w, s in parts) / sum(w for w, _ in parts) + 0.3 * name


def assign(score: list[list[float]]) -> list[int]:
    """The column of each row in an assignment of the largest sum (shortest augmenting paths); -1 where columns run out."""
    n, m = len(score), len(score[0]) if score else 0
    if n > m:
        back = assign([list(c) for c in zip(*score)]) if m else []
        out = [-1] * n
        for j, i in enumerate(back):
            out[i] = j
        return out
    u, v, p = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        p[0], j0, low, way, used = i, 0, [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while p[j0]:
            used[j0], i0, delta, j1 = True, p[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = -score[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(m + 1):
                if used[j]:
                    u[p[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for file_id, gone, come in zip(pdf["file_id"], pdf["gone"], pdf["come"]):
            gone, come = sorted(gone, key=lambda x: x["campo"]), sorted(come, key=lambda x: x["campo"])
            pair = [[({e["key"]: e["value"] for e in x["sketch"]}, x["campo"]) for x in side] for side in (gone, come)]
            s = [[similarity(g, c, x, y) for c, y in pair[1]] for g, x in pair[0]]
            s = [[x if x >= LEAST else -1.0 for x in r] for r in s]
            for g, j in enumerate(assign(s)):
                if j >= 0 and s[g][j] >= LEAST:
                    rows.append((file_id, pair[0][g][1], pair[1][j][1], s[g][j]))
        yield pd.DataFrame(rows, columns=["file_id", "precedente", "campo", "somiglianza"])


def links(profile: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, prima, campo, precedente, rinominato): each field that goes on from the previous file, by name or by match."""
    o = order(files)
    now = profile.join(o.where("prima is not null"), "file_id").select("file_id", "prima", "campo", "sketch")
    old = o.where("prima is not null").join(profile.select(F.col("file_id").alias("prima"), "campo", F.col("sketch").alias("sketch_p")), "prima")
    both = now.join(old, ["file_id", "prima", "campo"], "full")
    same = both.where(F.col("sketch").isNotNull() & F.col("sketch_p").isNotNull()).select("file_id", "prima", "campo", F.col("campo").alias("precedente"), F.lit(False).alias("rinominato"))
    field = lambda s: F.collect_list(F.when(F.col(s).isNotNull(), F.struct("campo", F.map_entries(s).alias("sketch"))))
    # a pair of files has as many rows here as fields that differ, each with a sketch of bounded size
    apart = both.where(F.col("sketch").isNull() | F.col("sketch_p").isNull()).groupBy("file_id").agg(field("sketch_p").alias("gone"), field("sketch").alias("come"))
    moved = apart.where((F.size("gone") > 0) & (F.size("come") > 0)).mapInPandas(_match, "file_id long, precedente string, campo string, somiglianza double")
    moved = moved.join(o, "file_id").select("file_id", "prima", "campo", "precedente", F.lit(True).alias("rinominato"))
    return same.unionByName(moved)


def field_kinds(profile: DataFrame, link: DataFrame) -> DataFrame:
    """(file_id, campo, tipo): the kind of most non-null values, or that of the field it goes on from if all are null.

    Of kinds with equal counts the alphabetically first is taken. Null kinds are resolved by doubling jumps along the links, so a
    run of n such files takes log n rounds.
    """
    best = F.array_sort(F.transform(F.filter(F.map_entries("sketch"), lambda e: e["key"].startswith("k") & (e["key"] != "null")), lambda e: F.struct((-e["value"]).alias("n"), F.substring(e["key"], 2, 40).alias("k"))))
    own = profile.select("file_id", "campo", F.get(best, F.lit(0))["k"].alias("tipo"))
    state = own.join(link.select("file_id", "campo", "prima", "precedente"), ["file_id", "campo"], "left")
    state = materialise(state, "kinds")
    while state.where("tipo is null and prima is not null").limit(1).count():
        up = state.select(F.col("file_id").alias("prima"), F.col("campo").alias("precedente"), F.col("tipo").alias("t2"), F.col("prima").alias("p2"), F.col("precedente").alias("c2"))
        open_ = F.col("tipo").isNull()
        j = state.join(up, ["prima", "precedente"], "left")
        state = materialise(j.select("file_id", "campo", F.coalesce("tipo", "t2").alias("tipo"), F.when(open_, F.col("p2")).otherwise(F.col("prima")).alias("prima"), F.when(open_, F.col("c2")).otherwise(F.col("precedente")).alias("precedente")), "kinds")
    return state.select("file_id", "campo", "tipo")


def analyse(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles, links and cells, each written once."""
    cells = entries(files, lines)
    profile = materialise(profiles(cells), "profiles")
    return profile, materialise(links(profile, files), "links"), cells


def found(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Each change of a file against the one before it in its feed (TESTDATA.md, p3_found)."""
    profile, link, _ = analyse(files, lines)
    o = order(files).where("prima is not null")
    kinds = field_kinds(profile, link)
    out = lambda df, what, field, old: df.select("file_id", F.lit(what).alias("modifica"), F.col(field).alias("campo"), old.alias("precedente"))
    renamed = out(link.where("rinominato"), "rinominato", "campo", F.col("precedente"))
    # a file without any field still follows its predecessor, whose fields are then all removed
    added = out(profile.select("file_id", "campo").join(o, "file_id").join(link, ["file_id", "campo"], "left_anti"), "aggiunto", "campo", F.lit(""))
    before = o.join(profile.select(F.col("file_id").alias("prima"), F.col("campo").alias("precedente")), "prima")
    removed = out(before.join(link, ["file_id", "precedente"], "left_anti"), "rimosso", "precedente", F.lit(""))
    old = kinds.select(F.col("file_id").alias("prima"), F.col("campo").alias("precedente"), F.col("tipo").alias("tipo_p"))
    retyped = link.join(kinds, ["file_id", "campo"]).join(old, ["prima", "precedente"]).where("tipo <> tipo_p")
    return added.unionByName(removed).unionByName(renamed).unionByName(out(retyped, "tipo", "campo", F.lit("")))


def canonical_names(link: DataFrame, profile: DataFrame) -> DataFrame:
    """(campo, colonna): the target column of each field name, itself or along the most often seen renames."""
    e = link.where("rinominato").groupBy("campo", "precedente").count()
    e = materialise(e.select("campo", "precedente", "count").unionByName(e.select(F.col("precedente").alias("campo"), F.col("campo").alias("precedente"), "count")), "renames")
    known = profile.select("campo").distinct().where(F.col("campo").isin(*TARGET)).select("campo", F.col("campo").alias("colonna"))
    known = materialise(known, "canonical")
    while True:  # as many rounds as the longest chain of aliases
        w = Window.partitionBy("campo").orderBy(F.desc("count"), "colonna")
        new = e.join(known.select(F.col("campo").alias("precedente"), "colonna"), "precedente").join(known, "campo", "left_anti")
        new = new.groupBy("campo", "colonna").agg(F.sum("count").alias("count")).withColumn("r", F.row_number().over(w)).where("r = 1").select("campo", "colonna")
        new = materialise(new, "canonical")
        if not new.limit(1).count():
            return known
        known = materialise(known.unionByName(new), "canonical")


def _written_as_target(column: Column, v: Column, k: Column) -> Column:
    plain = (
        F.when(k == "object", F.coalesce(F.get_json_object(v, "$.nome"), v)).when(k == "list", F.coalesce(F.get_json_object(v, "$[0]"), v)).otherwise(v)
    )
    euro = F.when(k == "whole", F.format_string("%s", (v.try_cast("decimal(38,0)") / 100).cast("decimal(38,2)").cast("string"))).when(k == "decimal_point", v.try_cast("decimal(38,2)").cast("string"))
    day = F.when(k == "date_iso", F.try_to_date(F.substring(v, 1, 10), "yyyy-MM-dd")).when(k == "whole", F.try_to_date(v, "yyyyMMdd"))
    return (
        F.when((column == "importo_totale_appalto") & euro.isNotNull(), F.regexp_replace(euro, r"\.", ","))
        .when((column == "data_creazione") & day.isNotNull(), F.date_format(day, "dd/MM/yyyy"))
        .otherwise(plain)
    )


def unified(files: DataFrame, lines: DataFrame) -> DataFrame:
    """All files as one table: file_id, riga and the target columns, each value written as the target writes it.

    Amounts in whole numbers are cents (feeds switch between euros with decimals and cents). Fields without a
    target column are left to the report. Where a row holds two fields of one column, the first by name is taken.
    """
    profile, link, cells = analyse(files, lines)
    names = canonical_names(link, profile)
    c = cells.join(names, "campo", "left").withColumn("k", kind(F.col("valore"))).withColumn("v", _written_as_target(F.col("colonna"), F.col("valore"), F.col("k")))
    first = lambda t: F.min(F.when((F.col("colonna") == t) & F.col("v").isNotNull(), F.struct("campo", "v")))["v"]
    rows = c.where("riga > 0").groupBy("file_id", "riga").agg(*[first(t).alias(t) for t in TARGET])
    return rows.select("file_id", F.col("riga").cast("int").alias("riga"), *TARGET)
