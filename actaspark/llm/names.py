"""Variant spellings of organisation names, resolved to registered bodies by merging and matching again.

A profile starts as a registered body, or as a name used only outside the registry's region, with one spelling. Every other spelling is
blocked against the spellings of all profiles (deletion neighbourhoods of its longest word and of the whole name, and the tax codes
that belong to the profile), verified by edit distance after expanding abbreviations, and merged into the nearest profile.
Merging unions spellings, initials and tax codes, so the richer profile enters blocking again; rounds go on until
none merges. A spelling that is as near to two profiles merges into neither.

Work is done on distinct spellings, not on rows; a body that holds a third of all rows has no more spellings for it. Pairs
come from equal blocking keys only.

Null, blank and placeholder names (under three letters) resolve to nothing. Repeated rows resolve each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from actaspark.storage import materialise

#: Kinds of body by their words; the first kind whose pattern is found holds. Names without any are municipalities.
KINDS = (
    ("scuola", r"\b(?:istituto|ist\.?) (?:comprensivo|compr\.?)|\bi\.? ?c\.?(?= )|\b(?:liceo|scuola|direzione didattica)\b"),
    ("case", r"\bcase pop|\bi\.? ?a\.? ?c\.? ?p\b"),
    ("sanita", r"\baz(?:ienda|\.) san(?:itaria|\.)|\ba\.? ?s\.? ?p\b"),
    ("impresa", r"\baz(?:ienda|\.) spec|\bs\.? ?r\.? ?l\b|\bs\.? ?p\.? ?a\b|\b(?:cooperativa|societa|servizi srl)\b"),
    ("bonifica", r"\bbon(?:ifica|\.)|\bc\.? ?d\.? ?b\b"),
    ("provincia", r"\blib(?:ero|\.) +cons|\bcons(?:orzio|\.) com(?:unale|\.) lib|\bl\.? ?c\.? ?c\b|\bprovincia\b"),
    ("unione", r"\bun(?:ione|\.) (?:dei )?com|\bu\.? ?d\.? ?c\b"),
)
WORDS = {
    "scuola": "istituto comprensivo statale ic", "case": "istituto autonomo case popolari iacp", "sanita": "azienda sanitaria provinciale asp prov.le",
    "impresa": "azienda speciale servizi", "bonifica": "consorzio bonifica cdb", "provincia": "libero consorzio comunale ex provincia regionale lcc",
    "unione": "unione comuni udc", "comune": "comune municipio citta amministrazione comunale c.ne",
}
PARTICLES = frozenset("di dei del della delle degli de d da dal alla al la il lo le e".split())
OFFICES = r"(?:area|settore|ufficio|uffici|direzione|servizio|servizi|dipartimento|sezione|unita|centrale|u\.o\.|uff\.|sett\.|dir\.|serv\.)"
#: Greatest distance of one spelling to a profile's and to its registered name; with a tax code of the profile, to its registered name.
NEAR, FAR, SUPPORTED = 1, 2, 3


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.replace("’", "'").lower())
    return re.sub(r"\s+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip()


def _abbreviates(short: str, word: str) -> bool:
    """Whether the letters of short start with word's first letter and follow each other in it."""
    if not short or short[0] != word[0] or len(short) >= len(word):
        return False
    it = iter(word)
    return all(c in it for c in short)


def parse(name: str | None) -> tuple[str, str, str] | None:
    """(kind, form, province): form holds the words of the name proper, abbreviations ending in a dot; province is '' if not stated."""
    if not name:
        return None
    t = fold(name)
    province = ""
    m = re.search(r"\(([a-z]{2})\)", t)
    if m:
        province, t = m.group(1).upper(), (t[: m.start()] + " " + t[m.end() :])
    t = re.sub(rf"(?:\s-\s*|\s*/\s*|\s*–\s*|,\s*){OFFICES}\b.*$", "", re.sub(r"\s+", " ", t))
    t = re.sub(r"\s*/.*$", "", t)
    t = re.sub(r"\b(ist|com)\.(?=[a-z])", r"\1. ", t)
    kind = next((k for k, p in KINDS if re.search(p, t)), "comune")
    own = WORDS[kind].split()
    t = re.sub(r"\.(?=[a-z]{5,})|(?<=[a-z]{3})\.(?=[a-z]{4,})|\.(?=di\b)", ". ", t)
    words = []
    for w in re.findall(r"[a-z]+(?:\.[a-z]+)*\.?", t.replace("'", " ")):
        bare = w.replace(".", "")
        if w in own or bare in own or bare in PARTICLES:
            continue
        if "." in w and any(_abbreviates(bare, o.replace(".", "")) for o in own) and (len(bare) > 1 or kind != "comune") and not (kind == "comune" and words):
            continue
        words.append(bare + "." if "." in w or len(w) == 1 else w)
    form = " ".join(words)
    return (kind, form, province) if sum(c.isalpha() for c in form) >= 3 else None


def _distance(a: str, b: str, most: int) -> int:
    """Edits, insertions, deletions and swaps of neighbours between a and b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _expand(words: list[str], by: list[str]) -> list[str]:
    full = [w for w in by if not w.endswith(".")]
    short = {w[0] for w in by if w.endswith(".")}
    return [next((f for f in full if _abbreviates(w[:-1], f)), w[0] if w[0] in short else w[:-1]) if w.endswith(".") else w for w in words]


def form_distance(a: str, b: str, most: int = SUPPORTED) -> int:
    """Distance of two forms, each one's abbreviations expanded by the other, whatever the order of words and spaces."""
    x, y = a.split(), b.split()
    x, y = _expand(x, y), _expand(y, x)
    return min(_distance("".join(x), "".join(y), most), _distance("".join(sorted(x)), "".join(sorted(y)), most))


def block_keys(kind: str, form: str) -> list[str]:
    """The longest word and the whole name, each as it is and with any one letter left out."""
    words = form.split()
    root = max((w for w in words if not w.endswith(".")), key=len, default=words[0])
    out = set()
    for s in {root, "".join(w.rstrip(".") for w in words)}:
        out.add(s)
        out.update(s[:i] + s[i + 1 :] for i in range(len(s)))
    return sorted(f"{kind}|{k}" for k in out)


def _parsed(names: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, *p) for n in b["nome"] if (p := parse(n))]
            yield pd.DataFrame(rows, columns=["nome", "genere", "forma", "prov"])

    return names.select("nome").where("nome is not null").distinct().mapInPandas(run, "nome string, genere string, forma string, prov string")


def _keys(forms: DataFrame) -> DataFrame:
    """(genere, forma, chiave)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(g, f, k) for g, f in zip(b["genere"], b["forma"]) for k in block_keys(g, f)]
            yield pd.DataFrame(rows, columns=["genere", "forma", "chiave"])

    return forms.select("genere", "forma").mapInPandas(run, "genere string, forma string, chiave string")


def _verified(pairs: DataFrame) -> DataFrame:
    """(genere, forma, profilo, d): accepted pairs. pairs: genere, forma, profilo, altra, base, cf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g, f, p, other, base, cf in zip(b["genere"], b["forma"], b["profilo"], b["altra"], b["base"], b["cf"]):
                to_base = form_distance(f, base)
                near = form_distance(f, other, NEAR) if other != base else to_base
                short = min(len(f), len(base)) < 6
                if to_base <= (SUPPORTED if cf and not short else 1 if short else FAR) and (near <= NEAR or cf):
                    rows.append((g, f, p, to_base))
            yield pd.DataFrame(rows, columns=["genere", "forma", "profilo", "d"]).astype({"profilo": "str", "d": "int32"})

    return pairs.mapInPandas(run, "genere string, forma string, profilo string, d int")


def resolve(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """(genere, forma, profilo): the profile of each form. Profiles of registered names are ``R|genere|forma``, others ``F|...``.

    rows: nome, cf, regione; registry: nome. Bodies of one name share a profile; ``link`` tells them apart.
    """
    parsed = materialise(_parsed(rows.select("nome").unionByName(registry.select("nome"))), "parsed")
    reg = registry.select("nome").distinct().join(parsed, "nome").select("genere", "forma").distinct().withColumn("registrata", F.lit(True))
    usage = rows.where("nome is not null").groupBy("nome", "cf", "regione").agg(F.count(F.lit(1)).alias("n")).join(parsed, "nome").groupBy("genere", "forma", "cf", "regione").agg(F.sum("n").alias("n"))
    usage = materialise(usage.join(reg, ["genere", "forma"], "left"), "usage")
    home = usage.where("registrata and regione is not null").groupBy("regione").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "regione").limit(1).collect()
    home_region = home[0]["regione"] if home else None
    there = F.col("regione").isNotNull() & (F.col("regione") != F.lit(home_region)) if home_region is not None else F.lit(False)
    foreign = usage.where("registrata is null").groupBy("genere", "forma").agg(F.sum(F.when(there, F.col("n")).otherwise(0)).alias("f"), F.sum(F.when(F.col("regione").isNotNull(), F.col("n")).otherwise(0)).alias("t"))
    foreign = foreign.where("f > 0 and f * 2 > t").select("genere", "forma")
    seed = lambda df, mark: df.select("genere", "forma", F.concat(F.lit(mark + "|"), "genere", F.lit("|"), "forma").alias("profilo"), F.lit(0).alias("d"))
    known = materialise(seed(reg, "R").unionByName(seed(foreign, "F")), "known")
    base = known.select("profilo", F.col("forma").alias("base"))
    base = materialise(base, "base")
    forms = parsed.select("genere", "forma").distinct()
    keys = materialise(_keys(forms), "keys")
    code = usage.where("cf is not null").groupBy("genere", "forma", "cf").agg(F.sum("n").alias("n"))
    while True:
        left = forms.join(known, ["genere", "forma"], "left_anti")
        mine = keys.join(known.select("genere", "forma", "profilo"), ["genere", "forma"]).select("chiave", "profilo", F.col("forma").alias("altra"))
        by_key = keys.join(left, ["genere", "forma"]).join(mine, "chiave").select("genere", "forma", "profilo", "altra").distinct().withColumn("cf", F.lit(False))
        # a tax code belongs to the profile that most of its rows have, if that is more than half of them
        held = code.join(known.select("genere", "forma", "profilo"), ["genere", "forma"]).groupBy("cf", "genere", "profilo").agg(F.sum("n").alias("n"))
        total = code.groupBy("cf").agg(F.sum("n").alias("t"))
        held = held.join(total, "cf").where("n * 2 > t and n > 1").select("cf", "genere", "profilo")
        by_code = code.join(left, ["genere", "forma"]).join(held, ["cf", "genere"]).select("genere", "forma", "profilo").distinct()
        by_code = by_code.join(base, "profilo").select("genere", "forma", "profilo", F.col("base").alias("altra"), F.lit(True).alias("cf"))
        pairs = by_key.unionByName(by_code).groupBy("genere", "forma", "profilo", "altra").agg(F.max("cf").alias("cf")).join(base, "profilo")
        ok = _verified(pairs.select("genere", "forma", "profilo", "altra", "base", "cf")).groupBy("genere", "forma", "profilo").agg(F.min("d").alias("d"))
        w = Window.partitionBy("genere", "forma")
        best = ok.withColumn("m", F.min("d").over(w)).where("d = m").withColumn("k", F.count(F.lit(1)).over(w)).where("k = 1")
        new = materialise(best.select("genere", "forma", "profilo", "d"), "merged")
        if not new.limit(1).count():
            return materialise(parsed.join(known.select("genere", "forma", "profilo"), ["genere", "forma"]), "resolved").withColumn("casa", F.lit(home_region).cast("string"))
        known = materialise(known.unionByName(new), "known")


def link(tenders: DataFrame, bodies: DataFrame) -> DataFrame:
    """(riga_id, ente_id) of every tender row whose name is a registered body's.

    Among bodies of one name the stated province decides, else the tax code that rows with a stated province give one of them;
    rows for which neither does are left out. A row of another region, or with a province no body of the name has, names no registered body.
    """
    r = tenders.select("riga_id", F.col("denominazione_amministrazione").alias("nome"), F.when(F.length(F.trim("cf_amministrazione")) == 11, F.trim("cf_amministrazione")).alias("cf"), F.lower(F.trim("sezione_regionale")).alias("regione"))
    r = r.withColumn("regione", F.when(F.col("regione") != "", F.col("regione")))
    e = bodies.select(F.col("id").alias("ente_id"), F.col("denominazione").alias("nome"), F.upper("provincia").alias("provincia"))
    resolved = resolve(r.select("nome", "cf", "regione"), e.select("nome"))
    of = e.join(resolved.where("profilo like 'R|%'").select("nome", "profilo", F.col("prov").alias("p2")), "nome")
    of = of.select("ente_id", "profilo", F.coalesce("provincia", F.when(F.col("p2") != "", F.col("p2"))).alias("provincia"))
    of = materialise(of.withColumn("bodies", F.count(F.lit(1)).over(Window.partitionBy("profilo"))), "bodies")
    named = r.join(resolved.where("profilo like 'R|%'").select("nome", "profilo", "prov", "casa"), "nome")
    named = named.where("casa is null or regione is null or regione = casa").drop("casa", "nome", "regione")
    sure = named.join(of, "profilo").where("(prov <> '' and (provincia = prov or provincia is null)) or (prov = '' and bodies = 1)").select("riga_id", "ente_id", "profilo", "cf", "bodies")
    open_ = named.where("prov = ''").join(of.where("bodies > 1").select("profilo").distinct(), "profilo")
    w = Window.partitionBy("profilo", "cf").orderBy(F.desc("n"), "ente_id")
    codes = sure.where("bodies > 1 and cf is not null").groupBy("profilo", "cf", "ente_id").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(w)).where("k = 1").select("profilo", "cf", "ente_id")
    return sure.select("riga_id", "ente_id").unionByName(open_.join(codes, ["profilo", "cf"]).select("riga_id", "ente_id")).distinct()
