"""Column expressions on titles, dates and sets; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Stop words of title comparison in chains, and of reopenings; fixed values.
STOP = "di il la le gli i un una dei delle dello della per da con su tra fra non del al e è art n nr n°".split()
REOPENING_STOP = (
    "e di da il la lo a an the in on at is are per su con del della dei delle anno mese giorno data n nr n. numero "
    "provincia comune regione sicilia ente amministrazione"
).split()
#: Vowels with a combining accent and their composed forms.
_COMPOSED = {f"{v}{m}": c for m, row in (("\u0300", "àèìòù"), ("\u0301", "áéíóú")) for v, c in zip("aeiou", row)}


def iso_date(c: Column) -> Column:
    """The date of a value written YYYY-MM-DD, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def event_date(signed: Column, published: Column) -> Column:
    """The day an act counts from: its own date, else that of publication."""
    return F.coalesce(iso_date(signed), iso_date(published))


def composed(c: Column) -> Column:
    """Vowels with combining accents as one character each, in lower-case text."""
    out = c
    for k, v in _COMPOSED.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(c.rlike("[\u0300\u0301]"), out).otherwise(c)


def tokens(c: Column, stop: Sequence[str] = STOP) -> Column:
    """Words of a title in order: lower case, three characters or more, without stop words. Null gives an empty array."""
    words = F.split(F.regexp_replace(composed(F.lower(F.coalesce(c, F.lit("")))), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(list(stop)))


def token_set(c: Column, stop: Sequence[str] = STOP) -> Column:
    return F.array_sort(F.array_distinct(tokens(c, stop)))


def trigrams(c: Column) -> Column:
    """The set of runs of three characters of the words joined by blanks; empty under three characters."""
    s = F.array_join(tokens(c), " ")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
    return F.when(F.length(s) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def contained_run(contained: Column, container: Column, least: int = 5, cover: float = 0.5) -> Column:
    """Whether the last max(least, half) words of one title stand in the other without a gap."""
    k = F.greatest(F.lit(least), F.ceil(F.size(contained) * cover).cast("int"))
    tail = F.concat(F.lit(" "), F.array_join(F.slice(contained, -k, k), " "), F.lit(" "))
    return F.when(F.size(contained) >= k, F.contains(F.concat(F.lit(" "), F.array_join(container, " "), F.lit(" ")), tail)).otherwise(F.lit(False))


def contradictory(a: Column, b: Column, tail: int = 6) -> Column:
    """Whether two titles differ in their numbers, or in their last words, while both have some."""
    num = lambda x: F.array_sort(F.filter(x, lambda w: w.rlike("^[0-9]+$")))
    n = (F.size(num(a)) > 0) & (F.size(num(b)) > 0) & (num(a) != num(b))
    last = lambda x: F.slice(x, -tail, tail)
    t = (F.size(a) >= tail) & (F.size(b) >= tail)
    return n | F.when(t, last(a) != last(b)).otherwise(F.lit(False))


def italian_amount(c: Column) -> Column:
    """A number written with points for thousands and a comma, as decimal; null if malformed."""
    return F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", ".").try_cast("decimal(38,2)")


#: Roles of an act in order of precedence: whole words, and beginnings of phrases; fixed values.
ROLES = (
    ("revoca", "revoca revoch revoci", ()),
    ("annullamento", "annulla annullamento annullato annullati", ()),
    ("aggiudicazione", "aggiudica aggiudicazione aggiudicato aggiudicati affidamento affidamenti", ("approvazione graduatoria",)),
    ("liquidazione", "liquidazione", ("pagamento fattura",)),
    ("proroga", "proroga prorogato", ("estensione termini", "estensione dei termini")),
    ("modifica", "rettifica rettificato", ("modifica bando", "integrazione bando", "integrazione al bando")),
    ("avvio", "bando indizione", ("avviso pubblico", "procedura aperta", "procedura negoziata", "procedura ristretta", "concorso pubblico", "manifestazione d'interesse", "avviso di selezione", "selezione interna", "approvazione avviso")),
)
#: Roles by which an act derives from another; states of a chain by the first role it holds; fixed values.
DERIVED = ("revoca", "annullamento", "modifica", "proroga")
STATES = (("annullamento", "annullato"), ("revoca", "revocato"), ("liquidazione", "concluso"), ("aggiudicazione", "aggiudicato"), ("avvio", "in_corso"))
SAMPLE = 2000


def role(title: Column, kind: Column, text: Column) -> Column:
    """The role of an act in its chain: the first whose stem stands in title, kind or the text's first characters."""
    s = F.concat_ws(" ", title, kind, F.substring(text, 1, SAMPLE))
    out = F.lit("altro")
    for name, words, phrases in reversed(ROLES):
        begun = "".join("|" + p.replace(" ", r"\s+") for p in phrases)
        out = F.when(s.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:(?:{'|'.join(words.split())})(?![\p{{L}}\p{{N}}_]){begun})"), name).otherwise(out)
    return out


def state(roles: Column) -> Column:
    """The state of a chain by the roles of its acts (an array)."""
    out = F.lit("sconosciuto")
    for r, name in reversed(STATES):
        out = F.when(F.array_contains(roles, r), name).otherwise(out)
    return out


def chain_type(roles: Column) -> Column:
    return F.when(F.array_contains(roles, "avvio"), "gara").otherwise("generico")
