"""Noise in the text of scanned pages: running headers and footers, page numbers, cut words, misread characters.

Headers and footers are lines at a page's edge that come again, up to misread characters, at the same edge of a near page of the
same act; a line further in counts only if all lines between it and the edge do, or are page numbers. Page numbers are edge lines of nothing but a number that goes with the page. Cut words are joined and misread words set right
by the corpus vocabulary: counts of words in native texts against counts in scanned ones.

Pages are compared with near pages only, by a join on (act, page), so an act of any length is spread over many tasks. The vocabulary and the corrections are
tables that are joined, not collected.

Null or blank texts have no defects. Repeated acts count each. Pages that lack a neighbour (gaps, single pages) have no header or footer.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from actaspark.storage import materialise, spread

#: Lines at either edge, page numbers aside, that a header or footer may have at most, pages on either side they are compared with, least likeness, least letters.
EDGE, REACH, LIKE, LETTERS = 4, 3, 0.86, 8
#: Pages of a block, whose edges come together.
PAGES = 8
#: Characters as read and what may have stood there; fixed values from common misreadings.
MISREAD = (
    ("l", "i"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("2", "z"), ("8", "b"), ("6", "b"), ("9", "g"), ("c", "e"), ("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u"),
    ("á", "à"), ("é", "è"), ("í", "ì"), ("ó", "ò"), ("ú", "ù"), ("f", "t"), ("l", "t"), ("ri", "n"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("q", "g"), ("y", "v"), ("b", "h"), ("d", "cl"), ("cl", "d"), ("vv", "w"), ("h", "b"), ("e", "c"), ("t", "f"), ("i", "l"), ("n", "ri"),
)
HYPHENS = "-­¬‐="
#: Native occurrences that make a word a possible reading; how much rarer a misreading must be than it in native text.
KNOWN, RARER = 4, 20
#: Characters of the shortest words that are set right.
SHORTEST = 3
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10, "xi": 11, "xii": 12}
_LABELLED = re.compile(r"(?:p[aà]g(?:ina)?|foglio|p)\.?\s*(?:n\.?\s*)?([0-9ilo]{1,4})(?:\s*(?:di|/|su)\s*[0-9ilo]{1,4})?\.?")
_FRAMED = re.compile(r"[-–—~*\[(]\s*([0-9ilo]{1,4})\s*[-–—~*\])]")
_OF = re.compile(r"([0-9ilo]{1,3})\s*(?:/|di|su)\s*([0-9ilo]{1,3})\.?")
_BARE = re.compile(r"([0-9]{1,4}|[lo0-9]{1,4}|[ivx]{1,5})\.?")
_NUMBERED = re.compile(r"(?:p[aà]g|foglio|p\b|[-–—~*\[(0-9liovx])")
_TAIL = re.compile(r"[\s\-–—|,.]*(?:p[aà]g(?:ina)?\.?|foglio)?\s*(?:n\.)?\s*[0-9lIO]{1,4}(?:\s*(?:di|/)\s*[0-9lIO]{1,4})?\s*[-–—.]*$")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_FOLD = str.maketrans("105289áéíóúàèìòùlyqfcb", "loszbgaeiouaeiouivgteh")


def _digits(s: str) -> int:
    s = s.lower()
    if s in _ROMAN and not s.isdigit() and s != "l":
        return _ROMAN[s]
    return int(s.translate(str.maketrans("lio", "110")))


def page_number(line: str, numero: int) -> bool:
    """Whether a line is only the number of page numero: labelled, framed, as a fraction, bare or Roman."""
    t = " ".join(line.lower().split())
    if not t or not _NUMBERED.match(t):
        return False
    for p in (_LABELLED, _FRAMED):
        if p.fullmatch(t):
            return True
    m = _OF.fullmatch(t)
    if m:
        return numero == _digits(m.group(1)) <= _digits(m.group(2))
    m = _BARE.fullmatch(t)
    if not m:
        return False
    s = m.group(1)
    if s in _ROMAN or s.isdigit() or re.fullmatch("[lo0-9]+", s):
        try:
            return _digits(s) == numero
        except ValueError:
            return False
    return False


def edge_fold(line: str) -> str:
    """Lower case with common misreadings folded into one form."""
    t = (line.lower() if line.isascii() else unicodedata.normalize("NFC", line.lower())).translate(_FOLD)
    return t.replace("rn", "m").replace("ri", "n").replace("ii", "u").replace("cl", "d")


def edge_key(line: str) -> str:
    """What is compared of an edge line: its letters without a page number at the end, folded."""
    t = line.strip()
    if t and t[-1] in "0123456789lIO-–—.":
        t = _TAIL.sub("", t) or t
    return _NO_LETTERS.sub("", edge_fold(t))


def edge_lines(text: str | None, numero: int, edge: str) -> Iterator[tuple[int, int, str]]:
    """(riga, place from the edge, key) of the lines at a page's edge (t or b) that may be a header or footer, as far as they are asked for.

    A line too short to be compared ends an edge. The lines of a short page belong to both edges.
    """
    lines = text.split("\n") if text else []
    place = 0
    for i in range(len(lines)) if edge == "t" else range(len(lines) - 1, -1, -1):
        s = lines[i]
        if not s.strip() or page_number(s, numero):
            continue
        k = edge_key(s)
        if len(k) < LETTERS:
            return
        yield i + 1, place, k
        place += 1
        if place == EDGE:
            return


def same_line(a: str, b: str) -> bool:
    """Whether two keys are alike; lengths and letters are compared first."""
    if a == b:
        return True
    whole = len(a) + len(b)
    if 2 * min(len(a), len(b)) < LIKE * whole or 2 * (Counter(a) & Counter(b)).total() < LIKE * whole:
        return False
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= LIKE


def repeated(text: str, numero: int, near: list[str]) -> list[int]:
    """The lines (riga) of a page that come again at the same edge and place of a near page; an outermost line also at the other edge.

    near: edge, place and key of near pages' lines as one text each.
    """
    if not near:
        return []
    at: dict[str, set[str]] = defaultdict(set)
    for x in near:
        at[x[:3]].add(x[4:])
    out = set()
    for edge in "tb":
        for i, place, key in edge_lines(text, numero, edge):
            others = at[f"{edge} {place}"] if place else at["t 0"] | at["b 0"]
            if key not in others and not any(same_line(key, x) for x in others):
                break
            out.add(i)
    return sorted(out)


def names_act(line: str, number: str | None, title: str | None) -> bool:
    """Whether a line states the act's number and words of its title, as a running header does; for acts that have one page with a header."""
    digits = re.match(r"\s*0*(\d+)", number or "")
    if not digits or not title or digits.group(1) not in re.findall(r"\d+", line):
        return False
    words = lambda s: {w for w in re.split(r"[^a-z]+", edge_fold(s)) if len(w) >= 2}
    return len(words(line) & words(title)) >= 2


def flags(text: str | None, numero: int, near: list[str], number: str | None = None, title: str | None = None) -> list[tuple[int, str]]:
    """(riga, difetto) of headers, footers and page numbers, given the edge lines of near pages, the act's number and title."""
    if not text:
        return []
    out = [(i, "intestazione") for i in repeated(text, numero, near)]
    if numero > 1 and not out:
        lines = text.split("\n")
        first = {i for edge in "tb" for i, *_ in islice(edge_lines(text, numero, edge), 1)}
        out = [(i, "intestazione") for i in sorted(first) if names_act(lines[i - 1], number, title)]
    full = [(i, s) for i, s in enumerate(text.split("\n"), 1) if s.strip()]
    taken = {i for i, _ in out}
    rest = [(i, s) for i, s in full if i not in taken]
    for i, s in {*rest[:2], *rest[-2:]}:
        if page_number(s, numero):
            out.append((i, "numero_pagina"))
    return sorted(out)


def flagged(pages: DataFrame, acts: DataFrame) -> DataFrame:
    """pages with ``segni``: array of (riga, difetto)."""
    p = spread(pages.select(F.col("atto_id").cast("long").alias("atto_id"), F.col("numero").cast("int").alias("numero"), "testo", "fonte"))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = ["\n".join(f"{e} {p} {k}" for e in "tb" for _, p, k in edge_lines(t, n, e)) for n, t in zip(b["numero"], b["testo"])]
            yield pd.DataFrame([(a, n, k) for a, n, k in zip(b["atto_id"], b["numero"], keys) if k], columns=["atto_id", "n", "chiavi"]).astype({"atto_id": "int64", "n": "int32"})

    # a page's edge goes to the one or two blocks of pages that it is near to; a block has PAGES + 2 * REACH pages at most
    block = lambda n: F.floor(n / PAGES).cast("int")
    sent = p.select("atto_id", "numero", "testo").mapInPandas(edges, "atto_id long, n int, chiavi string")
    sent = sent.select("atto_id", "n", "chiavi", F.explode(F.array_distinct(F.array(block(F.col("n") - REACH), block(F.col("n") + REACH)))).alias("blocco"))
    near = sent.groupBy("atto_id", "blocco").agg(F.collect_list(F.struct("n", "chiavi")).alias("pagine"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = [[{"riga": i, "difetto": d} for i, d in flags(t, n, v.split("\n") if v else [], x, o)] for t, n, v, x, o in zip(b["testo"], b["numero"], b["vicine"], b["numero_atto"], b["titolo"])]
            yield b.drop(columns=["vicine", "numero_atto", "titolo"]).assign(segni=marks)

    titles = acts.select(F.col("id").cast("long").alias("atto_id"), F.col("numero").alias("numero_atto"), F.col("oggetto").alias("titolo")).dropDuplicates(["atto_id"])
    p = p.join(titles, "atto_id", "left")
    apart = lambda x: F.abs(x["n"] - F.col("numero")).between(1, REACH)
    p = p.withColumn("blocco", block(F.col("numero"))).join(near, ["atto_id", "blocco"], "left")
    p = p.withColumn("vicine", F.array_join(F.transform(F.filter("pagine", apart), lambda x: x["chiavi"]), "\n"))
    return p.select("atto_id", "numero", "testo", "fonte", "vicine", "numero_atto", "titolo").mapInPandas(run, "atto_id long, numero int, testo string, fonte string, segni array<struct<riga:int,difetto:string>>")


def _strip(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _cut(line: Column) -> Column:
    """Whether a line ends in a letter and a hyphen."""
    return line.rlike(rf"\p{{L}}[{HYPHENS}]\s*$")


def body(flagged_pages: DataFrame) -> DataFrame:
    """(atto_id, numero, fonte, righe): the lines that are no header, footer, page number or blank, as (riga, testo)."""
    lines = F.transform(F.split("testo", "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("riga"), x.alias("testo")))
    skip = F.transform("segni", lambda s: s["riga"])
    return flagged_pages.select("atto_id", "numero", "fonte", F.filter(lines, lambda r: (F.trim(r["testo"]) != "") & ~F.array_contains(skip, r["riga"])).alias("righe"))


def line_table(flagged_pages: DataFrame) -> DataFrame:
    """(atto_id, numero, fonte, riga, testo, prima, dopo): body lines with the lines before and after, across the page break."""
    b = body(flagged_pages)
    first = b.select("atto_id", (F.col("numero") - 1).alias("numero"), F.get("righe", F.lit(0))["testo"].alias("seguente"))
    last = b.select("atto_id", (F.col("numero") + 1).alias("numero"), F.element_at(F.when(F.size("righe") > 0, F.col("righe")), -1)["testo"].alias("precedente"))
    b = b.join(first.dropDuplicates(["atto_id", "numero"]), ["atto_id", "numero"], "left").join(last.dropDuplicates(["atto_id", "numero"]), ["atto_id", "numero"], "left")
    each = F.transform("righe", lambda r, i: F.struct(r["riga"].alias("riga"), r["testo"].alias("testo"), F.when(i > 0, F.get("righe", i - 1)["testo"]).otherwise(F.col("precedente")).alias("prima"), F.coalesce(F.get("righe", i + 1)["testo"], F.col("seguente")).alias("dopo")))
    return b.select("atto_id", "numero", "fonte", F.explode(each).alias("r")).select("atto_id", "numero", "fonte", "r.*")


def _tokens(lines: DataFrame) -> DataFrame:
    """(atto_id, numero, riga, fonte, parola): words, without the parts of cut ones."""
    w = F.split(F.trim(F.regexp_replace("testo", r"[\s ]+", " ")), " ")
    w = F.when(_cut(F.col("testo")), F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w)
    w = F.when(_cut(F.coalesce("prima", F.lit(""))), F.slice(w, 2, 1_000_000_000)).otherwise(w)
    return lines.select("atto_id", "numero", "riga", "fonte", F.explode(F.array_distinct(F.transform(w, _strip))).alias("parola")).where(F.length("parola") >= 2)


def _cuts(lines: DataFrame) -> DataFrame:
    """(atto_id, numero, riga, sinistra, destra, segno, maiuscola) of the lines that end in a cut word."""
    left = F.regexp_extract("testo", rf"([\p{{L}}\p{{N}}]+)[{HYPHENS}]\s*$", 1)
    before = F.regexp_extract("testo", rf"(\S*)[{HYPHENS}]\s*$", 1)
    right = F.regexp_extract("dopo", r"^\s*([\p{L}\p{N}]+)", 1)
    c = lines.where(_cut(F.col("testo")) & F.col("dopo").isNotNull())
    c = c.select("atto_id", "numero", "riga", left.alias("s"), right.alias("d"), F.regexp_extract("testo", rf"([{HYPHENS}])\s*$", 1).alias("segno"), before.alias("intera"))
    c = c.where("s <> '' and d <> ''")
    return c.select("atto_id", "numero", "riga", F.lower("s").alias("sinistra"), F.lower("d").alias("destra"), "segno", F.col("d").rlike(r"^\p{Lu}\p{Ll}").alias("maiuscola"), F.lower(F.regexp_replace("intera", r"^[^\p{L}\p{N}]+", "")).alias("intera"))


def vocabulary(acts: DataFrame, pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(parola, nativa, letta): texts in which a word stands, native ones and scanned pages. Words hold a letter."""
    native = acts.where(F.col("testo_estratto").isNotNull()).select(F.col("id").alias("atto_id"), "testo_estratto")
    native = spread(native).join(pages.select("atto_id").distinct(), "atto_id", "left_anti")
    words = F.array_distinct(F.transform(F.split("testo_estratto", r"[\s ]+"), _strip))
    n = native.select(F.explode(words).alias("parola"), F.lit(1).alias("nativa"))
    t = tokens.select("parola", F.when(F.col("fonte") == "nativo", 1).otherwise(0).alias("nativa"))
    both = n.unionByName(t).where(F.col("parola").rlike(r"^[\p{L}\p{N}][\p{L}\p{N}'’\-]+$") & F.col("parola").rlike(r"\p{L}"))
    return both.groupBy("parola").agg(F.sum("nativa").alias("nativa"), (F.count(F.lit(1)) - F.sum("nativa")).alias("letta"))


#: Letters that a misreading turns into each other have one fold; those read as two letters fold to these two's folds.
_ONE = ("iltfj10oóò5s2zecéèàáaùúíìyvgq9bh68", "LLLLLLooooSSzzeeeeaaauuLLvvgggbbbb")
_TWO = (("u", "LL"), ("m", "rrL"), ("n", "rL"), ("d", "eL"), ("w", "vv"))


def fold(c: Column) -> Column:
    """One form for all words that misreadings turn into each other."""
    c = F.translate(F.lower(c), *_ONE)
    for k, v in _TWO:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def misreadings(seen: str, right: str, most: int) -> int | None:
    """The least number of misreadings by which right is read as seen; null if there are more than most, or other differences."""
    last: dict[tuple[int, int], int] = {(0, 0): 0}
    goal = (len(seen), len(right))
    best = None
    while last:
        new: dict[tuple[int, int], int] = {}
        for (i, j), k in last.items():
            if (i, j) == goal:
                best = k if best is None else min(best, k)
                continue
            steps = [(i + 1, j + 1, k)] if i < goal[0] and j < goal[1] and seen[i] == right[j] else []
            if k < most:
                steps += [(i + len(a), j + len(b), k + 1) for a, b in MISREAD if seen.startswith(a, i) and right.startswith(b, j)]
            for x, y, z in steps:
                if z < new.get((x, y), most + 1):
                    new[x, y] = z
        last = new
    return best


def corrections(suspects: DataFrame, words: DataFrame) -> DataFrame:
    """(parola, giusta): the reading of fewest misreadings, then of most native texts, among known words.

    Words meet by their fold, so no readings are spelled out; two misreadings at most, beside digits.
    """
    known = words.where((F.col("nativa") >= KNOWN) & ~F.col("parola").rlike("[0-9]")).select(F.col("parola").alias("giusta"), F.col("nativa").alias("n"), fold(F.col("parola")).alias("piega"))
    s = suspects.select("parola", F.col("nativa").alias("propria"), fold(F.col("parola")).alias("piega"))
    pairs = s.join(known, "piega").where((F.col("propria") * RARER <= F.col("n")) & (F.col("giusta") != F.col("parola"))).select("parola", "giusta", "n")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, c, n, k) for w, c, n in zip(b["parola"], b["giusta"], b["n"]) if (k := misreadings(w, c, 2 + sum(x.isdigit() for x in w))) is not None]
            yield pd.DataFrame(rows, columns=["parola", "giusta", "n", "k"]).astype({"parola": "str", "giusta": "str", "n": "int64", "k": "int32"})

    ok = pairs.mapInPandas(verify, "parola string, giusta string, n long, k int")
    best = ok.groupBy("parola").agg(F.min(F.struct("k", (-F.col("n")).alias("n"), "giusta")).alias("b"))
    return best.select("parola", F.col("b.giusta").alias("giusta"))


def _suspects(words: DataFrame) -> DataFrame:
    """Words of scanned pages that native texts lack, or have far less often, and that are mostly letters."""
    letters = F.length(F.regexp_replace("parola", r"[^\p{L}]", ""))
    return words.where((F.col("letta") > 0) & (F.col("nativa") * 4 <= F.col("letta")) & (letters * 2 > F.length("parola")) & (F.length("parola") >= SHORTEST))


def _date(w: Column) -> Column:
    """The date a token stands for if digits of it are misread, else null."""
    fixed = F.translate(w, "olisbz", "011582")
    return F.when(w.rlike(r"^[0-9olisbz]{2}/[0-9olisbz]{2}/[0-9olisbz]{4}$") & w.rlike("[a-z]") & F.try_to_date(fixed, "dd/MM/yyyy").isNotNull(), fixed)


def _split(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``forma`` to cut words: the whole word, set right if misread; null where a hyphen belongs to the word."""
    w = words.select("parola", "nativa", "letta")
    j = cuts.withColumn("unita", F.concat("sinistra", "destra")).withColumn("composta", F.concat("intera", F.lit("-"), "destra"))
    pick = lambda alias, key: w.select(F.col("parola").alias(key), F.col("nativa").alias(alias + "_n"), F.col("letta").alias(alias + "_l"))
    kinds = j.select("unita", "composta").distinct()
    c = kinds.join(pick("u", "unita"), "unita", "left").join(pick("c", "composta"), "composta", "left").fillna(0, ["u_n", "u_l", "c_n", "c_l"])
    unknown = c.where("u_n = 0").select(F.col("unita").alias("parola"), F.lit(0).cast("long").alias("nativa")).distinct()
    fix = corrections(unknown, words).select(F.col("parola").alias("unita"), F.col("giusta").alias("g"))
    c = materialise(c.join(fix, "unita", "left"), "cuts")
    plain = F.col("segno") == "-"
    hyphenated = plain & ((F.col("u_n") == 0) & ((F.col("c_n") > 0) | (F.col("c_l") > 0) & (F.col("u_l") == 0)) | F.col("maiuscola") & (F.col("u_n") == 0))
    compound = plain & F.col("sinistra").rlike("^(?:[a-z]+ico|socio|storico|sanitario|tecnico|medio|vice|ex|anti)$") & (F.col("u_n") == 0) & F.col("g").isNull() & (F.col("u_l") == 0)
    out = j.join(c, ["unita", "composta"])
    return out.withColumn("forma", F.when(~(hyphenated | compound), F.when(F.col("u_n") > 0, F.col("unita")).otherwise(F.coalesce("g", "unita"))))


def analyse(pages: DataFrame, acts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Flagged pages, cut words with their forms, word corrections, and misread words by place."""
    marked = materialise(flagged(pages, acts), "pages")
    lines = line_table(marked)
    tokens = materialise(_tokens(lines), "tokens")
    words = materialise(vocabulary(acts.select("id", "testo_estratto"), pages, tokens), "words")
    cuts = _split(_cuts(lines), words)
    fixes = materialise(corrections(_suspects(words), words), "fixes")
    dates = tokens.select("atto_id", "numero", "riga", "parola", _date(F.col("parola")).alias("giusta")).where("giusta is not null")
    wrong = tokens.join(fixes, "parola").select("atto_id", "numero", "riga", "parola", "giusta").unionByName(dates)
    return marked, cuts, fixes, wrong


def found(pages: DataFrame, acts: DataFrame) -> DataFrame:
    """Every defect as a row (TESTDATA.md, p4_found)."""
    marked, cuts, _, wrong = analyse(pages, acts)
    edge = marked.select("atto_id", "numero", F.explode("segni").alias("s")).select("atto_id", "numero", "s.riga", "s.difetto", F.lit("").alias("forma"))
    cut = cuts.where("forma is not null").select("atto_id", "numero", "riga", F.lit("sillabazione").alias("difetto"), "forma")
    bad = wrong.select("atto_id", "numero", "riga", F.lit("carattere").alias("difetto"), F.col("giusta").alias("forma"))
    return edge.unionByName(cut).unionByName(bad).distinct()


def _cased(right: str, seen: str) -> str:
    return right.upper() if seen.isupper() and len(seen) > 1 else right.capitalize() if seen[:1].isupper() else right


def _joined(lines: list[str], cut_forms: dict[int, str], fixes: dict[str, str]) -> str:
    """One paragraph of several lines."""
    out: list[str] = []
    glue = False
    for i, s in lines:
        words = []
        for w in s.split():
            core = re.sub(r"^\W+|\W+$", "", w)
            right = fixes.get(core.lower())
            if right:
                w = w.replace(core, _cased(right, core), 1)
            words.append(w)
        if glue and words and out:
            out[-1] += words.pop(0)
        glue = i in cut_forms
        if glue and words:
            words[-1] = words[-1].rstrip(HYPHENS)
        out += words
    return " ".join(out)


def repaired(pages: DataFrame, acts: DataFrame) -> DataFrame:
    """(atto_id, numero, testo): each page in continuous paragraphs, without headers, footers and page numbers.

    A blank line ends a paragraph. A word cut at a page's end is left to the next page, where its rest begins the text.
    """
    marked, cuts, _, wrong = analyse(pages, acts)
    c = cuts.where("forma is not null").groupBy("atto_id", "numero").agg(F.collect_list(F.struct("riga", "forma")).alias("tagli"))
    x = wrong.select("atto_id", "numero", "parola", "giusta").distinct().groupBy("atto_id", "numero").agg(F.collect_list(F.struct("parola", "giusta")).alias("letture"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for t, marks, cut, fix in zip(b["testo"], b["segni"], b["tagli"], b["letture"]):
                if t is None:
                    texts.append(None)
                    continue
                skip = {m["riga"] for m in marks}
                forms = {m["riga"]: m["forma"] for m in cut} if cut is not None else {}
                fixes = {m["parola"]: m["giusta"] for m in fix} if fix is not None else {}
                paragraphs: list[list[tuple[int, str]]] = [[]]
                for i, s in enumerate(t.split("\n"), 1):
                    if i in skip:
                        continue
                    if s.strip():
                        paragraphs[-1].append((i, s))
                    elif paragraphs[-1]:
                        paragraphs.append([])
                texts.append("\n\n".join(_joined(p, forms, fixes) for p in paragraphs if p))
            yield pd.DataFrame({"atto_id": b["atto_id"], "numero": b["numero"], "testo": texts})

    j = marked.select("atto_id", "numero", "testo", "segni").join(c, ["atto_id", "numero"], "left").join(x, ["atto_id", "numero"], "left")
    return j.mapInPandas(run, "atto_id long, numero int, testo string")


_LEFT, _RIGHT, _AROUND = re.compile(rf"([^\W_]+)[{HYPHENS}]$"), re.compile(r"[^\W_]+"), re.compile(r"^[\W_]+|[\W_]+$")


def _whole(left: str, right: str, form: str | None, chained: bool) -> str:
    """The word that two tokens are cut from, as its form says; without a form it keeps its hyphen. A word cut twice is only joined."""
    if form is None:
        return left + right
    a, b = _LEFT.search(left), _RIGHT.match(right)
    if not a or not b:
        return left.rstrip(HYPHENS) + right
    word = a[1] + b[0]
    return left[: a.start()] + (word if chained or word.lower() == form else _cased(form, word)) + right[b.end() :]


def assembled(pages: list[tuple[int, str | None, set[int], dict[int, str | None], dict[str, str]]]) -> str | None:
    """One text of an act's pages in order: (numero, testo, lines to skip, forms of cut words by line, words set right).

    A blank line ends a paragraph, unless a cut word goes on after it or it stands at a page's edge within a sentence. A missing page ends one, too.
    """
    if all(t is None for _, t, *_ in pages):
        return None
    paragraphs: list[list[str]] = [[]]
    open_cut = chained = blank = edge = gap = False
    form: str | None = None
    last = None
    for numero, text, skip, cuts, fixes in pages:
        gap = gap or last is not None and numero > last + 1
        last, edge = numero, last is not None
        for i, s in enumerate((text or "").split("\n"), 1):
            if i in skip:
                continue
            tokens = s.split()
            if not tokens:
                blank = True
                continue
            if not open_cut and paragraphs[-1] and (gap or blank and not (edge and paragraphs[-1][-1][-1] not in '.:;!?»”")')):
                paragraphs.append([])
            words, n = [], len(tokens)
            for k, w in enumerate(tokens):
                core = _AROUND.sub("", w)
                right = None if (k == 0 and open_cut) or (k == n - 1 and i in cuts) else fixes.get(core.lower())
                words.append(w.replace(core, _cased(right, core), 1) if right else w)
            if open_cut:
                paragraphs[-1][-1] = _whole(paragraphs[-1][-1], words.pop(0), form, chained)
            paragraphs[-1] += words
            chained = open_cut and n == 1
            open_cut, form = i in cuts, cuts.get(i)
            blank = edge = gap = False
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def texts(pages: DataFrame, acts: DataFrame) -> DataFrame:
    """(atto_id, testo): the text of each act in continuous paragraphs over its pages, without headers, footers and page numbers, cut and misread words set right.

    An act's pages come together, as its text is one value of the result.
    """
    marked, cuts, _, wrong = analyse(pages, acts)
    c = cuts.groupBy("atto_id", "numero").agg(F.collect_list(F.struct("riga", "forma")).alias("tagli"))
    x = wrong.select("atto_id", "numero", "parola", "giusta").distinct().groupBy("atto_id", "numero").agg(F.collect_list(F.struct("parola", "giusta")).alias("letture"))
    j = marked.select("atto_id", "numero", "testo", "segni").join(c, ["atto_id", "numero"], "left").join(x, ["atto_id", "numero"], "left")
    each = j.groupBy("atto_id").agg(F.sort_array(F.collect_list(F.struct("numero", "testo", F.col("segni.riga").alias("salta"), "tagli", "letture"))).alias("pagine"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some = lambda a: [] if a is None else a
        for b in batches:
            out = []
            for act in b["pagine"]:
                out.append(assembled([(g["numero"], g["testo"], set(some(g["salta"])), {m["riga"]: m["forma"] for m in some(g["tagli"])}, {m["parola"]: m["giusta"] for m in some(g["letture"])}) for g in act]))
            yield pd.DataFrame({"atto_id": b["atto_id"], "testo": out})

    return each.mapInPandas(run, "atto_id long, testo string")
