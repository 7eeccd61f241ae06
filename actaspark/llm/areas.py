"""Subject areas of documents by weighted terms and a multi-pattern automaton.

Terms (one or two words) are first weighted from the labelled examples: purity for an area times rarity. The
automaton built of them labels the sentences of the corpus, and terms are weighted anew from counts over all
documents: a term stays if its labelled sentences are of one area and enough of its sentences are labelled; so terms that go with
any subject drop out and those the examples lack come in. A sentence deals with an area whose terms, normalised by its length, exceed the threshold calibrated on
the examples; a document has every area that a fifth of its sentences deal with.

Sentences are runs of at least four words that are mostly letters; titles, lists of figures and markup are none. A null, empty or blank
text has no sentences and thus no area. Repeated documents count each.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from actaspark.llm.words import plain
from actaspark.storage import materialise, spread

#: Fixed value of the check: the share of sentences.
SHARE = 0.2
#: Least support of a term as a share of all documents (so there are at most so many terms as its inverse times the terms of a document),
#: examples used at most per area (a documented bound of the fit).
SUPPORT, EXAMPLES, CHUNK = 1 / 20_000, 2_000, 500
#: Least share of one area among a term's labelled sentences, and among all its sentences.
PURITY, LABELLED = 0.9, 0.4
NONE = ""
_BLOCK = re.compile(r"<(?:br|/?p|/?div|/?li|/?h\d|/?tr|/?td)\b[^<>]{0,100}>", re.IGNORECASE)
# one class begins every end, so the search skips to it; a stop before a figure ends a sentence only after a whole word, as abbreviations and numbers go on
_END = re.compile(r"[.!?;\n\r\v\f](?:(?<=[\n\r\v\f])[\n\r\v\f]*|(?<=[.!?;])\s+(?:(?=[a-z\"'(])|(?<=[a-z]{4}[.!?;]\s)(?=[0-9])))")
_SHORT = frozenset("n nr prot art artt dott sig avv ing geom arch prof pag cap lett cfr es ecc sigg on rag mr mrs dr no sec ch par".split())
_BLANKED = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum() and c != "\n"})
_FOREIGN, _DIGIT = re.compile(r"[^\x00-\x7f]"), re.compile(r"[0-9]")


def sentences(text: str | None) -> list[str]:
    """Each sentence as its words with one blank between them. A full stop after an abbreviation ends none."""
    if not text:
        return []
    if "<" in text:
        text = _BLOCK.sub("\n", text)
    text = "\n".join(_END.split(plain(text)))
    if not text.isascii():
        text = _FOREIGN.sub(lambda m: m.group() if m.group().isalnum() else " ", text)
    out = []
    held = ""
    for p in text.translate(_BLANKED).split("\n"):
        if held:
            p, held = f"{held} {p}", ""
        w = p.split()
        if len(w) > 1 and w[-1] in _SHORT:
            held = p
            continue
        if len(w) < 4:
            continue
        s = " ".join(w)
        if _DIGIT.search(s) or not s.isascii():
            letters = sum(map(str.isalpha, w))
            if letters < 4 or letters * 2 <= len(w):
                continue
        out.append(s)
    if held:
        w = held.split()
        if sum(map(str.isalpha, w)) >= 4:
            out.append(" ".join(w))
    return out


def terms(sentence: str) -> set[str]:
    """Single words of four letters or more, and pairs of words of letters that follow each other."""
    words = sentence.split()
    out = {w for w in words if len(w) >= 4 and w.isalpha()}
    out.update(f"{a} {b}" for a, b in zip(words, words[1:]) if a.isalpha() and b.isalpha())
    return out


class Lexicon:
    """Weighted terms in an Aho-Corasick automaton; areas by threshold."""

    def __init__(self, weights: dict[str, tuple[str, float]], threshold: float = 0.0):
        self.weights, self.threshold = weights, threshold
        self._automaton = None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "threshold": self.threshold, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, (area, w) in self.weights.items():
                a.add_word(f" {t} ", (area, w))
            if self.weights:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def scores(self, sentence: str) -> dict[str, float]:
        """Weight of each area's terms by the square root of the number of words."""
        if not self.weights or not sentence:
            return {}
        out: dict[str, float] = {}
        for _, (area, w) in self.automaton().iter(f" {sentence} "):
            out[area] = out.get(area, 0.0) + w
        if not out:
            return out
        n = math.sqrt(sentence.count(" ") + 1)
        return {a: s / n for a, s in out.items()}

    def label(self, sentence: str) -> list[str]:
        """The areas above the threshold that have at least half the best area's score."""
        s = self.scores(sentence)
        if len(s) < 2:
            return [a for a, x in s.items() if x > self.threshold]
        best = max(s.values())
        return sorted(a for a, x in s.items() if x > self.threshold and x * 2 >= best)

    def areas(self, document: list[str]) -> Counter[str]:
        """Sentences per area."""
        found: Counter[str] = Counter()
        for s in document:
            found.update(self.label(s))
        return found


def calibrated(weights: dict[str, tuple[str, float]], rows: list[tuple[str, str]]) -> Lexicon:
    """A lexicon whose threshold is a quarter of the score that 95 % of the examples' sentences reach for their own area."""
    lex = Lexicon(weights)
    own = sorted(lex.scores(w).get(a, 0.0) for a, w in rows)
    return Lexicon(weights, own[len(own) // 20] / 4 if own else 0.0)


def from_examples(examples: Iterable[tuple[str, str]]) -> Lexicon:
    """The first lexicon: terms that stand three times or more, and in examples of one area only (95 %)."""
    rows = [(a, w) for a, t in examples for w in sentences(t)]
    counts: dict[str, Counter] = defaultdict(Counter)
    for a, w in rows:
        for t in terms(w):
            counts[t][a] += 1
    weights = {}
    for t, c in counts.items():
        n = sum(c.values())
        area, k = max(sorted(c.items()), key=lambda x: x[1])
        if n >= 3 and k >= 0.95 * n:
            weights[t] = (area, k / n * math.log1p(len(rows) / n))
    return calibrated(weights, rows)


def count_terms(docs: Iterable[list[str]], lex: Lexicon) -> pd.DataFrame:
    """(termine, area, n) over the sentences of some documents: in how many documents a term stands in a sentence of an area.

    The term '' counts documents. So a document that repeats itself counts once. Words are numbered, and pairs of numbers counted in arrays.
    """
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    areas: dict[str, int] = {NONE: 0}
    ids: list[int] = []
    ends: list[int] = []
    labels: list[list[int]] = []
    owners: list[int] = []
    many_docs = 0
    for d in docs:
        many_docs += bool(d)
        for w in d:
            ids += map(number.__getitem__, w.split())
            ends.append(len(ids))
            owners.append(many_docs)
            labels.append([areas.setdefault(a, len(areas)) for a in lex.label(w) or [NONE]])
    if not ids:
        return pd.DataFrame({"termine": ["" for _ in range(0)], "area": ["" for _ in range(0)], "n": np.empty(0, np.int64)})
    names = np.array(list(number), object)
    alpha = np.array([x.isalpha() for x in number])
    long = np.array([len(x) >= 4 for x in number]) & alpha
    of = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
    word = np.array(ids, np.int64)
    v = len(number) + 1
    pair = (of[1:] == of[:-1]) & alpha[word[1:]] & alpha[word[:-1]]
    single = long[word]
    term = np.concatenate((word[single] * v, word[:-1][pair] * v + word[1:][pair] + 1))
    where = np.concatenate((of[single], of[1:][pair]))
    many = np.array([len(x) for x in labels])
    flat = np.array([a for x in labels for a in x], np.int64)
    begin = np.concatenate(([0], np.cumsum(many)[:-1]))
    reps = many[where]
    at = np.repeat(begin[where] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
    span = v * v * len(areas)
    once = np.sort(np.array(owners, np.int64)[np.repeat(where, reps)] * span + np.repeat(term, reps) * len(areas) + flat[at])
    both = np.sort(once[np.diff(once, prepend=-1) != 0] % span)
    first = np.flatnonzero(np.diff(both, prepend=-1) != 0)
    both, n = both[first], np.diff(np.append(first, len(both)))
    t, a = both // len(areas), both % len(areas)
    x, y = t // v, t % v
    text = names[x] + np.where(y > 0, " " + names[np.maximum(y - 1, 0)], "")
    table = pd.DataFrame({"termine": text, "area": np.array(list(areas), object)[a], "n": n})
    return pd.concat([table, pd.DataFrame({"termine": [""], "area": [NONE], "n": [many_docs]})])


def _term_counts(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """(termine, area, n): in how many documents each term stands in a sentence of an area; '' is no area, the term '' counts documents.

    docs: frasi, a document's sentences in lines.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), CHUNK):
                yield count_terms((x.split("\n") for x in b["frasi"][i : i + CHUNK]), shared.value)

    return docs.select("frasi").mapInPandas(run, "termine string, area string, n long").groupBy("termine", "area").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, examples: DataFrame) -> Lexicon:
    """The lexicon weighted over the whole corpus (frasi: a document's sentences in lines)."""
    from pyspark.sql import Window

    w = Window.partitionBy("area").orderBy("esempio_id")
    bounded = examples.where("area is not null and text is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= EXAMPLES)
    rows = [(r["area"], r["text"]) for r in bounded.select("area", "text").collect()]
    first = from_examples(rows)
    counts = materialise(_term_counts(docs, first), "terms")
    total = sum(r["n"] for r in counts.where("termine = ''").collect())
    least = max(5, math.ceil(total * SUPPORT))
    some = F.col("area") != NONE
    t = counts.where("termine <> ''").groupBy("termine").agg(F.sum("n").alias("n"), F.sum(F.when(some, F.col("n"))).alias("k"), F.max(F.when(some, F.struct("n", "area"))).alias("best"))
    t = t.where((F.col("n") >= least) & (F.col("best.n") >= PURITY * F.col("k")) & (F.col("best.n") >= LABELLED * F.col("n")))
    # bounded by the least support; some thousands in practice
    weights = {r["termine"]: (r["best"]["area"], r["best"]["n"] / r["k"] * math.log1p(total / r["n"])) for r in t.collect()}
    if not weights:  # a corpus too small to weigh anything
        return first
    return calibrated(weights, [(a, w) for a, x in rows for w in sentences(x)])


def split_once(docs: DataFrame) -> DataFrame:
    """(doc_id, frasi): the sentences of each document (doc_id, text) in lines, written once and read by both later passes.

    Documents without sentences have no area and give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, "\n".join(s)) for i, t in zip(b["doc_id"], b["text"]) if (s := sentences(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "frasi"]).astype({"doc_id": "int64"})

    return materialise(docs.mapInPandas(run, "doc_id long, frasi string"), "sentences")


def assign(docs: DataFrame, examples: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, area, frasi, totale): every area that at least a fifth of the document's sentences deal with."""
    d = split_once(spread(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(d, examples))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["frasi"]):
                all_ = t.split("\n")
                rows += [(i, a, k, len(all_)) for a, k in sorted(shared.value.areas(all_).items()) if k >= SHARE * len(all_) - 1e-9]
            yield pd.DataFrame(rows, columns=["doc_id", "area", "frasi", "totale"])

    return d.mapInPandas(run, "doc_id long, area string, frasi int, totale int")


def composition(docs: DataFrame, examples: DataFrame) -> DataFrame:
    """(area, documenti, frasi): documents of each area and their sentences that deal with it."""
    return assign(docs, examples).groupBy("area").agg(F.count(F.lit(1)).alias("documenti"), F.sum("frasi").alias("frasi"))
