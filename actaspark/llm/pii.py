"""Personal information in free text: a character-level bidirectional LSTM with CRF transitions.

Texts are cut into segments around places where a case can stand at all (necessary marks: an at sign, nine digits, a code's
letters and digits, a kind of street, two capitalised words), and segments into overlapping windows. The network, trained in numpy from labelled
spans, scores every character; Viterbi decoding over learned transitions gives spans, and overlapping windows are reconciled over the whole text. A check
of form follows: each span must contain its type's form, whose exact bounds it takes.

All rows are processed where they lie; nothing is shuffled. A null or empty text has no cases. Repeated rows count each. Offsets count
Unicode characters from 0.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from actaspark.storage import spread

TYPES = ("email", "telefono", "identita", "indirizzo", "nome")
TAGS = ("O", *(f"{p}-{t}" for t in TYPES for p in "BI"))
#: Window and overlap in characters, margin around a mark, windows of one batch, hidden units of each direction.
WINDOW, OVERLAP, MARGIN, BATCH, HIDDEN = 128, 48, 28, 512, 24
#: Characters after a kind of street that are shown to the tagger, and on either side of a proposal in which its form is looked for.
ADDRESS_LENGTH, FORM = 80, 200
MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
SYMBOLS = "\n abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:'\"-_/@()[]+*&|°€#àèéìòùáíóú"
_NUMBER = {c: i + 2 for i, c in enumerate(SYMBOLS)} | {"\t": 3, "\r": 2, "\f": 2, "\xa0": 3, "’": SYMBOLS.index("'") + 2}
VOCABULARY = len(SYMBOLS) + 2  # 0 pads, 1 is any other character
_CODE = np.ones(0x3000, np.int16)
for _c, _i in _NUMBER.items():
    _CODE[ord(_c)] = _i

#: Kinds of street, in words and abbreviations.
STREETS = (
    r"via|viale|v\.le|piazza|p\.zza|p\.za|piazzale|p\.le|corso|c\.so|contrada|c\.da|c/da|vicolo|v\.lo|largo|l\.go|strada|str\.|traversa|salita|cortile|lungomare|borgo"
)
_TITLE = "|".join(w[0].upper() + w[1:] for w in STREETS.split("|"))
_UPPER = "(?:" + STREETS.upper().replace("\\.", "\\.") + ")"
# a street's name begins with a capital or a figure, maybe after a particle
_ONWARD = r"(?:[Dd](?:[aei]|[Ee]|[A-Za-z]{2,5})(?:['’]|\s)\s*)?[A-Z0-9]"
#: One character of a small set begins every mark, so the search skips to it; what may follow depends on it.
MARKS = re.compile(
    r"[@(\[0-9A-Zvpclstb](?:(?<=@)|(?<=[(\[])\s?(?:at|AT|chiocciola|CHIOCCIOLA)\s?[)\]]"
    r"|(?<=[0-9])(?:(?:[\s./-]{0,3}[0-9]){8}|(?<=0)(?:[ -]?[0-9]){7}|[0-9][A-Za-z]\s?[0-9]{2}|[0-9]{4}\s?[A-Za-z]{2}\b)"
    r"|(?<=\b[A-Z])(?:[a-zà-ù'’]+|[A-Z]+|\.)(?:\s|-)+(?:[A-Z][a-z]{2}|[A-Z]{3}|[A-Z]\.|[A-Z]['’][A-Z])"
    rf"|(?<=\b[VPCLSTBvpclstb])(?<=(?=(?:{STREETS})\s+{_ONWARD}).)|(?<=\b[VPCLSTB])(?<=(?=(?:{_TITLE}|{_UPPER})\s+{_ONWARD}).))"
)


def numbers(text: str) -> np.ndarray:
    """The number of each character."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(code, len(_CODE) - 1)]


def segments(text: str) -> list[tuple[int, int]]:
    """Parts of a text that may hold a case, with a margin; neighbouring ones are joined."""
    out: list[list[int]] = []
    for m in MARKS.finditer(text):
        # a kind of street is marked by its first character; its name and number follow
        s, e = max(0, m.start() - MARGIN), min(len(text), m.end() + (ADDRESS_LENGTH if m.end() - m.start() == 1 and m.group() != "@" else MARGIN))
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows over a segment."""
    out, s = [], start
    while True:
        e = min(s + WINDOW, end)
        out.append((s, e))
        if e == end:
            return out
        s = e - OVERLAP


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Tagger:
    """Two LSTMs, forward and backward, a linear layer and CRF transitions. Gates use x / (1 + |x|) in place of tanh."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def fresh(cls, seed: int = 0, hidden: int = HIDDEN) -> Tagger:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = r.normal(0, 0.3, (VOCABULARY, 4 * hidden))
            w[f"h{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            b = np.zeros(4 * hidden)
            b[hidden : 2 * hidden] = 1.0
            w[f"b{d}"] = b
            w[f"o{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, len(TAGS)))
        w["bo"], w["t"], w["s"] = np.zeros(len(TAGS)), np.zeros((len(TAGS), len(TAGS))), np.zeros(len(TAGS))
        return cls(w)

    @classmethod
    def load(cls, path: str = MODEL) -> Tagger:
        with np.load(path) as z:
            return cls({k: z[k] for k in z.files})

    def save(self, path: str = MODEL) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    def _run(self, ids: np.ndarray, d: str, keep: list | None = None, first: np.ndarray | None = None, state: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Hidden states (T, B, H) of one direction; ids (T, B). keep collects what the gradient needs.

        first: the first column that has a character at each place (columns by length); state: what each column starts from.
        """
        n, b = ids.shape
        hidden = self.w[f"h{d}"].shape[0]
        table, rec = self.w[f"x{d}"] + self.w[f"b{d}"], self.w[f"h{d}"]
        out = np.zeros((n, b, hidden), np.float32)
        h, c = state or (np.zeros((b, hidden), np.float32), np.zeros((b, hidden), np.float32))
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            z = int(first[t]) if first is not None else 0
            g = table[ids[t, z:]]
            g += h[z:] @ rec
            a = np.abs(g)
            a += 1
            g /= a
            gates = g[:, : 3 * hidden] * np.float32(0.5)
            gates += np.float32(0.5)
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            before = c[z:]
            now = f * before
            now += i * g[:, 3 * hidden :]
            s = soft(now)
            if keep is not None:
                keep.append((t, g, gates, before, now, s, h))
            if z:
                c[z:] = now
                h[z:] = np.multiply(o, s, out=out[t, z:])
            else:
                c, h = now, np.multiply(o, s, out=out[t])
                if first is not None:
                    h = h.copy()
        return out

    def _padded(self) -> tuple[np.ndarray, np.ndarray]:
        """The backward states (h, c) after 0 to WINDOW padding characters, as windows were filled up in training."""
        if not hasattr(self, "_after"):
            table, rec = self.w["xb"] + self.w["bb"], self.w["hb"]
            hidden = rec.shape[0]
            hs, cs = np.zeros((WINDOW + 1, hidden), np.float32), np.zeros((WINDOW + 1, hidden), np.float32)
            for t in range(WINDOW):
                g = soft(table[0] + hs[t] @ rec)
                gates = g[: 3 * hidden] * np.float32(0.5) + np.float32(0.5)
                cs[t + 1] = gates[hidden : 2 * hidden] * cs[t] + gates[:hidden] * g[3 * hidden :]
                hs[t + 1] = gates[2 * hidden :] * soft(cs[t + 1])
            self._after = hs, cs
        return self._after

    def scores(self, ids: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Emission scores (T, B, tags). sizes: the columns' lengths, ascending; a column's scores do not depend on the others."""
        if sizes is None:
            return self._run(ids, "f") @ self.w["of"] + self._run(ids, "b") @ self.w["ob"] + self.w["bo"]
        first = np.searchsorted(sizes, np.arange(len(ids)), side="right")
        hs, cs = self._padded()
        left = np.maximum(WINDOW - sizes, 0)
        back = self._run(ids, "b", first=first, state=(hs[left], cs[left]))
        return self._run(ids, "f", first=first) @ self.w["of"] + back @ self.w["ob"] + self.w["bo"]

    def decode(self, ids: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Best tags (T, B), O beyond a column's length."""
        n, b = ids.shape
        if sizes is None:
            sizes = np.full(b, n)
            e = self.scores(ids)
        else:
            e = self.scores(ids, sizes)
        out = np.zeros((n, b), np.int8)
        # a window in which O leads everywhere by more than transitions can turn has no case
        turn = 2 * float(np.ptp(self.w["t"]) + np.ptp(self.w["s"]))
        lead = e[:, :, 1:].max(2) - e[:, :, 0]
        lead[np.arange(n)[:, None] >= sizes] = -np.inf
        open_ = np.flatnonzero(lead.max(0) > -turn)
        if len(open_):
            out[:, open_] = self._best(e[:, open_], sizes[open_])
        return out

    def _best(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi; the best way into a tag is looked up again on the way back, for the tags taken only."""
        n, b, k = e.shape
        first = np.searchsorted(sizes, np.arange(n), side="right")
        v = np.empty((n, k, b), np.float32)  # the best score of a way to each tag
        e = np.ascontiguousarray(e.transpose(0, 2, 1))
        into = self.w["t"].T  # (to, from)
        v[0] = e[0] + self.w["s"][:, None]
        for t in range(1, n):
            z = int(first[t])
            before = v[t - 1, :, z:]
            for j in range(k):
                np.max(before + into[j][:, None], axis=0, out=v[t, j, z:])
            v[t, :, z:] += e[t, :, z:]
        out = np.zeros((n, b), np.int8)
        rows = np.arange(b)
        out[sizes - 1, rows] = v[sizes - 1, :, rows].argmax(1)
        for t in range(n - 1, 0, -1):
            z = int(first[t])
            out[t - 1, z:] = (v[t - 1, :, z:] + into[out[t, z:]].T).argmax(0)
        return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, type number) of a tag sequence."""
    out, start, kind = [], -1, -1
    for i, t in enumerate(tags.tolist() + [0]):
        k, begins = ((t - 1) // 2, t % 2 == 1) if t else (-1, False)
        if start >= 0 and (k != kind or begins):
            out.append((start, i, kind))
            start = -1
        if k >= 0 and start < 0:
            start, kind = i, k
    return out


def propose(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Reconciled spans of each text. Of overlapping spans from neighbouring windows the one farther from its window's edges stays."""
    places: list[tuple[int, int, int, int, int]] = []
    coded: dict[int, np.ndarray] = {}
    for n, text in enumerate(texts):
        seg = segments(text) if text else []
        if seg:
            coded[n] = numbers(text)
        places += [(e - s, n, s, e, 2 * (s > a) + (e < b)) for a, b in seg for s, e in windows(a, b)]
    places.sort()
    raw: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for x in range(0, len(places), BATCH):
        part = places[x : x + BATCH]
        ids = np.zeros((part[-1][0], len(part)), np.int16)
        for j, (size, n, s, e, _) in enumerate(part):
            ids[:size, j] = coded[n][s:e]
        tags = tagger.decode(ids, np.array([p[0] for p in part]))
        some = np.flatnonzero(tags.any(0))
        for j in some.tolist():
            size, n, s, e, cut = part[j]
            for a, b, k in spans_of(tags[:size, j]):
                left, right = a if cut & 2 else WINDOW, size - b if cut & 1 else WINDOW
                raw[n].append((min(left, right), s + a, s + b, k))
    out = []
    for found in raw:
        kept: list[tuple[int, int, int]] = []
        for _, s, e, k in sorted(found, key=lambda r: (-r[0], r[1], -r[2])):
            if all(e <= a or s >= b for a, b, _ in kept):
                kept.append((s, e, k))
        out.append(sorted(kept))
    return out


_W = r"[A-Za-zÀ-ÖØ-öø-ÿ]"
_GAP = r"[ \t\xa0]*(?:[\n\f][ \t]*)?"
_AT = rf"{_GAP}(?:@|[\[(]{_GAP}(?:at|chiocciola){_GAP}[\])]){_GAP}"
EMAIL = re.compile(rf"(?<![\w.+%-])[\w.+%-]*\w{_AT}\w[\w-]*(?:\.\w[\w-]*)+", re.IGNORECASE)
PHONE = re.compile(r"(?<![\w/.,+-])(?:(?:\+|00)[ ]?39(?:[ ./-]|[ ]?\n)?)?(?:3\d{2}|0\d{1,3})(?:(?:[ ./-]|[ ]?\n)?\d){5,8}(?![\w]|[/.-]\d)")
TAX_CODE = re.compile(r"(?<!\w)[A-Z]{3}\s?[A-Z]{3}\s?[0-9LMNPQRSTUVO]{2}[ABCDEHLMPRST][0-9LMNPQRSTUVO]{2}\s?[A-Z][0-9LMNPQRSTUVO]{3}[A-Z](?!\w)", re.IGNORECASE)
CARD = re.compile(r"(?<!\w)C[A-Z]\s?\d{5}\s?[A-Z]{2}(?!\w)", re.IGNORECASE)
HOUSE = rf"(?:snc|s\.n\.c\.?|(?:n(?:um|r)?\s?\.?\s?°?|n°|civico|civ\.)?\s?\d{{1,4}}(?:\s?/\s?[A-Za-z](?!\w))?(?:\s(?:bis|ter|quater)\b)?(?:,?\s(?:int|scala|sc|piano|p)\.?\s?\d{{1,3}})?)"
ADDRESS = re.compile(rf"(?<!\w)(?:{STREETS})\s+(?:\d{{1,2}}\s+(?=[A-Z]))?(?:(?:[^\W\d_][\w'’-]*|[A-Z]\.)\s+){{0,5}}?[^\W\d_][\w'’-]*(?:,\s*|\s+){HOUSE}(?![\w])", re.IGNORECASE)
STREET = re.compile(rf"(?<!\w)(?:{STREETS})\s", re.IGNORECASE)
_TITLES = frozenset("sig sig.ra sig.na sigg dott dott.ssa ing arch avv geom rag prof prof.ssa dr on il la lo l'avv l'ing l'arch e di f.to firmato da".split())
NAME_WORD = re.compile(r"[A-ZÀ-Ö][\w'’À-ÿ]*(?:-\s?[A-ZÀ-Ö][\w'’À-ÿ]*)*|[A-ZÀ-Ö]\.")
_FORMS = {0: (EMAIL,), 1: (PHONE,), 2: (TAX_CODE, CARD), 3: (ADDRESS,)}


def coded(match: str) -> bool:
    """Whether a tax code has digits enough; letters may stand for some, but words have none."""
    return sum(c.isdigit() for c in match) >= 5


def _name(text: str, s: int, e: int) -> tuple[int, int] | None:
    """The words of a name within a proposed span: capitalised, two or more (or an initial and one), without titles."""
    while s > 0 and text[s - 1].isalnum() and text[s].isalnum():
        s -= 1
    while e < len(text) and text[e - 1].isalnum() and text[e].isalnum():
        e += 1
    words = [(m.start() + s, m.end() + s) for m in re.finditer(r"\S+", text[s:e])]
    clean = []
    for a, b in words:
        while a < b and not text[a].isalnum():
            a += 1
        while b > a and not text[b - 1].isalnum() and not (text[b - 1] == "." and b - a == 2):
            b -= 1
        if a < b:
            clean.append((a, b))
    initial = lambda a, b: b - a == 2 and text[a].isupper() and text[a + 1] == "."
    while clean and (text[clean[0][0] : clean[0][1]].lower().rstrip(".") in _TITLES and not initial(*clean[0]) or not text[clean[0][0]].isupper()):
        clean.pop(0)
    while clean and not text[clean[-1][0]].isupper():
        clean.pop()
    if len(clean) < 2 or len(clean) > 4 or any(not NAME_WORD.fullmatch(text[a:b]) for a, b in clean):
        return None
    if sum(b - a >= 3 for a, b in clean) < 1 or re.search(r"[,;:()\d]", text[clean[0][0] : clean[-1][1]]):
        return None
    return clean[0][0], clean[-1][1]


def checked(text: str, proposed: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """Proposals whose form holds, with exact bounds; names inside addresses are dropped, as is what lies within an earlier case."""
    out: list[tuple[int, int, str]] = []
    for kind in (0, 2, 3, 1, 4):
        for s, e, k in proposed:
            if k != kind:
                continue
            if kind == 4:
                hit = _name(text, s, e)
                best = [hit] if hit else []
            else:
                low, high = max(0, s - FORM), min(len(text), e + FORM)
                best = []
                for form in _FORMS[kind]:
                    # a case may begin before the margin; then the text is searched from its start of word
                    hits = list(form.finditer(text, low, high))
                    if kind == 3:  # "corso" may precede a street: of forms within each other the one nearest to the decoded bounds counts
                        inner = [x for m in hits for w in STREET.finditer(text, m.start() + 1, m.end()) if (x := form.match(text, w.start(), high))]
                        hits = sorted((m for m in [*hits, *inner] if m.start() < e and m.end() > s), key=lambda m: abs(m.start() - s) + abs(m.end() - e))[:1]
                    for m in hits:
                        if m.start() < e and m.end() > s and (form is not TAX_CODE or coded(m.group())):
                            best.append((m.start(), m.end()))
                if kind == 1:
                    best = [(a, b) for a, b in best if 8 <= sum(c.isdigit() for c in text[a:b]) - (4 if text[a:].startswith("00") else 2 if text[a] == "+" else 0) <= 11]
            for a, b in best:
                if all(b <= x or a >= y for x, y, _ in out):
                    out.append((a, b, TYPES[kind]))
    return sorted(out)


_taggers: dict[str, Tagger] = {}


def tagger(path: str = MODEL) -> Tagger:
    if path not in _taggers:
        _taggers[path] = Tagger.load(path)
    return _taggers[path]


def cases(texts: list[str | None], path: str = MODEL) -> list[list[tuple[int, int, str]]]:
    plain = [t or "" for t in texts]
    return [checked(t, p) for t, p in zip(plain, propose(tagger(path), plain))]


def found(acts: DataFrame, key: str = "id", fields: tuple[str, ...] = ("oggetto", "testo_estratto")) -> DataFrame:
    """(atto_id, campo, tipo, inizio, fine) of every case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f in fields:
                for i, found_ in zip(b["atto_id"], cases(b[f].tolist())):
                    rows += [(i, f, k, s, e) for s, e, k in found_]
            yield pd.DataFrame(rows, columns=["atto_id", "campo", "tipo", "inizio", "fine"])

    d = spread(acts.select(F.col(key).cast("long").alias("atto_id"), *fields))
    return d.mapInPandas(run, "atto_id long, campo string, tipo string, inizio int, fine int")


def masked_text(text: str | None, found_: list[tuple[int, int, str]]) -> str | None:
    if text is None:
        return None
    out, last = [], 0
    for s, e, k in found_:
        out += [text[last:s], f"[{k.upper()}]"]
        last = e
    return "".join([*out, text[last:]])


def masked(acts: DataFrame, key: str = "id", fields: tuple[str, ...] = ("oggetto", "testo_estratto")) -> DataFrame:
    """(atto_id, oggetto, testo_estratto) with each case replaced by its type in brackets; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"atto_id": b["atto_id"]}
            for f in fields:
                t = b[f].tolist()
                out[f] = [masked_text(x, c) for x, c in zip(t, cases(t))]
            yield pd.DataFrame(out)

    d = spread(acts.select(F.col(key).cast("long").alias("atto_id"), *fields))
    return d.mapInPandas(run, "atto_id long, " + ", ".join(f"{f} string" for f in fields))
