"""Training of the tagger from labelled spans: ``python -m actaspark.llm.pii_train TABLE.parquet``.

Spans are labelled by rules of form and context over a bounded sample of acts (SAMPLE texts); some windows get misread characters and changed
case, so the network learns context rather than the rules' letter. One in ten windows is held out; the accuracy on them is printed.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pandas as pd

from actaspark.llm.pii import ADDRESS, CARD, EMAIL, PHONE, STREETS, TAGS, TAX_CODE, TYPES, WINDOW, Tagger, coded, numbers, segments, soft, spans_of, windows

#: Texts of the sample (the documented bound), passes, windows of a step, rate.
SAMPLE, EPOCHS, STEP, RATE = 9_000, 13, 128, 6e-3
#: Given names by which names are labelled; fixed values, common in the region.
GIVEN = (
    "Agata Alfio Bianca Calogero Carmela Concetta Dario Elena Enzo Fabio Gaspare Grazia Ignazio Irene Livio Lucia Marianna Marta Nedda Ninfa Nunzio "
    "Olga Orazio Pippo Rosalia Santo Saro Silvia Teresa Turi Venera Vito"
).split()
_G = "(?:" + "|".join(f"{g}|{g.upper()}" for g in GIVEN) + ")"
_S = r"(?:[A-Z][a-z]{3,}|[A-Z]{4,})(?:-\s?(?:[A-Z][a-z]{3,}|[A-Z]{4,}))?"
# a surname before the given name, unless one follows on the same line; else a surname after it; else an initial and a surname
NAME = re.compile(
    rf"(?<![\w@._-])(?:(?!{_G}\b){_S}\s{_G}(?:\s{_G})?(?! {_S}(?!\w))|{_G}(?:\s{_G})?\s(?!{_G}\b){_S}|[A-Z]\.(?:\s?[A-Z]\.)?\s{_S})(?![\w@-])"
)
_NOT_BEFORE = re.compile(rf"(?:scuola|scuole|intitolat[oa]\s+a|istituto|plesso|palestra|ditta|societ[àa]|{STREETS})\s+$", re.IGNORECASE)
_NOT_AFTER = re.compile(r"\s*(?:&|servizi|costruzioni|impianti|multiservizi|s\.r\.l|s\.p\.a|s\.n\.c|s\.c\.a)", re.IGNORECASE)


def labels(text: str) -> list[tuple[int, int, int]]:
    """Labelled spans by form and context."""
    out: list[tuple[int, int, int]] = []

    def add(s: int, e: int, k: int) -> None:
        if all(e <= a or s >= b for a, b, _ in out):
            out.append((s, e, k))

    for k, forms in ((0, (EMAIL,)), (2, (TAX_CODE, CARD)), (3, (ADDRESS,))):
        for form in forms:
            for m in form.finditer(text):
                if form is not TAX_CODE or coded(m.group()):
                    add(m.start(), m.end(), k)
    for m in PHONE.finditer(text):
        before = text[max(0, m.start() - 24) : m.start()].lower()
        digits = sum(c.isdigit() for c in m.group())
        if digits >= 9 and not re.search(r"(?:pratica|iva|conto|cig|codice|n\.|protocollo|verbale|nota|capitolo)\s*$", before):
            add(m.start(), m.end(), 1)
    for m in NAME.finditer(text):
        if not _NOT_BEFORE.search(text[max(0, m.start() - 24) : m.start()]) and not _NOT_AFTER.match(text, m.end()):
            add(m.start(), m.end(), 4)
    return sorted(out)


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    t = np.zeros(n, np.int8)
    for s, e, k in spans:
        t[s:e] = 2 * k + 2
        t[s] = 2 * k + 1
    return t


def examples(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags (T, N)."""
    r = np.random.default_rng(seed)
    ids, tags = [], []
    for text in texts:
        whole = tags_of(len(text), labels(text))
        code = numbers(text)
        for a, b in segments(text):
            for s, e in windows(a, b):
                if not whole[s:e].any() and r.random() > 0.35:
                    continue
                # a span cut by the window begins with I, as it does when windows are decoded
                x, y = np.zeros(WINDOW, np.int16), np.zeros(WINDOW, np.int8)
                x[: e - s], y[: e - s] = code[s:e], whole[s:e]
                if r.random() < 0.25:
                    at = np.flatnonzero((x > 3) & (r.random(WINDOW) < 0.03))
                    x[at] = x[r.permutation(at)] if len(at) > 1 else x[at]
                ids.append(x)
                tags.append(y)
    return np.array(ids).T.copy(), np.array(tags).T.copy()


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def crf(e: np.ndarray, y: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log likelihood and its gradients for emissions, transitions and start scores."""
    n, b, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0] + start
    for t in range(1, n):
        alpha[t] = e[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(n - 2, -1, -1):
        beta[t] = _lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = _lse(alpha[-1], 1)
    rows = np.arange(b)
    gold = start[y[0]] + e[0, rows, y[0]]
    for t in range(1, n):
        gold = gold + trans[y[t - 1], y[t]] + e[t, rows, y[t]]
    g = np.exp(alpha + beta - z[:, None])
    gt = np.zeros_like(trans)
    for t in range(1, n):
        p = np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - z[:, None, None])
        gt += p.sum(0)
        np.add.at(gt, (y[t - 1], y[t]), -1)
    gs = g[0].sum(0)
    np.add.at(gs, y[0], -1)
    g[np.arange(n)[:, None], rows, y] -= 1
    return float((z - gold).mean()), g / b, gt / b, gs / b


def gradients(m: Tagger, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    kept = {"f": [], "b": []}
    h = {d: m._run(ids, d, kept[d]) for d in "fb"}
    e = h["f"] @ m.w["of"] + h["b"] @ m.w["ob"] + m.w["bo"]
    loss, ge, gt, gs = crf(e, y, m.w["t"], m.w["s"])
    ge = ge.astype(np.float32)
    g = {"t": gt, "s": gs, "bo": ge.sum((0, 1))}
    for d in "fb":
        w, rec = m.w[f"o{d}"], m.w[f"h{d}"]
        hidden = rec.shape[0]
        g[f"o{d}"] = np.einsum("tbh,tbk->hk", h[d], ge)
        gh_all = ge @ w.T
        gx, gr = np.zeros_like(m.w[f"x{d}"]), np.zeros_like(rec)
        gh, gc = np.zeros_like(h[d][0]), np.zeros_like(h[d][0])
        for t, act, gates, before, c, s, h_prev in reversed(kept[d]):
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            dh = gh_all[t] + gh
            dc = gc + dh * o * (1 - np.abs(s)) ** 2
            da = np.concatenate((dc * act[:, 3 * hidden :] * 0.5, dc * before * 0.5, dh * s * 0.5, dc * i), 1) * (1 - np.abs(act)) ** 2
            gc = dc * f
            gh = da @ rec.T
            gr += h_prev.T @ da
            np.add.at(gx, ids[t], da)
        g[f"x{d}"], g[f"h{d}"], g[f"b{d}"] = gx, gr, gx.sum(0)
    return loss, g


def fit(ids: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 0, say=print) -> Tagger:
    """Adam over shuffled windows with a rate that falls to a tenth."""
    m, r = Tagger.fresh(seed), np.random.default_rng(seed)
    mean, var = {k: np.zeros_like(v) for k, v in m.w.items()}, {k: np.zeros_like(v) for k, v in m.w.items()}
    step, total = 0, epochs * (ids.shape[1] // STEP + 1)
    for epoch in range(epochs):
        order, losses = r.permutation(ids.shape[1]), []
        for a in range(0, len(order), STEP):
            part = order[a : a + STEP]
            loss, g = gradients(m, ids[:, part], y[:, part].astype(np.int64))
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, x in g.items():
                x = x * min(1.0, 5.0 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * x
                var[k] = 0.999 * var[k] + 0.001 * x * x
                m.w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        say(f"epoch {epoch}: loss {np.mean(losses):.3f}")
    return m


def accuracy(m: Tagger, ids: np.ndarray, y: np.ndarray) -> dict[str, tuple[float, float]]:
    """Precision and recall of each type's spans over windows."""
    hit, said, there = np.zeros(len(TYPES)), np.zeros(len(TYPES)), np.zeros(len(TYPES))
    for a in range(0, ids.shape[1], 512):
        out = m.decode(ids[:, a : a + 512])
        for j in range(out.shape[1]):
            p, g = set(spans_of(out[:, j])), set(spans_of(y[:, a + j]))
            for s, n in ((p & g, hit), (p, said), (g, there)):
                for x in s:
                    n[x[2]] += 1
    return {t: (round(hit[i] / max(said[i], 1), 4), round(hit[i] / max(there[i], 1), 4)) for i, t in enumerate(TYPES)}


def main(path: str) -> None:
    acts = pd.read_parquet(path, columns=["ente_id", "url_fonte", "oggetto", "testo_estratto"]).drop_duplicates(["ente_id", "url_fonte"])
    acts = acts.sample(min(SAMPLE, len(acts)), random_state=1)
    texts = [t for c in ("testo_estratto", "oggetto") for t in acts[c].dropna() if t]
    ids, y = examples(texts)
    held = np.arange(ids.shape[1]) % 10 == 0
    print(f"{ids.shape[1]} windows, {len(TAGS)} tags", flush=True)
    m = fit(ids[:, ~held], y[:, ~held], say=lambda s: print(s, flush=True))
    print(accuracy(m, ids[:, held], y[:, held]))
    m.save()


if __name__ == "__main__":
    main(sys.argv[1])
