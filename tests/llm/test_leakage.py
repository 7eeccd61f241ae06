import random

import numpy as np

from actaspark.llm import leakage as L
from actaspark.llm.words import words

# so many words that passages repeat none nearby: a repeated word may begin or end a longer run that allows more edits
VOC = [f"parola{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefghijklmnop"]


def passage(r, n):
    return [r.choice(VOC) for _ in range(n)]


def edited(r, w, k):
    """w with k edits spread over it."""
    w = list(w)
    for x in sorted(r.sample(range(2, len(w) - 2), k), reverse=True):
        op = r.choice("cad")
        if op == "c":
            w[x] = "cambiata"
        elif op == "a":
            w.insert(x, "aggiunta")
        else:
            del w[x]
    return w


def test_joined_cases(spark):
    r = random.Random(5)
    items = [(i, " ".join(passage(r, 80))) for i in range(12)] + [(50, None), (51, ""), (52, " ".join(passage(r, 44)))]
    fill = lambda n: " ".join(f"altro{r.randint(0, 400)}" for _ in range(n))
    docs, want = [], set()

    def add(text, *hits):
        docs.append((len(docs), text, "x"))
        want.update((len(docs) - 1, h) for h in hits)

    for i in range(12):
        w = items[i][1].split()
        add(f"{fill(30)}. {items[i][1].upper()} {fill(20)}", i)
        add(fill(10) + " " + ",\n".join(w[10:55]), i)  # 45 words
        add(fill(10) + " " + " ".join(w[10:54]) + " " + fill(20))  # 44 words
        add(" ".join(edited(r, w[:70], 6)), i)
        add(" ".join(x if n % 4 else "zzz" for n, x in enumerate(w)))  # a quarter changed
        add(" ".join(w[:30]) + " " + fill(40) + " " + " ".join(w[40:70]))
    add(items[0][1] + " " + items[1][1], 0, 1)
    add(items[0][1], 0)
    add(None)
    add("")
    add(fill(60_000) + " " + items[3][1], 3)
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in L.join(d, q).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert L.join(d.limit(0), q).count() == 0 and L.join(d, q.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    items = [(i // 2, " ".join(passage(r, 60))) for i in range(14)]
    d = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(items)], "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(x) for x in L.join(d, q).collect()}
    monkeypatch.setattr(L, "BLOCK", 4)
    assert {tuple(x) for x in L.join(d, q).collect()} == whole == {(n, i) for n, (i, _) in enumerate(items)}


def test_edits_in_the_middle():
    """Runs of 50 words and more without a window of 45 words and at most 4 edits; against contains() over the whole document."""
    r = random.Random(7)
    runs = [(60, [15, 20, 25, 30, 35, 40]), (50, [9, 17, 25, 33, 41])]
    runs += [(n, sorted(r.sample(range(n // 6, n - n // 6), n // 10))) for n in (45, 49, 50, 55, 60, 70, 80, 89, 90, 120) for _ in range(12)]
    runs += [(n, sorted(r.sample(range(n // 6, n - n // 6), n // 10 + 2))) for n in (50, 60, 80) for _ in range(6)]  # too many
    met = 0
    for n, at in runs:
        w, other = [f"w{r.randint(0, 10**9)}" for _ in range(n)], lambda k: [f"altro{r.randint(0, 400)}" for _ in range(k)]
        doc = list(w)
        for x in reversed(at):
            op = "c" if (n, at) in runs[:2] else r.choice("ccad")
            doc[x : x + (op != "a")] = [] if op == "d" else ["cambiata"]
        index = L.Index([(1, " ".join(w))])
        index.set_prefix(np.array([r.randint(0, 9) for _ in index.keys]))
        text = " ".join(other(r.randint(0, 90)) + doc + other(20))
        want = L.contains(index.items[0][1][:, None] == index.numbers(text)[None, :])
        assert index.matches(text) == ({1} if want else set()), (n, at)
        met += want
    assert met >= 2 + 12 * 8


def stands(item, doc):
    """Plain dynamic program: edit distance of every run of the item to any part of the document, first and last word equal."""
    for a in range(len(item) - L.LEAST + 1):
        row = [0 if x == item[a] else 999 for x in ["", *doc]]
        for j in range(1, len(row)):
            row[j] = min(row[j], row[j - 1] + 1)
        for n, w in enumerate(item[a + 1 :], 2):
            if n >= L.LEAST and any(x == w and row[j] * L.EDIT <= n for j, x in enumerate(doc)):
                return True
            new = [row[0] + 1]
            for j, x in enumerate(doc, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != w)))
            row = new
    return False


def test_exact_against_plain_program():
    """Passages of 45 to 120 words with floor(n / 10) changes, drops and additions at any place, and some more: none is lost, none too many."""
    r = random.Random(8)
    met = 0
    for t in range(90):
        n = r.choice([45, 46, 50, 53, 60, 70, 88, 90, 120])
        w = [f"w{r.randint(0, 10**9)}" for _ in range(r.randint(0, 12) + n)]
        part, k = w[len(w) - n :], n // 10 + (0 if t % 3 else r.randint(1, 3))
        at = [*range(4, n - 1, max(n // k, 1))][:k] if t % 2 else r.sample(range(1, n - 1), k)
        doc = list(part)
        for x in sorted(at, reverse=True):
            op = r.choice("cad")
            doc[x : x + (op != "a")] = [] if op == "d" else ["cambiata"]
        doc = [f"altro{r.randint(0, 400)}" for _ in range(r.randint(0, 60))] + doc + [f"altro{r.randint(0, 400)}" for _ in range(15)]
        index = L.Index([(1, " ".join(w))])
        index.set_prefix(np.array([r.randint(0, 9) for _ in index.keys]))
        want = stands(w, doc)
        assert L.contains(index.items[0][1][:, None] == index.numbers(" ".join(doc))[None, :]) == want
        assert index.matches(" ".join(doc)) == ({1} if want else set()), t
        assert want or t % 3 == 0
        met += want
    assert met >= 60


def test_second_run_where_the_best_alignment_fails():
    """90 words with one in seven changed, then 45 words with four changed: only the latter is a case."""
    w = [f"w{i}" for i in range(200)]
    doc = [x if i >= 90 or i % 7 else f"altro{i}" for i, x in enumerate(w[:90])] + ["fine"] * 6
    doc += [x if i not in (8, 17, 26, 35) else f"altro{i}" for i, x in enumerate(w[140:185])]
    index = L.Index([(1, " ".join(w))])
    assert index.matches(" ".join(doc)) == {1} and index.matches(" ".join(doc[:96])) == set()


def test_words():
    assert words("L'Unità, già̀ <b>d'Italia</b> &nbsp; SARÃ\xa0") == ["l", "unita", "gia", "d", "italia", "sara"]
