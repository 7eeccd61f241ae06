"""Evaluation passages inside training documents: a prefix-filtered join on word shingles, verified exactly.

A document contains ``LEAST`` or more consecutive words of an item with at most one in ten changed, added or dropped. One edit breaks
at most ``K`` shingles of K words. A run of 90 words or more parts into two of 45 or more, one of which keeps the bound,
and a run can be shortened to the least length that allows its edits; so some window of 45, 50, 60, 70 or 80 item words has at
most 4, 5, 6, 7 or 8 edits (``RUNS``), and of its n - 4 shingles all but 5 for each edit stand in the document. Ordering a window's
shingles by rarity in the corpus, one of the 5 for each edit and one more that are rarest must match: only these prefix shingles are looked
up, and a pair that shares one is bounded (enough matches within a window of one of the lengths, near one diagonal) and
then verified by alignment over item-sized windows.

The items are a stated query set and are taken in blocks of bounded size, each sent to the workers as one
index; the corpus is scanned once per block: what it shares with the block's items (shingles; word numbers, where a match is possible at all) is
written, and rarity and join read that. Texts are never shuffled. Results stay narrow.

Null and empty texts match nothing. Items under 45 words match nothing. Repeated documents and items count each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from actaspark.llm.words import words
from actaspark.storage import materialise, spread

#: Fixed values of the check: words of a passage, one edit in so many words. K: words of a shingle.
LEAST, EDIT, K = 45, 10, 5
#: (shingles of a window, those that stand in the document) for the run lengths one of which every case has, and the least of the latter.
WINDOWS = (LEAST, *range(-(-(LEAST + 1) // EDIT) * EDIT, 2 * LEAST, EDIT))
RUNS = tuple((n - K + 1, n - K + 1 - K * (n // EDIT)) for n in WINDOWS)
SHARED = min(s for _, s in RUNS)
#: Items of one block (about 100 words each, so some 50 MB of index).
BLOCK = 20_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _shingles(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of K known words, and their positions; ids are int64, negative for unknown words."""
    n = len(ids) - K + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ok = np.ones(n, bool)
    h = np.zeros(n, np.uint64)
    for k in range(K):
        part = ids[k : k + n]
        ok &= part >= 0
        h = h * _MULTIPLIER + (part + 1).astype(np.uint64)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(ok)
    return h[at], at


class Index:
    """Items of one block: word numbers, shingles and where they stand."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            w = words(text)
            if len(w) < LEAST:
                continue
            ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64)
            h, at = _shingles(ids)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items), np.int64))
            places.append(at)
            self.items.append((item_id, ids))
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        h, o, p = cat(hashes, np.uint64), cat(owners, np.int64), cat(places, np.int64)
        by = np.lexsort((p, o, h))
        self.h, self.o, self.p = h[by], o[by], p[by]
        self.keys, self.first = np.unique(self.h, return_index=True)
        self.last = np.append(self.first[1:], len(self.h))
        self.prefix = np.ones(len(self.keys), bool)
        self.width = max((len(x) for _, x in self.items), default=0) // EDIT + 1

    def numbers(self, text: str) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def lookup(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key number, document position) of each shingle that any item has."""
        h, at = _shingles(ids)
        if not len(h) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = self.keys[k] == h
        return k[hit], at[hit]

    def _spread(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every entry of some keys, without a loop, and how many each key has."""
        size = self.last[k] - self.first[k]
        e = np.repeat(self.first[k] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        e += np.arange(len(e))
        return e, size

    def likely(self, distinct: np.ndarray) -> np.ndarray:
        """Whether each item has as many places with one of the keys as the least any run shares."""
        return np.bincount(self.o[self._spread(distinct)[0]], minlength=len(self.items)) >= SHARED

    def set_prefix(self, frequency: np.ndarray) -> None:
        """Keeps, of every window of an item, so many of the rarest shingles that not all can be missing (ties by hash)."""
        by_rank = np.lexsort((self.keys, frequency))
        rank = np.empty(len(self.keys), np.int64)
        rank[by_rank] = np.arange(len(self.keys))
        self.prefix[:] = False
        key_of = np.searchsorted(self.keys, self.h)
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, o, p in zip(key_of, self.o, self.p):
            by_item[int(o)].append((int(p), int(k)))
        for entries in by_item.values():
            entries.sort()
            ks = np.array([k for _, k in entries])
            for window, shared in RUNS:
                if len(ks) >= window:
                    ranks = np.sort(np.lib.stride_tricks.sliding_window_view(rank[ks], window), axis=1)
                    self.prefix[by_rank[ranks[:, : window - shared + 1]]] = True

    def candidates(self, k: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item number, diagonal) of pairs within the bounds, one for each band of diagonals; k, at as ``lookup`` gives them."""
        if not len(k):
            return
        distinct = np.unique(k)
        marked = self.likely(distinct)
        if not marked.any():
            return
        rare = np.zeros(len(self.items), bool)
        rare[self.o[self._spread(distinct[self.prefix[distinct]])[0]]] = True
        marked &= rare
        if not marked.any():
            return
        e, size = self._spread(k)
        some = marked[self.o[e]]
        owner, place, here = self.o[e[some]], self.p[e[some]], np.repeat(at, size)[some]
        # matches of an item in three neighbouring bands of diagonals, as wide as the longest item allows
        wide = self.width
        code, many = np.unique(owner * 4_000_000_000 + (here - place + 2_000_000_000) // wide, return_counts=True)
        near = many.copy()
        follows = code[1:] == code[:-1] + 1
        near[1:][follows] += many[:-1][follows]
        near[:-1][follows] += many[1:][follows]
        enough = np.unique(code[near >= SHARED] // 4_000_000_000)
        for o in enough.tolist():
            mine = owner == o
            p = place[mine]
            width = len(self.items[o][1]) // EDIT + 1
            band = (here[mine] - p) // width
            level, inverse = np.unique(band, return_inverse=True)
            many = np.bincount(inverse)
            done: set[int] = set()
            for x in np.argsort(-many, kind="stable").tolist():
                b = int(level[x])
                if b - 1 in done or b + 1 in done:
                    continue
                q = np.unique(p[np.abs(band - b) <= 1])
                if len(q) >= SHARED and any((np.searchsorted(q, q + window) - np.arange(len(q))).max() >= shared for window, shared in RUNS):
                    done.add(b)
                    yield o, b * width + width // 2

    def verify(self, o: int, ids: np.ndarray, diagonal: int) -> bool:
        """By alignment near a diagonal; a run of LEAST equal words on one diagonal is found first."""
        item = self.items[o][1]
        slack = 5 * (len(item) // EDIT + 1) // 2 + 1  # of the bands that one candidate stands for
        part = ids[max(0, diagonal - slack) : max(0, diagonal + len(item) + slack)]
        equal = item[:, None] == part[None, :]
        return run_of(equal, LEAST) or contains(equal)

    def matches(self, text: str | None) -> set[int]:
        """The ids of the items that the text contains."""
        if not text:
            return set()
        ids = self.numbers(text)
        return self.found(ids, *self.lookup(ids))

    def found(self, ids: np.ndarray, k: np.ndarray, at: np.ndarray) -> set[int]:
        out: set[int] = set()
        for o, d in self.candidates(k, at):
            if self.items[o][0] not in out and self.verify(o, ids, d):
                out.add(self.items[o][0])
        return out


def run_of(equal: np.ndarray, length: int) -> bool:
    """Whether so many cells in a row on a diagonal are true; by runs of powers of two, and what they lack."""
    if min(equal.shape) < length:
        return False
    have, run = 1, equal
    while have < length:
        step = min(have, length - have)
        run = run[:-step, :-step] & run[step:, step:]
        have += step
    return bool(run.any())


def contains(equal: np.ndarray) -> bool:
    """equal: for each item word (rows), whether it is each document word. Whether a run of LEAST or more item words stands in the document with at most one edit in EDIT words; exact, over all alignments.

    The run's first and last word stand in the document: words missing at its ends are not words it contains. Edit distances of the runs from
    every item place to every end in the document are followed, all places at once; a place that has more edits than its longest run allows is left.
    """
    n, m = equal.shape
    if n < LEAST or m < LEAST - LEAST // EDIT:
        return False
    idx = np.arange(m, dtype=np.int16)
    far = np.int16(n + 1)
    start = np.arange(n - LEAST + 1)
    d = np.where(equal[start], np.int16(0), far)
    for k in range(1, n + 1):
        if k > 1:
            if start[-1] + k > n:
                d, start = d[:-1], start[:-1]
                if not len(start):
                    return False
            same = equal[start + k - 1]
            new = d + np.int16(1)  # dropped
            np.minimum(new[:, 1:], d[:, :-1] + ~same[:, 1:], out=new[:, 1:])
            if k >= LEAST and (same[:, 1:] & (d[:, :-1] <= k // EDIT)).any():
                return True
            d = new
        d -= idx  # added
        np.minimum.accumulate(d, axis=1, out=d)
        d += idx
        live = d.min(1) * EDIT <= n - start
        if not live.all():
            d, start = d[live], start[live]
            if not len(start):
                return False
    return False


def _blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, by id; each is fetched by a range of ids found from the last."""
    d = items.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t"))
    low = None
    while True:
        part = (d if low is None else d.where(F.col("i") > low)).orderBy("i").limit(BLOCK).collect()
        if not part:
            return
        if len(part) == BLOCK:  # an id that is cut in two is fetched whole
            top = part[-1]["i"]
            part = [r for r in part if r["i"] < top] + d.where(F.col("i") == top).collect()
        low = part[-1]["i"]
        yield [(r["i"], r["t"]) for r in part]


def join(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id) of every document that contains a passage of the item."""
    spark = docs.sparkSession
    d = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")))
    out = spark.createDataFrame([], "doc_id long, item_id long")
    for block in _blocks(items, item, item_text):
        index = Index(block)
        shared = spark.sparkContext.broadcast(index)

        def shared_parts(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ix = shared.value
            n = np.zeros(len(ix.keys), np.int64)
            layout = ["doc_id", "k", "posto", "parole"]
            for b in batches:
                rows = []
                for i, t in zip(b["doc_id"], b["text"]):
                    ids = ix.numbers(t)
                    k, at = ix.lookup(ids)
                    distinct = np.unique(k)
                    n[distinct] += 1
                    if len(k) and ix.likely(distinct).any():
                        rows.append((i, k.astype(np.int32), at.astype(np.int32), ids.astype(np.int32)))
                yield pd.DataFrame(rows, columns=layout)
            # the partition's documents by shingle, in a row of its own
            at = np.flatnonzero(n)
            yield pd.DataFrame([(None, at.astype(np.int32), n[at].astype(np.int32), None)], columns=layout)

        parts = materialise(d.mapInPandas(shared_parts, "doc_id long, k array<int>, posto array<int>, parole array<int>"), "leaks")
        frequency = np.zeros(len(index.keys), np.int64)
        counts = parts.where("parole is null").select(F.inline(F.arrays_zip("k", F.col("posto").alias("n"))))
        # one row per shingle of the block
        for r in counts.groupBy("k").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
            frequency[r.k] = r.n
        index.set_prefix(frequency)
        ready = spark.sparkContext.broadcast(index)

        def match(batches: Iterator[pd.DataFrame], ready=ready) -> Iterator[pd.DataFrame]:
            ix = ready.value
            for b in batches:
                rows = [(i, x) for i, ids, k, at in zip(b["doc_id"], b["parole"], b["k"], b["posto"]) for x in sorted(ix.found(ids, k.astype(np.int64), at.astype(np.int64)))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"], dtype="int64")

        out = out.unionByName(parts.where("parole is not null").select("doc_id", "parole", "k", "posto").mapInPandas(match, "doc_id long, item_id long"))
    return out
