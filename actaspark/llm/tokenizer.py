"""Byte-level BPE by a lazily determinised transducer.

The merges of a vocabulary are compiled, as far as the corpus asks for them, into a deterministic transducer over bytes. A state
holds the bytes of the word that are not settled yet, with the last token of the encoding of each of their prefixes; a
step reads a byte, and emits the tokens on which all continuations agree. Pending bytes never exceed the
lookahead (the longest token still open), and a state's steps are computed when first taken and then looked up.

Encoding rests on two facts about merge order: the encoding of a prefix up to a token boundary is the prefix of the
encoding, and two neighbouring tokens stand only if merging their bytes alone gives those two back. So the last token
of a prefix is the longest token ending there that goes with the last token before it.

Defined results: an empty or null text has an empty list of ids. Text that looks like a special token is plain text.
Lone surrogates cannot occur in a Spark string; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import os
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from actaspark.storage import spread

VOCABULARY = os.environ.get("ACTASPARK_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: The fixed pattern that splits text before merges; part of the vocabulary's definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps at hand, and states of the transducer, before it starts anew.
WORDS, STATES = 500_000, 400_000


class Transducer:
    """Encoder of single words (byte strings as split by PATTERN)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.prefixes = {b[:i] for b in ranks for i in range(1, len(b))}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: settled token before the pending bytes (-1 at the start), pending bytes, last token of each pending prefix
        self.states: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.table: list[tuple[int, bytes, tuple[int, ...]]] = [(-1, b"", ())]
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def merge(self, word: bytes) -> list[int]:
        """Merges by definition: the pair of least rank, leftmost first, until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            r = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            m = min(r)
            if m == 1 << 60:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(r) and r[i] == m:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return [self.ranks[p] for p in parts]

    def _goes(self, a: int, b: int) -> bool:
        """Whether token b may follow token a."""
        if a < 0:
            return True
        k = (a, b)
        if k not in self._pairs:
            self._pairs[k] = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return self._pairs[k]

    def _step(self, s: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, last = self.table[s]
        w = pending + bytes((byte,))
        n = len(w)
        token = -1
        for i in range(max(0, n - self.longest), n):  # longest token first
            t = self.ranks.get(w[i:])
            if t is not None and self.merge(w[i:]) == [t] and self._goes(last[i - 1] if i else before, t):
                token = t
                break
        last = (*last, token)
        # a later token can start only where what follows is still the beginning of a token, or at the end
        starts = [i for i in range(max(0, n - self.longest), n) if w[i:] in self.prefixes]
        chains = []
        for i in [*starts, n]:
            cuts = set()
            while i:
                cuts.add(i)
                i -= len(self.bytes[last[i - 1]])
            chains.append(cuts)
        agreed = max(set.intersection(*chains), default=0)
        out: list[int] = []
        i = agreed
        while i:
            t = last[i - 1]
            out.append(t)
            i -= len(self.bytes[t])
        if agreed:
            before, w, last = out[0], w[agreed:], last[agreed:]
        key = (before, w)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = len(self.table)
            self.table.append((before, w, last))
            self.steps.append({})
        step = (to, tuple(reversed(out)))
        self.steps[s][byte] = step
        return step

    def encode(self, word: bytes) -> tuple[int, ...]:
        if len(self.table) > STATES:
            self._reset()
        s, ids, steps = 0, [], self.steps
        for byte in word:
            step = steps[s].get(byte) or self._step(s, byte)
            s = step[0]
            if step[1]:
                ids.extend(step[1])
        _, w, last = self.table[s]
        rest, i = [], len(w)
        while i:
            rest.append(last[i - 1])
            i -= len(self.bytes[last[i - 1]])
        ids.extend(reversed(rest))
        return tuple(ids)


class Encoder:
    """Encoder of texts: splits into words and looks up their ids, which the transducer gives at first sight."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer, self.words, self.split = Transducer(ranks), {}, regex.compile(PATTERN)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        words, ids = self.words, []
        for w in self.split.findall(text):
            t = words.get(w)
            if t is None:
                t = self.transducer.encode(w.encode("utf-8"))
                if len(w) <= 64:
                    if len(words) >= WORDS:
                        words.clear()
                    words[w] = t
            ids += t
        return ids


class Utf8Stream:
    """Incremental UTF-8 decoding: ``feed`` gives the text that the bytes so far settle, ``close`` the rest.

    The state machine follows the standard's table of well-formed sequences; a maximal ill-formed part gives one U+FFFD.
    """

    def __init__(self) -> None:
        self.need, self.low, self.high, self.code = 0, 0x80, 0xBF, 0

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.low, self.high, self.code, self.need = 0x80, 0xBF, self.code << 6 | b & 0x3F, self.need - 1
                    if not self.need:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 0x0F
                self.low, self.high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(b, (0x80, 0xBF))
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 0x07
                self.low, self.high = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(b, (0x80, 0xBF))
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        rest, self.need, self.low, self.high = "�" if self.need else "", 0, 0x80, 0xBF
        return rest


_encoders: dict[str, Encoder] = {}
_lock = threading.Lock()


def encoder(path: str = VOCABULARY) -> Encoder:
    """The worker's encoder; its transducer grows over the batches the worker sees."""
    with _lock:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]


def decode(ids: list[int], path: str = VOCABULARY) -> str:
    """Text of ids, decoded as a stream."""
    table, stream = encoder(path).transducer.bytes, Utf8Stream()
    return "".join(stream.feed(table[i]) for i in ids) + stream.close()


def encode(docs: DataFrame, doc: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every document; narrow, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [e.encode(t) for t in b["text"]]})

    d = spread(docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return d.mapInPandas(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, testo) from (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "testo": [None if i is None else decode([int(x) for x in i], path) for i in b["ids"]]})

    return docs.select("doc_id", "ids").mapInPandas(run, "doc_id long, testo string")


def round_trip(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, token, uguale): number of ids and whether decoding gives the text back (null text: compared as empty)."""
    ids = encode(docs, path=path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain = [decode([int(x) for x in i], path) for i in b["ids"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "token": b["ids"].map(len), "impronta": [hashlib.sha256(t.encode()).hexdigest() for t in plain]})

    d = ids.mapInPandas(run, "doc_id long, token int, impronta string")
    t = docs.select(F.col("doc_id").alias("d2"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("i2"))
    return d.join(t, d["doc_id"] == t["d2"]).groupBy("doc_id", "token").agg(F.max(F.col("impronta") == F.col("i2")).alias("uguale"))
