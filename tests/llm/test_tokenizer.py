import base64
import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from actaspark.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(T.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_gives_the_ids_and_comes_back(reference, text):
    ids = T.encoder().encode(text)
    assert ids == reference.encode_ordinary(text)
    assert T.decode(ids) == text


def test_words_of_few_letters(reference):
    r = random.Random(1)
    for _ in range(3000):
        w = "".join(r.choice("abcdet nsè̀😀=") for _ in range(r.randint(1, 40)))
        assert T.encoder().encode(w) == reference.encode_ordinary(w)
    for w in ("a" * 3000, " " * 500, "=" * 777, "ab" * 900):
        assert T.encoder().encode(w) == reference.encode_ordinary(w)


def test_merges_by_definition_agree():
    t = T.encoder().transducer
    for w in (b"interessati", b"graduatoria", b"\xf0\x9f\x98\x80", b"zzzzzzzz", b" therefore"):
        assert list(t.encode(w)) == t.merge(w)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_stream_decodes_as_a_whole(data, step):
    s = T.Utf8Stream()
    assert "".join(s.feed(data[i : i + step]) for i in range(0, len(data), step)) + s.close() == data.decode("utf-8", "replace")


def test_table(spark):
    d = spark.createDataFrame([(1, "ciao mondo", "x"), (2, None, "x"), (3, "", "x"), (4, "<|endoftext|>", "x"), (4, "<|endoftext|>", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in T.encode(d).collect())
    assert [i for i, _ in got] == [1, 2, 3, 4, 4] and got[1][1] == [] and got[2][1] == [] and 50256 not in got[3][1]
    assert {r["doc_id"]: r["testo"] for r in T.decoded(T.encode(d)).collect()} == {1: "ciao mondo", 2: "", 3: "", 4: "<|endoftext|>"}
    assert all(r["uguale"] for r in T.round_trip(d).collect())
    assert T.encode(d.limit(0)).count() == 0
