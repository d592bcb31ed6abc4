import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rookery.llm.bpe import encode_documents, sufficient_lookahead, transducer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return transducer(open(PATH, encoding="utf-8").read())


def ids(t, text):
    return np.frombuffer(b"".join(t.encode(text)), "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab eést'lr01 \n\t\x1c\x85 🎉<|endoftext>", max_size=60))
def test_same_ids_and_text_as_the_library(library, own, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids(own, text) == want
    assert "".join(own.decode(own.encode(text))) == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 20000, " " * 9001, "ab" * 7000, "-" * 9999, "the" * 5000, "é" * 6000, "<|endoftext|>" * 3 + " x", "".join(random.Random(1).choices("etaoinsh", k=40000)), "".join(random.Random(2).choices("a b\n ", k=150000))])
def test_long_stretches_stream_to_the_same_ids(library, own, text):
    assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


def test_tokens_are_stable_within_the_lookahead(own):
    """Whatever follows, tokens that end ``lookahead`` bytes before the end of a prefix stay."""
    rng = random.Random(4)
    for _ in range(60):
        data = "".join(rng.choices(["e", "t", "the", "ing", "re", "n", "er"], k=400)).encode()
        cut = rng.randint(own.lookahead + 10, len(data))
        part, whole, at = own.tokens(data[:cut]), own.tokens(data), 0
        for a, b in zip(part, whole, strict=False):
            at += own.length[a]
            if at > cut - own.lookahead:
                break
            assert a == b


def test_lookahead_of_small_merge_lists():
    assert sufficient_lookahead([]) == 1
    assert sufficient_lookahead([(b"a", b"b")]) == 2
    assert sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 4  # whether "bc" merges decides "ab"


def test_documents(spark, library):
    texts = ["Hello there", None, "", "x <|endoftext|>", "Hello there"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in encode_documents(docs, PATH, ids=True).collect():
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert encode_documents(docs.limit(0), PATH).collect() == []


def test_clashing_columns_and_ids_asked_for(spark, library):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "hello there", "x", 5), (None, None, "y", 6)], "doc_id long, text string, ids string, n_tokens int")
    rows = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), ids=True).collect()
    assert {r.doc_id: (r.n_tokens, list(r.ids)) for r in rows} == {1: (len(x := library.encode("hello there", add_special_tokens=False).ids), x), None: (0, [])}


def test_memory_of_what_was_seen_is_bounded(own, monkeypatch):
    monkeypatch.setattr("rookery.llm.bpe.MEMO", 50)
    monkeypatch.setattr("rookery.llm.bpe.BESIDE", 50)
    own.forget()
    text = " ".join(f"word{i}x{i * i}" for i in range(2000))
    a = b"".join(own.encode(text))
    assert len(own.memo) <= 50 and len(own.memo.before) <= 50 and len(own.beside) <= 50
    monkeypatch.undo()
    own.forget()
    assert b"".join(own.encode(text)) == a


def test_few_lookups_a_token(library, monkeypatch):
    """Only lengths that tokens with the same start have are looked up."""

    class Counted(dict):
        n = 0

        def get(self, *key):
            Counted.n += 1
            return super().get(*key)

    t = transducer.__wrapped__(open(PATH, encoding="utf-8").read())
    rng = random.Random(5)
    words = ["".join(rng.choices(["th", "on", "ing", "er", "ed", "ea", "é", "tion"], k=rng.randint(2, 5))) for _ in range(3000)]
    monkeypatch.setattr(t, "inner", Counted(t.inner))
    got = [np.array([np.frombuffer(t.out[i], "<u4")[0] for i in t.tokens(w.encode())]).tolist() for w in words]
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert Counted.n < 3.5 * sum(map(len, got)), Counted.n / sum(map(len, got))
