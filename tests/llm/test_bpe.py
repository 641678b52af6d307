import os
import random

import pytest

from graphloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.tokenizer_path()), reason="no tokenizer file")
TEXTS = [
    None, "", " ", "a", "Hello world", "I'll  don't\n\n\tx ", "<|endoftext|> x<|endoftext|>", "naïve café", "關聯表會統計", "このモジュール", "😀👩‍👩‍👧🇹🇼", "a\u0300\u200b\ufeff", "x" * 5000, " " * 3000, "ab" * 4000,
    "0123456789" * 300, "\x00\x01\x7f", "ÃÂ" * 500, "--- === ___", "\r\n\r\n", "العقد المتأثرة", "मॉड्यूल सूची",
]


@pytest.fixture(scope="module")
def transducer():
    with open(bpe.tokenizer_path(), encoding="utf-8") as file:
        return bpe.Transducer(bpe.Vocabulary(file.read()))


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_against_the_library(transducer, library):
    rng = random.Random(7)
    letters = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x180), *range(0x4E00, 0x4E60), *range(0x3040, 0x30A0), 0x1F600, 0x1F1E6, 0x200D, 0xFEFF, 9, 10, 0)]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        ids = transducer.encode(text)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert "".join(bpe.decode_stream(transducer.vocabulary, ids)) == text


def test_forgetting_states_changes_nothing(transducer, monkeypatch):
    want = [transducer.encode(t) for t in TEXTS]
    monkeypatch.setattr(bpe, "_MOST_STATES", 5)
    monkeypatch.setattr(bpe, "_MOST_PIECES", 2)
    transducer.pieces.clear()
    assert [transducer.encode(t) for t in TEXTS] == want


def test_emits_before_the_end(transducer):
    state, out = 0, []
    for b in b"ab" * 100:
        state, more = transducer.steps[state].get(b) or transducer._step(state, b)
        out += more
    assert len(out) > 50


def test_utf8_stream():
    rng = random.Random(3)
    for _ in range(3000):
        data = bytes(rng.choices([0x41, 0x80, 0xBF, 0xC2, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0], k=rng.randrange(9)))
        stream = bpe.Utf8Stream()
        assert "".join(stream.feed(bytes([b])) for b in data) + stream.end() == data.decode("utf-8", "replace")


def test_tables(spark, transducer):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encoded(df).collect()}
    assert got == {i: transducer.encode(t) for i, t in enumerate(TEXTS)} and got[0] == got[1] == []
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df).collect()} == {i: len(x) for i, x in got.items()}
    assert {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.encoded(df.limit(0)).count() == 0
