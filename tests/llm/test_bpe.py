import random

import pyarrow as pa
import pytest
from pulsegrid.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")

ALPHABET = " \n\t\r'stmdrevlaA1,.!é世ा́   　😀٣½\x1c\x85_<|>endoftext"


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})


def texts():
    rng = random.Random(4)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [
        "", " ", "\n\n", "don't 'tis I'LL we'll 're ''s", "<|endoftext|>", "a" * 3000, "ab" * 2000 + " " * 500, "x  \n y", "１２３ ① Ⅻ", "a​b", "end ",
    ]


def test_batch(reference):
    all_texts = texts()
    ids, n = bpe.encode_batch(pa.array(all_texts), bpe.WordEncoder(bpe.load_ranks(bpe.default_path()), cache=50))
    at = 0
    for t, k in zip(all_texts, n):
        assert ids[at : at + k].tolist() == reference.encode_ordinary(t)
        assert bpe.decode(ids[at : at + k].tolist()) == t
        at += k


def test_queue(reference):
    encoder = bpe.WordEncoder(bpe.load_ranks(bpe.default_path()))
    rng = random.Random(1)
    for _ in range(500):
        word = bytes(rng.choice(b"abcethin s\xc3\xa9") for _ in range(rng.randint(1, 60)))
        assert encoder.encode(word) == reference._core_bpe.encode_single_piece(word)


def test_table(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHARS", 50)
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "hello " * 5000, "x"), (1, "hello world", "x"), (None, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.encode(df).collect()), key=repr)
    assert got == sorted(((i, [] if not t else bpe_ids(t)) for i, t, _ in rows), key=repr)
    assert {(r.doc_id, r.tokens) for r in bpe.count_tokens(df, ["doc_id"]).collect()} == {(i, len(x)) for i, x in got}
    back = bpe.decode_ids(bpe.encode(df)).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)
    assert bpe.encode(df.where("false")).count() == 0


def bpe_ids(text):
    ids, _ = bpe.encode_batch(pa.array([text]), bpe.WordEncoder(bpe.load_ranks(bpe.default_path())))
    return ids.tolist()
