import random

import pytest
from tidelog.llm.tokens import VOCABULARY, PairMergeEncoder, encode_documents


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def own():
    with open(VOCABULARY, "rb") as f:
        e = PairMergeEncoder(f.read())
    return lambda text: [int(i) for part in e.encode(text) for i in part]


def test_equal_to_the_library(known, own):
    rng = random.Random(2)
    letters = list("aabehrstin  \n\t'-=.<|>0123") + ["é", "中", "　", " ", "​", "\x1c", "\x1f", "\x85", " ", "😀", "й", "﻿", "́"]
    pieces = "the quick Brown <|endoftext|> aaaaaaaaa ======= can't I'll antidisestablishmentarianism 12345678 \n\n \r\n".split(" ")
    for i in range(3_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) if i % 2 else " ".join(rng.choice(pieces) for _ in range(6))
        assert own(text) == known(text), repr(text)


@pytest.mark.parametrize("piece", ["a", "=", " ", "ab", "\n", "0", "é", "qz", "'", "中"])
def test_long_runs(known, own, piece):
    assert own(piece * 5_000) == known(piece * 5_000)


def test_table(spark, known):
    texts = ["", None, "Hello  world\n\n x", "<|endoftext|>", "Hello  world\n\n x", "word " * 50_000]
    df = spark.createDataFrame([(i % 5, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = sorted((r["doc_id"], r["ids"]) for r in encode_documents(df).collect())
    assert got == sorted((i % 5, known(t) if t else []) for i, t in enumerate(texts))
    assert encode_documents(df.limit(0)).count() == 0
