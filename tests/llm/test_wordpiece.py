"""Token counts against the tokenizers library's greedy word pieces."""

import random

import pytest
from tokenizers import models

from pointweave.llm import wordpiece as w


def library(first, later):
    vocab = {p: i for i, p in enumerate(["[UNK]", *sorted(first), *("##" + p for p in sorted(later))])}
    return models.WordPiece(vocab=vocab, unk_token="[UNK]", max_input_chars_per_word=w.LONGEST)


@pytest.mark.parametrize("seed", range(4))
def test_small_vocabularies(seed):
    rng = random.Random(seed)
    piece = lambda: "".join(rng.choices("abc", k=rng.randint(1, 5)))
    first, later = ({piece() for _ in range(12)} for _ in range(2))
    mine, theirs = w.LongestMatch(first, later), library(first, later)
    for _ in range(3000):
        word = "".join(rng.choices("abcd" if seed % 2 else "abc", k=rng.randint(1, 14)))
        assert mine.count(word) == len(theirs.tokenize(word)), (word, first, later)


def test_public_vocabulary_and_query(spark):
    path = w.default_path()
    first, later = w.byte_pieces(path)
    theirs = library(first, later)
    rng = random.Random(1)
    texts = [None, "", " \n", "Hello, world!!", "naïve café — 日本語", "x" * 300, "a " * 5000, "wörd's end\x1c.", *("".join(rng.choices("etaoin ,.é\n日'", k=80)) for _ in range(200))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (None, "z", "clash")], "doc_id long, text string, n_words string")
    got = w.count_tokens(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            words = w.WORDS.findall(texts[r.doc_id] or "")
            assert r.n_words == len(words)
            assert r.n_tokens == sum(len(theirs.tokenize(x.encode().decode("latin-1"))) for x in words)
    assert w.count_tokens(df.limit(0)).collect() == []


def test_long_words_are_split(spark):
    path = w.default_path()
    first, later = w.byte_pieces(path)
    vocab = {p: i for i, p in enumerate(["[UNK]", *sorted(first), *("##" + p for p in sorted(later))])}
    theirs = models.WordPiece(vocab=vocab, unk_token="[UNK]", max_input_chars_per_word=10**9)
    texts = ["x" * 101, "日本語" * 40, "0123456789abcdef" * 500, "ab" * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_words) for r in w.count_tokens(df).collect()}
    for i, text in enumerate(texts[:3]):
        assert got[i] == (len(theirs.tokenize(text.encode().decode("latin-1"))), 1)
    assert got[3][1] == 1 and got[3][0] > 100_000
