"""LM scoring against a plain implementation with dictionaries."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from pointweave.llm import common, lm_scoring

SCHEMA = "doc_id long, text string, score string"


def corpus():
    rng = random.Random(6)
    a, b = ["red", "Green", "blue,", "ïndigo"], ["one", "two", "three", "four", "five"]
    rows = [(i, " ".join(rng.choices(a if i % 3 == 0 else b, k=rng.randint(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t"), (103, "unseen words here"), (4, rows[4][1]), (None, "one two"), (104, "red " * 4000)]
    return [*rows, (105, "rare pair here"), (108, "here pair rare rare")]


def plain(rows, good):
    """Every word and every bigram counts."""
    split = [(d, (t or "").lower().split()) for d, t in rows]
    vocabulary = {w for _, ws in split for w in ws}
    models = []
    for part in ([ws for d, ws in split if d in good], [ws for _, ws in split]):
        pairs = Counter(p for ws in part for p in zip(["<s>", *ws], ws))
        context, uni = Counter(), Counter()
        for (h, w), n in pairs.items():
            context[h] += n
            uni[w] += n
        p1 = {w: (uni[w] + 1) / (sum(uni.values()) + len(vocabulary) + 1) for w in vocabulary}
        models.append({(h, w): -math.log((pairs[h, w] + lm_scoring.PRIOR * p1[w]) / (context[h] + lm_scoring.PRIOR)) for _, ws in split for h, w in zip(["<s>", *ws], ws)})
    return [(d, len(ws), *(sum(m[p] for p in zip(["<s>", *ws], ws)) / len(ws) if ws else None for m in models)) for d, ws in split]


def compare(got, rows, good):
    key = lambda r: (str(r[0]), r[1])
    got = sorted(map(tuple, got), key=key)
    assert len(got) == len(rows)
    for g, w in zip(got, sorted(plain(rows, good), key=key)):
        assert g[:2] == w[:2] and g[2:4] == (pytest.approx(w[2:], rel=1e-9) if g[1] else (None, None))
        assert g[4] == (pytest.approx(g[2] - g[3]) if g[1] else None)


@pytest.mark.parametrize(("block", "piece", "told", "bits"), [(8 << 20, 16 << 20, 1000, 26), (200, 3000, 1000, 26), (200, 3000, 0, 6), (8 << 20, 1 << 20, 0, 26)])
def test_no_word_or_bigram_is_left_out(spark, monkeypatch, block, piece, told, bits):
    monkeypatch.setattr(lm_scoring, "TOLD", told)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", piece)
    monkeypatch.setattr(lm_scoring, "SIEVE_BITS", bits)
    rows = corpus()
    good = {d for d, _ in rows if d is not None and d % 3 == 0}
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    ids = spark.createDataFrame([(d,) for d in [*good, *good, 999, -7, None]], "doc_id long")
    compare(lm_scoring.cross_entropy_difference(df, ids).collect(), rows, good)


def test_many_words_of_one_count(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i * 100, i * 100 + 100))) for i in range(301)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = set(range(0, 301, 7))
    compare(lm_scoring.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in good], "doc_id long")).collect(), rows, good)


def test_target_like_documents_score_lower(spark):
    df = spark.createDataFrame([(d, t, "clash") for d, t in corpus()], SCHEMA)
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 3)] * 2, "doc_id long")
    by = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(df, ids).collect()}
    assert max(by[i] for i in range(0, 60, 3)) < min(by[i] for i in range(60) if i % 3)


def test_packed_integers():
    for x in (np.empty(0, np.uint64), np.array([0, 1, 1 << 63], np.uint64), np.arange(70_000, dtype=np.uint32), np.array([-5, 7], np.int64)):
        assert common.unpack(common.pack(x), x.dtype).tolist() == x.tolist()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lm_scoring.cross_entropy_difference(none, none).collect() == []
    some = spark.createDataFrame([(1, None, ""), (None, "", "")], SCHEMA)
    assert sorted(map(tuple, lm_scoring.cross_entropy_difference(some, none).collect()), key=str) == [(1, 0, None, None, None), (None, 0, None, None, None)]
