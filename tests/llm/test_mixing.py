"""Mixing: targets against a loop, word totals, repeatability, edge rows."""

from collections import defaultdict

import pytest

from pointweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int"


def wanted(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = sum(w[s] for s in order if s not in full)
        t = {s: 3.0 * sizes[s] if s in full else rest * w[s] / open_ for s in order}
        over = {s for s in order if t[s] > 3 * sizes[s] + 1e-9}
        if not over - full:
            return t
        full |= over


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), ["b", "a", "c", None, "tiny"][min(4, i % 97 % 5) if i % 50 else 4], 0) for i in range(3000)]
    rows += [(1, "same id twice", "a", 0), (1, "same id twice", "a", 0), (None, "no id", "c", 0), (5000, None, "b", 0), (5001, "", "b", 0), (5002, " \t\n", "b", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_targets_and_totals(spark, docs):
    got = mixing.copies(docs).collect()
    assert len(got) == docs.count()
    sizes, words, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        words[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    for s, t in wanted(dict(sizes)).items():
        assert target[s] == pytest.approx(t)
        assert abs(words[s] - t) <= 51


def test_reruns_and_partitionings_agree(docs):
    a = sorted(mixing.mixed_sizes(docs).collect(), key=str)
    b = sorted(mixing.mixed_sizes(docs.repartition(3, "source")).collect(), key=str)
    assert a == b


def test_mix_repeats_rows(docs):
    plan = mixing.copies(docs)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == plan.groupBy().sum("copies").first()[0]


def test_mix_beside_any_column_names(spark):
    names = ["size", "_size", "_n", "_nth", "_copy", "_made", "_rows", "rows", "copies", "_words", "_doc_id", "_source", "_text_key", "text_key", "_doc_id_found", "target", "s", "f", "whole", "p", "bucket"]
    rows = [(i % 50, f"some words {i % 25}", "ab"[i % 2], *names) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == mixing.copies(df).groupBy().sum("copies").first()[0]
    assert {tuple(r)[3:] for r in out.distinct().collect()} == {tuple(names)}


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "one text", "a", 0)] * 1000 + [(None, f"text {i}", "b", 0) for i in range(300)]
    got = mixing.copies(spark.createDataFrame(rows, SCHEMA)).collect()
    own = [r.copies for r in got if r.doc_id == 1]
    target = next(r.target for r in got if r.doc_id == 1)
    assert len(got) == 1300 and max(own) - min(own) <= 1 and abs(2 * sum(own) - target) <= 2


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mixed_sizes(none).collect() == []
    assert mixing.mix(none).collect() == []


def test_pivot_keeps_expectation():
    import numpy as np

    p, size = np.full(40, 0.3), np.arange(1.0, 41.0)
    seen = np.zeros(40)
    for k in range(400):
        out, left = mixing.pivot(p, size, np.arange(k * 40, k * 40 + 40, dtype=np.uint64))
        assert (out * size).sum() == pytest.approx((p * size).sum())
        assert sum(0 < x < 1 for x in out) <= 1
        seen += out
    assert abs(seen / 400 - 0.3).max() < 0.12
