"""Nearest neighbours: recall against brute force, scores, edge rows."""

import numpy as np
import pytest

from pointweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, asked, k=10):
    out = {}
    for q, v in rows:
        if q in asked:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def run(spark, rows, k=10, by=10, kind="float"):
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA.replace("float", kind))
    got = {}
    for r in ann.search(df, lambda i: i % by == 0, k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    return {q: [(s, i) for _, s, i in sorted(xs)] for q, xs in got.items()}


@pytest.mark.parametrize(("tile", "told"), [(8192, 100_000), (50, 100_000), (50, 0)])
def test_recall_and_order(spark, monkeypatch, tile, told):
    monkeypatch.setattr(ann, "TILE", tile)
    monkeypatch.setattr(ann, "TOLD", told)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[700:900] = x[7]  # one vector is very common
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows, set(range(0, 1500, 10)))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, near in got.items():
        assert near == sorted(near)
        for s, i in near:
            assert s == pytest.approx(float(np.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum())), abs=1e-12)


def test_rows_that_take_no_part_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (10, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, []), (20, [1.0, 2.0, 3.0]), (1, [0.0, 1.0])]
    got = run(spark, rows)
    root = 2**0.5
    assert got == {0: [(0.0, 10), (pytest.approx(root), 1), (pytest.approx(root), 1)], 10: [(0.0, 0), (pytest.approx(root), 1), (pytest.approx(root), 1)]}


def test_few_rows_are_visited_where_neighbours_are_close(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 24)) * 4
    x = (centres[rng.integers(0, 60, 3000)] + 0.1 * rng.standard_normal((3000, 24))).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    made = []
    monkeypatch.setattr(ann, "fit", lambda *a, fit=ann.fit: made.append(fit(*a)) or made[-1])
    got, want = run(spark, rows), brute(rows, set(range(0, 3000, 10)))
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    choice = made[0][24]
    key, visit = choice.keys(x), choice.visits(x[::10])
    met = np.zeros((300, 3000), dtype=bool)
    for t in range(ann.TABLES):
        for p in range(visit.shape[2]):
            met |= visit[:, t, p, None] == key[None, :, t]
    assert met.mean() < 0.1


def test_ties_and_doubles(spark):
    rows = [(i, [float(i % 5) + 0.1, float(i // 5 % 5), 1e-3]) for i in range(300)]  # a grid, each place 12 times
    got, want = run(spark, rows, kind="double"), brute(rows, set(range(0, 300, 10)))
    assert {q: [i for _, i in xs] for q, xs in got.items()} == {q: [i for _, i in xs] for q, xs in want.items()}


def test_extreme_numbers(spark):
    rows = [(i, [float(f"1e{i * 10}"), 1.0]) for i in range(0, 31)] + [(50, [3.0, 1e-300])]
    got = run(spark, rows, kind="double")
    assert all(len(xs) == 10 for xs in got.values()) and got[50][0] == (pytest.approx(5**0.5), 0)


def test_perturbations_are_distinct_and_cheap_first():
    sets = ann.perturbations(3, 1000)
    assert len(sets) == 27 == len({tuple(s) for s in sets.tolist()}) and not sets[0].any()
    c = ann.Choice(5, 1.0, 3)
    q = np.random.default_rng(1).standard_normal((4, 5))
    assert (c.visits(q)[:, :, 0] == c.keys(q)).all()


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0])]) == {}
