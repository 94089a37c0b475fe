"""SimHash: fingerprints and components against brute force."""

import random

import pytest
import xxhash

from pointweave.llm import simhash

SCHEMA = "doc_id long, text string, fp string"


def plain(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(rows):
    fps = [plain(t) for _, t in rows]
    name = list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                name[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgéß", k=rng.randint(2, 9)))
    texts = [None, "", " \t\n", "one", "One", "two words", "a b c d", "A  b\nc\td", "İ ſ K"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(5, 400))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(30000))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return [*rows, rows[20], rows[20], (None, texts[25]), (None, "nobody else says this at all")]


def test_fingerprints():
    texts = [t for _, t in corpus()]
    assert simhash.fingerprints(texts).tolist() == [plain(t) for t in texts]


def test_masks_cover_every_pair_within_the_radius():
    m = simhash.masks()
    assert len(m) == 31
    rng = random.Random(1)
    for _ in range(20000):
        d = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(d & x == 0 for x in m)


@pytest.mark.parametrize(("small", "tile"), [(16, 8192), (2, 5), (3, 8192)])
def test_components(spark, monkeypatch, small, tile):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(plain_components(rows), key=str)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).collect() == []


def test_long_chain(spark):
    fps = [(1 << 20) - 1 ^ ((1 << k) - 1) for k in range(0, 21, 2)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    assert set(roots.values()) == {min(fps)} and set(roots) == set(fps) - {min(fps)}


@pytest.mark.parametrize("few", [0, 1000])
def test_components_in_memory_are_those_of_star_steps(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW_LINKS", few)
    rng = random.Random(8)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(150)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(90)]
    name = {i: i for i in ids}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        name[b] = a
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((i, find(i)) for i in ids if find(i) != i)
    none = spark.createDataFrame([(1, 1)], "a long, b long")
    assert simhash.components(none).collect() == []
