"""Near copies: five-word shingles, similarity 0.8, against all pairs."""

import random
import time

import numpy as np
import pytest

from pointweave.llm import common, simhash

SCHEMA = "doc_id long, text string, _id string"


def words_of(text):
    return (text or "").encode().lower().split()


def shingles(text, n=5):
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgéß", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [None, "", " \t\n", "one", "One", "two words", "a b c d", "A  b\nc\td", "b c d a"]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.randint(30, 400))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts.append(" ".join(rng.choices(vocabulary, k=30000)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts))
    return [*rows, rows[20], rows[20], (None, texts[25]), (None, "nobody else says this at all")]


def plain(rows, least=0.8):
    """The least id of each row's component, and all pairs of alike rows."""
    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    alike = []
    for i in range(len(rows)):
        for j in range(i):
            if words_of(rows[i][1]) == words_of(rows[j][1]) or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])):
                name[find(i)] = find(j)
                alike.append((i, j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(rows))], alike


def test_components_are_those_of_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    want, alike = plain(rows)
    got = simhash.near_copies(docs).select("doc_id", "component_id").collect()
    assert sorted(map(str, ((r[0], r[1]) for r in got))) == sorted(map(str, zip((d for d, _ in rows), want)))
    assert len(alike) > 100


@pytest.mark.parametrize(("small", "tile"), [(2, 5), (3, 8192)])
def test_no_link_is_lost_in_dense_groups(spark, monkeypatch, small, tile):
    monkeypatch.setattr(simhash, "FEW", small)
    monkeypatch.setattr(simhash, "TILE", tile)
    rows = [(d, t) for d, t in corpus(9) if d is not None]
    rows = list(dict(rows).items())
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    of = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert [of[d] for d, _ in rows] == plain(rows)[0]


@pytest.mark.parametrize("small", [4, 16])
def test_a_large_group_of_one_base_is_linked_as_all_pairs_are(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "FEW", small)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocabulary, k=100)
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        copy = list(base)
        for at in rng.sample(range(100), 2):
            copy[at] = rng.choice(vocabulary)
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert [got[d] for d, _ in rows] == plain(rows)[0]


def test_every_kind_of_edit_is_linked(spark):
    rng = random.Random(4)
    new = lambda k: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(k)]
    rows = []
    for _ in range(20):
        for n in (20, 40, 400, 2000):
            base, most = new(n), (n - 4) // 4  # so many new shingles at the end leave 0.8
            at = n // 2
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + new(most)))]
            base = new(n)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(new(most) + base))]
            base = new(n)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: n - (n - 4) // 5]))]
            base = new(n)
            if n > 40:
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:at] + new(most - 12) + base[at:]))]
    docs = spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_the_border_of_similarity(spark):
    w = [f"w{i}" for i in range(40)]
    # 36 shingles; a copy that lacks the last n words shares 36 - n of 36
    texts = [" ".join(w), " ".join(w[:33]), " ".join(w[:32])]
    for other, linked in ((1, True), (2, False)):
        docs = spark.createDataFrame([(0, texts[0], ""), (other, texts[other], "")], SCHEMA)
        assert (len(shingles(texts[0]) & shingles(texts[other])) >= 0.8 * 36) is linked
        got = {r.component_id for r in simhash.near_copies(docs).collect()}
        assert got <= {0, other} and (linked or len(got) == 2)


def test_deduplicate_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA)
    kept = simhash.deduplicate_copies(docs)
    assert kept.columns == docs.columns and all(r._id == "clash" for r in kept.collect())
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, set(plain(rows)[0])))
    twice = spark.createDataFrame([(1, "b c", ""), (1, "a c", ""), (None, "x", ""), (None, "x", "")], SCHEMA).drop("_id")
    assert sorted(map(str, map(tuple, simhash.deduplicate_copies(twice).collect()))) == ["(1, 'a c')", "(None, 'x')"]


def test_groups_without_ids_each_keep_a_row(spark):
    rows = [(None, "x"), (None, "X"), (None, "y"), (0, "m n"), (1, "m n"), (1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, (r.text or "").lower()) for r in simhash.deduplicate_copies(docs).collect()]
    assert sorted(map(str, kept)) == ["(0, 'm n')", "(1, 'z')", "(None, 'x')", "(None, 'y')"]


def test_simhash_links_what_it_can_before_the_shingles(spark, monkeypatch):
    rows = [(d, t) for d, t in corpus(7) if d is not None]
    rows += [(1000 + d, f"{t} {t}".upper()) for d, t in rows if len(words_of(t)) > 30]
    rows += [(2000 + d, f"{t} {t} end") for d, t in rows if len(words_of(t)) > 200]
    docs = spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA)
    want, _ = plain(rows)
    prints = {d: simhash.fingerprint(t) for d, t in rows}
    linked = [(d, e) for (d, _), x in zip(rows, want) for (e, _), y in zip(rows, want) if d < e and x == y and (prints[d] ^ prints[e]).bit_count() <= simhash.RADIUS]
    every = simhash._prefixes
    monkeypatch.setattr(simhash, "_prefixes", lambda *a: every(*a).limit(0))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    exact = {d: " ".join(map(bytes.decode, words_of(t))) for d, t in rows}
    together = [(d, e) for d, e in linked if exact[d] != exact[e] and got[d] == got[e]]
    assert len(together) > 20 and len(together) >= 0.8 * sum(exact[d] != exact[e] for d, e in linked)
    whole = dict(zip((d for d, _ in rows), want))
    assert all(whole[d] == whole[c] for d, c in got.items())


def test_passages_stay_late_however_many_the_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LOOKED_AT", 10)
    rng = random.Random(6)
    new = lambda k: ["".join(rng.choices("abcdefgh", k=7)) for _ in range(k)]
    passage = new(30)
    rows = [(i, " ".join(new(100) + passage + new(100) if i % 4 == 0 else new(200)), "") for i in range(800)]
    assert simhash._prefixes(spark.createDataFrame(rows, SCHEMA), 0.8, 5).count() == 0


def test_parities_differ_in_no_more_places_than_the_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 2, 63, 64, 65, 130, 4000, 9000)]
    sets += [np.unique(np.concatenate([x[: x.size * 9 // 10], rng.integers(0, 1 << 63, x.size // 4, dtype=np.uint64)])) for x in sets]
    odd = [simhash.parities(x) for x in sets]
    assert len(odd[0]) < len(odd[5]) < len(odd[7])
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    apart = simhash._apart(odd, i, j)
    assert all(n <= np.setxor1d(sets[a], sets[b]).size for a, b, n in zip(i, j, apart.tolist()))
    assert (apart[i == j] == 0).all() and (apart[(i < 8) & (j < 8) & (i != j)] > 0).all()


def test_few_jobs_whatever_the_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    docs = spark.createDataFrame([(d, t, "") for d, t in corpus()[:80]], SCHEMA)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("near copies", "")
        assert simhash.near_copies(docs).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    # not a job for each part of a sieve, nor any for each star step
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near copies")) < 200


def test_a_settled_table_lets_earlier_shuffles_go(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    table = common.settled(spark.range(1000).repartition(40, "id"))
    assert table.count() == 1000
    start = disk.getAllFiles().size()
    for _ in range(5):
        table = common.settled(table.repartition(40, "id"))
    deadline = time.monotonic() + 20
    while disk.getAllFiles().size() > start + 2 * 3 * 40 and time.monotonic() < deadline:
        common.settled(spark.range(1))
        time.sleep(0.5)
    assert disk.getAllFiles().size() <= start + 2 * 3 * 40
    assert table.count() == 1000


def facts_of(spark, sets):
    return spark.createDataFrame([(k, int(x.size), simhash.parities(x)) for k, x in enumerate(sets)], "key long, n long, odd binary")


def test_pairs_do_not_grow_with_the_square_of_a_group(spark):
    same = np.arange(1, 101, dtype=np.uint64) << np.uint64(41)
    facts = facts_of(spark, [same] * 300)
    rows = spark.createDataFrame([(h, k, 100, 0, k) for h in (7, 8) for k in range(300)], "h long, key long, n long, pos long, comp long")
    got = simhash._big_pairs(rows, facts, 0.8).collect()
    assert {r.h for r in got} == {7, 8} and len(got) <= 2 * 300 * simhash.PARTNERS
    assert {k for r in got for k in (r.a, r.b)} == set(range(300))


def test_small_buckets_give_no_pairs_that_parities_rule_out(spark):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(30)]
    facts = facts_of(spark, [*sets, sets[3]])
    rows = spark.createDataFrame([(7, k, 100, 0, k, False) for k in range(31)], "h long, key long, n long, pos long, comp long, big boolean")
    assert [tuple(r) for r in simhash._small_pairs(rows, facts, 0.8).collect()] == [(3, 30)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_copies(none).collect() == []
    assert simhash.deduplicate_copies(none).collect() == []
