"""The pipeline: every stage's decisions on a small corpus, and the whole run."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pointweave.llm import bpe, langid, mixing

from .test_langid import plain_grams
from .test_mixing import wanted
from .test_near_copies import plain as plain_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    parts = {"aa": ["thing", "er", "the", "and", "oun"], "bb": ["schön", "lich", "und", "keit"]}
    rows = []
    for i in range(120):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(80)), lang, f"s{i % 3}", 0))
    rows += [(200 + i, rows[i][1], rows[i][2], "s0", 0) for i in range(40)]
    rows += [(300, "12 34", "aa", "s1", 0), (301, None, None, None, None), (302, "", "aa", "s1", 0)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_stages(spark, docs):
    (n0, identify), (n1, dedup), (n2, mix), (n3, encode) = corpus_pipeline.STAGES
    a = identify(spark, docs, "").cache()
    assert a.columns == docs.columns and a.count() == 160
    b = dedup(spark, a, "").cache()
    assert b.columns == docs.columns and sorted(r.doc_id for r in b.collect()) == list(range(120))
    c = mix(spark, b, "").cache()
    assert c.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.copies(b).collect()}
    got: dict = {}
    for r in c.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    d = encode(spark, c, "").collect()
    assert len(d) == sum(got.values()) and all(len(r.ids) == r.n_tokens > 0 for r in d)


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} <= set(range(120))
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def plain_languages(rows):
    """Rows whose best share of known letter 3-grams reaches the pipeline's least."""
    counts = {}
    for d, text, lang in rows:
        if lang and text is not None and zlib.crc32(str(d).encode()) % 4 != langid.FOLD:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    known = {x: {g for g, n in c.items() if n >= langid.LEAST_COUNT and rate[x][g] >= langid.LEAST_PART * top[g]} for x, c in counts.items()}
    shares = {d: max((sum(g in k for g in gs) / len(gs) for k in known.values()), default=0) if (gs := plain_grams(text)) else 0 for d, text, _ in rows}
    assert all(abs(s - corpus_pipeline.LEAST_SHARE) > 0.05 for s in shares.values())  # none near the border
    return [r for r in rows if shares[r[0]] >= corpus_pipeline.LEAST_SHARE]


def test_run_against_plain_versions(spark, docs, tmp_path):
    """Exact and near copies, foreign and empty texts; every stage once more by hand."""
    rng = random.Random(8)
    rows = [tuple(r)[:4] for r in docs.collect()]
    for i in range(0, 60, 2):
        words = rows[i][1].split()
        at = rng.randrange(len(words))
        kind = i // 2 % 4
        copy = [words[:at] + ["unddie"] + words[at:], words[:at] + words[at + 1 :], words + ["more", "words"], words[:at] + ["other"] + words[at + 1 :]][kind]
        rows.append((400 + i, " ".join(copy).upper() if kind == 1 else " ".join(copy), rows[i][2], "s1"))
    rows += [(500 + i, "".join(rng.choice("αβγδεζηθ ") for _ in range(200)), None, "s2") for i in range(10)]
    spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = plain_languages([r[:3] for r in rows])
    ids, text = [r[0] for r in kept], {r[0]: r[1] for r in rows}
    component = plain_components([(d, text[d]) for d in ids])[0]
    stay = sorted(set(component))
    assert 100 < len(stay) < len(ids) < len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for d in stay:
        sizes[source[d]] += len(text[d].split())
    target = wanted(dict(sizes))
    got = Counter(r.doc_id for r in out)
    assert set(got) <= set(stay) and max(got.values()) <= mixing.MAX_COPIES
    words = defaultdict(int)
    for d, n in got.items():
        words[source[d]] += n * len(text[d].split())
        share = target[source[d]] / sizes[source[d]]
        assert int(share) <= n <= int(share) + 1
    for s, t in target.items():
        assert abs(words[s] - t) <= max(len(text[d].split()) for d in stay)
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    for r in out:
        assert list(r.ids) == library.encode(text[r.doc_id], add_special_tokens=False).ids
