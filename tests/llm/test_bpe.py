"""BPE against the tokenizers library: ids, decoded texts, edge rows."""

import hashlib
import random
import unicodedata
import weakref

import numpy as np
import pytest
import regex
from tokenizers import Tokenizer

from pointweave.llm import bpe
from pointweave.llm.common import only_here

PATH = bpe.default_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rng = random.Random(4)
    code = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x300, 0x600), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F6FF)]))
    pool = [code() for _ in range(300)] + list("etaoinshrdlu'  \n") * 30 + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "\x1c", "\x85"] * 4
    made = ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(1500)]
    return ["", " ", "a", "ὈΔΥΣΣΕΎΣ ΣΑΣ", "<|endoftext|>" * 3, "x" * 5000, "ab" * 3000 + " end", *made]


def test_ids_and_decoding_match_the_library(library):
    mine = bpe.load(PATH)
    for text in texts():
        ids = np.frombuffer(mine.encode(text), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert b"".join(mine.decode(ids)).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_every_code_point(library):
    mine = bpe.load(PATH)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000))]
    every += [d for c in every if (d := unicodedata.normalize("NFD", c)) != c]
    lines = [" ".join(f"a{c}b {c} !{c}" for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    for line, e in zip(lines, library.encode_batch(lines, add_special_tokens=False)):
        assert np.frombuffer(mine.encode(line), "<u4").tolist() == e.ids, line


def test_vocabulary_entries_in_a_row(library):
    mine, rng = bpe.load(PATH), random.Random(9)
    names = [t.replace("</w>", "") for t in library.get_vocab()]
    for _ in range(3000):
        text = "".join(rng.choices(names, k=rng.randint(1, 5)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_worker_that_turns_to_another_operator_frees_the_encoder():
    bpe.load(PATH).encode("some words")
    held = weakref.ref(bpe.load(PATH))
    only_here()
    assert held() is None


def test_only_words_with_late_letters_meet_the_slow_sets(monkeypatch, library):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.seen = pattern, []

        def findall(self, word):
            self.seen.append(word)
            return self.pattern.findall(word)

    mine = bpe.WordBpe(PATH)
    late = sorted(mine.late & set(regex.findall(r"[\p{L}\p{N}]", "".join(mine.late))))
    mine.late_pattern = Counted(mine.late_pattern)
    text = "größe, ça l'été «où» ὀδυσσεύς 東京 ٣٤ 'ſ naïve" + "".join(f" é{c}é" for c in late[:5])
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert mine.late_pattern.seen == [f"é{c}é" for c in late[:5]]


def test_decoding_in_steps(monkeypatch, library):
    monkeypatch.setattr(bpe, "DECODE_STEP", 3)
    ids = library.encode("some words, and some more of them", add_special_tokens=False).ids
    assert b"".join(bpe.load(PATH).decode(np.array(ids))).decode() == library.decode(ids, skip_special_tokens=False)


def test_query_columns(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([None, "", "Hello, World", "Hello, World", "naïve <|endoftext|>"])] + [(None, "no id", "clash")]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids string"), with_ids=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert by[d].ids == ids and by[d].n_tokens == len(ids)
        assert by[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[d].decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(none).collect() == []
