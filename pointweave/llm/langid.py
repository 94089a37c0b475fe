"""Language identification with bit-sliced Bloom filters of n-grams.

One table of cells holds a Bloom filter for every language at once:
a cell's bits are the languages that have set it. The AND of the ``HASHES``
cells of an n-gram is the set of all languages that contain it. A document's
n-grams are counted per language bit; what the filter's false positives add is
taken off again, and the language with the largest corrected share decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, freed, splitmix64, text_slices

#: Documented bound of the fit: labelled rows (expected number; picked by a hash of
#: the id over all labelled rows). Every n-gram of theirs that counts is kept.
SAMPLE_ROWS = 20_000
#: Cells for each n-gram of the language that has most (rounded up to a power of
#: two, of at least ``LEAST_BITS`` bits), and hashes of an n-gram.
CELLS, LEAST_BITS, HASHES = 6, 12, 3
#: Bytes of text that one step handles; n-grams take some forty times as much.
STEP_BYTES = 1 << 20
#: A language contains an n-gram that it shows at least this often, and at
#: least this part as often as the language that shows it most.
LEAST_COUNT, LEAST_PART = 3, 0.25
UNDETERMINED = "und"
FOLD = 2


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all letter 3-grams of the lower-cased texts, and each one's text.

    Other characters count as blanks; the middle character is a letter, so a
    text has one n-gram for each letter.
    """
    lower = [" " + t.lower() + " " if t else "  " for t in texts]
    c = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, 32).astype(np.uint64)
    mid = np.flatnonzero(letter)
    key = c[mid - 1] << np.uint64(42) | c[mid] << np.uint64(21) | c[mid + 1] if mid.size else np.empty(0, np.uint64)
    ends = np.cumsum([len(t) for t in lower])
    return key, np.searchsorted(ends, mid, side="right")


def _cells(key: np.ndarray, size: int) -> list[np.ndarray]:
    """``HASHES`` cells of each key; ``size``, their number, is a power of two."""
    h = splitmix64(key)
    step, low = h >> np.uint64(32) | np.uint64(1), np.uint64(size - 1)
    with np.errstate(over="ignore"):
        return [(h + np.uint64(i) * step & low).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Model:
    """``table``: cells x words of 64 language bits; ``wrong``: false positives by language."""

    langs: list[str]
    table: np.ndarray
    wrong: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A learned language for every text with a letter, else ``und``, and
        the corrected share of its n-grams, 0 to 1. Ties: the lesser name."""
        key, text = grams(texts)
        n = np.bincount(text, minlength=len(texts))
        if not self.langs or not key.size:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cells = _cells(key, len(self.table))
        share = np.empty((len(texts), len(self.langs)))
        starts = np.concatenate([[0], np.cumsum(n)])[:-1]
        some = np.flatnonzero(n)
        for w in range(self.table.shape[1]):
            column = np.ascontiguousarray(self.table[:, w])
            mask = column[cells[0]]
            for i in cells[1:]:
                mask &= column[i]
            for bit in range(min(64, len(self.langs) - 64 * w)):
                hit = (mask >> np.uint64(bit) & np.uint64(1)).astype(np.uint8)
                share[some, 64 * w + bit] = np.add.reduceat(hit, starts[some], dtype=np.int64)
        wrong = self.wrong[None, :]
        share[some] = np.clip((share[some] / n[some, None] - wrong) / (1 - wrong), 0, 1)
        share[n == 0] = 0
        best = np.argmax(share, axis=1)
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(best.tolist(), n.tolist())], share[np.arange(len(texts)), best]


def build(rows: list[tuple[int, list[str]]], langs: list[str]) -> Model:
    """The filters of ``rows``: (n-gram key, languages that contain it)."""
    at = {name: i for i, name in enumerate(langs)}
    most = max(Counter(x for _, has in rows for x in has).values(), default=0)
    bits = max(LEAST_BITS, (CELLS * most - 1).bit_length())
    table = np.zeros((1 << bits, max(1, -(-len(langs) // 64))), dtype=np.uint64)
    if rows:
        cells = _cells(np.array([k for k, _ in rows], dtype=np.int64).view(np.uint64), len(table))
        for w in range(table.shape[1]):
            masks = np.array([sum(1 << (at[x] % 64) for x in has if at[x] // 64 == w) for _, has in rows], dtype=np.uint64)
            for i in cells:
                np.bitwise_or.at(table[:, w], i, masks)
    full = np.array([(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(langs))])
    return Model(langs, table, np.minimum(full**HASHES, 0.99))


def fit(docs: DataFrame) -> Model:
    """Filters learned from text and non-null lang of rows outside the held-out
    fold. At most about ``SAMPLE_ROWS`` rows are read, with their whole texts;
    what reaches the driver are the n-grams of these that count."""
    known = docs.where("lang is not null and text is not null").where(fold(F.col("doc_id")) != FOLD)
    total = known.count()
    if not total:
        return build([], [])
    part = min(1.0, SAMPLE_ROWS / total)
    sample = known.where(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            for piece in text_slices(batch, "text", STEP_BYTES):
                names, which = np.unique(np.array(piece.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                key, text = grams(piece.column("text").to_pylist())
                for i, name in enumerate(names):
                    k, n = np.unique(key[which[text] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * k.size, pa.string()), pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "key", "n"])

    counted = sample.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, key long, n long")
    counted = checkpointed(counted.groupBy("lang", "key").agg(F.sum("n").alias("n")))
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r[0] for r in sizes.select("lang").collect())
    often = counted.join(F.broadcast(sizes), "lang").withColumn("rate", F.col("n") / F.col("total"))
    by_key = often.groupBy("key").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate", "n")).alias("xs"))
    has = by_key.select("key", F.explode(F.filter("xs", lambda x: (x["n"] >= LEAST_COUNT) & (x["rate"] >= LEAST_PART * F.col("top")))).alias("x")).select("key", "x.*")
    kept = has.groupBy("key").agg(F.collect_list("lang").alias("langs")).toArrow()
    return build(list(zip(kept.column("key").to_pylist(), kept.column("langs").to_pylist())), langs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row a row of ``docs``; only the
    text decides. A null id is not held out. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.wrong))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in freed(batches):
            for piece in text_slices(batch, "text", STEP_BYTES):
                names, score = m.predict(piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold(F.col("doc_id")) == FOLD, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` and predict all of them; an empty table gives an empty one."""
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs`` with a language whose corrected share is at least
    ``least_score``; columns as they were. The text decides row by row, so rows
    that share an id are judged apart."""
    model = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.wrong))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in freed(batches):
            for piece in text_slices(batch, "text", STEP_BYTES):
                names, score = m.predict(piece.column("text").to_pylist())
                yield piece.filter(pa.array((np.array(names) != UNDETERMINED) & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)
