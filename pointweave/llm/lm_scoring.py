"""LM scoring by cross-entropy difference.

Two bigram models, one of target texts and one of the background corpus, share
a vocabulary, an n-gram inventory and a smoothing, so they differ by what was
counted alone. A document's score is the mean over its words of the target
model's loss minus the background model's: the lower, the more target-like.

The models keep every word and every bigram of every text, with all their counts;
nothing is sent to all tasks but the target's ids or a sieve of them. Texts are read
once, in blocks of about ``BLOCK_BYTES``. A block asks for the counts of its
distinct words and bigrams, as 56-bit keys (of m keys, about one in 2**56 / m
shares its key with another): the key space is cut into pieces, and one task adds up what all blocks found of a piece and answers each
block in the order of its question, so that answers hold no keys. A block's words
as local numbers travel beside and meet the answers. A key is asked for once a
block, however often it occurs, so no common word crowds a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, gaps, pack, splitmix64, text_slices, unpack

#: Words' worth of the unigram model that each context is smoothed with.
PRIOR = 4.0
#: Target ids that all tasks are told of (8 bytes each). More are a sieve of that many
#: bits first (8 MB, whatever the number of ids), and a join of the texts that pass it.
TOLD, SIEVE_BITS = 2_000_000, 26
#: Text bytes of a block (a longer text is one block), and of the corpus for each
#: piece of the key space: what one task holds of either.
BLOCK_BYTES, PIECE_BYTES = 8 << 20, 16 << 20
#: Text bytes that are split into words at once.
SLICE_BYTES = 2 << 20
#: The word before a text's first.
START = 1
COLUMNS = ["piece", "block", "mark", "a", "b", "c", "d"]
ROWS = "piece long, block long, mark long, a binary, b binary, c binary, d binary"
SCORES = "doc_id long, n_words long, loss_target double, loss_background double, score double"


def split_words(texts: pa.Array) -> pa.ListArray:
    """Lower-cased words of each text; none for null. Splits at white space."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))))


def _flat(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words a text, and all words; a text without words has none."""
    lists = split_words(texts)
    words = pc.list_flatten(lists)
    blank = pc.equal(words, "")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if pc.any(blank).as_py():
        where = np.repeat(np.arange(len(n)), n)
        n = n - np.bincount(where[blank.to_numpy(zero_copy_only=False)], minlength=len(n))
        words = words.filter(pc.invert(blank))
    return n, pc.dictionary_encode(words)


def _key(h: np.ndarray, word: bool) -> np.ndarray:
    """A key of 56 bits, the lowest of which says whether it is a word's."""
    return splitmix64(h) >> np.uint64(9) << np.uint64(1) | np.uint64(word)


#: The key of START: as often as there are texts with words, and never their end.
START_KEY = _key(np.array([START], np.uint64), True)[0]


def _places(words: np.ndarray) -> np.ndarray:
    """Where the keys of words are among the keys of a block, which are sorted."""
    return np.flatnonzero(words & np.uint64(1))


@dataclass(frozen=True)
class Block:
    """Texts as ``seq``, places in ``words``, which are the sorted keys of the distinct
    words and of START; ``n``: words a text."""

    words: np.ndarray
    seq: np.ndarray
    n: np.ndarray

    def keys(self) -> tuple[np.ndarray, ...]:
        """The distinct keys, sorted; of each distinct bigram the key's place, and the
        context and the word as places in ``words``; and for each word its bigram."""
        context = np.empty(self.seq.size, np.int64)
        context[1:] = self.seq[:-1]
        context[(np.cumsum(self.n) - self.n)[self.n > 0]] = np.searchsorted(self.words, START_KEY)
        context *= self.words.size
        context += self.seq
        code, which = np.unique(context, return_inverse=True)
        before, word = np.divmod(code, self.words.size)
        bigram = _key(self.words[word] + splitmix64(self.words[before]), False)
        key, place = np.unique(np.concatenate([bigram, self.words]), return_inverse=True)
        return key, place[: bigram.size], before, word, which

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct keys; 2 x how often each occurs in target texts and in all; 2 x
        how often each of ``words`` ends a text there."""
        key, bigrams, before, word, which = self.keys()
        seen, ends = np.zeros((2, key.size), np.uint64), np.zeros((2, self.words.size), np.uint64)
        words, last = _places(key), self.seq[(np.cumsum(self.n) - 1)[self.n > 0]]
        for k, texts in enumerate((target[self.n > 0], np.ones(last.size, bool))):
            pairs = np.bincount(which[np.repeat(target, self.n)] if not k else which, minlength=word.size)
            seen[k, bigrams] += pairs.astype(np.uint64)  # two bigrams of one key are one
            seen[k, words] = np.bincount(word, weights=pairs, minlength=words.size).astype(np.uint64)
            seen[k, words[np.searchsorted(self.words, START_KEY)]] = np.count_nonzero(texts)
            ends[k] = np.bincount(last[texts], minlength=words.size).astype(np.uint64)
        return key, seen, ends

    def losses(self, seen: np.ndarray, ends: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
        """2 x texts: the mean loss of each text's words in each model, from all blocks'
        counts, and the number of all words in target and background."""
        key, bigrams, before, word, which = self.keys()
        words = _places(key)
        out, some = np.zeros((2, self.n.size)), np.flatnonzero(self.n)
        for k in (0, 1):
            unigram = (seen[k, words] + 1.0) / (total[k] + vocabulary + 1)
            loss = np.log(seen[k, words] - ends[k] + PRIOR)[before] - np.log(seen[k, bigrams] + PRIOR * unigram[word])
            if some.size:
                out[k, some] = np.add.reduceat(loss[which], (np.cumsum(self.n) - self.n)[some]) / self.n[some]
        return out


def sieve_of(ids: DataFrame) -> np.ndarray:
    """A one-hash Bloom filter of the column doc_id, as 64-bit words."""
    size = 1 << SIEVE_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _slot(size, batch.column("doc_id"))
            word, which = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(word.size, np.uint64)
            np.bitwise_or.at(bits, which, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    marked = ids.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.uint64)
    table[marked.column("word").to_numpy()] = marked.column("bits").to_numpy().view(np.uint64)
    return table


def _slot(size: int, column: pa.Array) -> np.ndarray:
    return splitmix64(pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(size - 1)


def _passes(table: np.ndarray, column: pa.Array) -> np.ndarray:
    at = _slot(table.size << 6, column)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _asked(docs: DataFrame, ids: DataFrame, pieces: int) -> DataFrame:
    """Of every block, its texts (piece: ``pieces`` and more) and a row for each piece
    with its distinct keys and their counts."""
    many = ids.count() > TOLD
    known = np.empty(0, np.int64) if many else np.sort(ids.toArrow().column(0).to_numpy().astype(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(sieve_of(ids) if many else known)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in freed(batches):
            yield batch.filter(pa.array(_passes(shared.value, batch.column("doc_id"))))

    def told(column: pa.Array) -> np.ndarray:
        x = pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = shared.value
        at = np.minimum(np.searchsorted(ids, x), max(ids.size - 1, 0))
        return (ids[at] == x if ids.size else np.zeros(x.size, bool)) & pc.is_valid(column).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            hashes, seqs, counts, doc_ids, targets = zip(*held)
            words, place = np.unique(np.concatenate([*(_key(h, True) for h in hashes), [START_KEY]]), return_inverse=True)
            place = place.astype(np.uint32)
            starts = np.cumsum([0, *(h.size for h in hashes)])
            seq = np.concatenate([place[s:][a] for a, s in zip(seqs, starts)])
            n, doc_id = np.concatenate(counts), pa.concat_arrays(doc_ids)
            block, target = Block(words, seq, n), np.concatenate(targets)
            held.clear()
            mark = xxhash.xxh64_intdigest(seq.tobytes() + words.tobytes() + n.tobytes()) >> 1
            null = doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = pc.fill_null(doc_id, 0).to_numpy().astype(np.int64)
            rows = [[pieces + number % pieces, pack(gaps(words)), pack(seq), pack(n.astype(np.uint64)), pack(np.stack([numbers, null], axis=1).ravel())]]
            key, seen, ends = block.counts(target)
            cut = np.searchsorted(_piece(key, pieces), np.arange(pieces + 1))
            ends_cut = np.searchsorted(_piece(words, pieces), np.arange(pieces + 1))
            for p, (i, j, e, f) in enumerate(zip(cut[:-1], cut[1:], ends_cut[:-1], ends_cut[1:])):
                rows.append([p, pack(gaps(key[i:j])), pack(seen[0, i:j]), pack(seen[1, i:j]), pack(ends[:, e:f].ravel())])
            piece, *blobs = zip(*rows)
            same = [pa.array([x] * len(rows), pa.int64()) for x in (number, mark)]
            return pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), *same, *(pa.array(x, pa.binary()) for x in blobs)], COLUMNS)

        for batch in freed(batches):
            if many:  # what may be a target comes with an answer, from the join
                sure = pc.is_valid(batch.column("target")).to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(sure | ~_passes(shared.value, batch.column("doc_id"))))
            for part in text_slices(batch, "text", SLICE_BYTES):
                n, words = _flat(part.column("text"))
                own = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.uint64)
                target = pc.fill_null(part.column("target"), False).to_numpy(zero_copy_only=False) if many else told(part.column("doc_id"))
                held.append((own, words.indices.to_numpy(zero_copy_only=False).astype(np.uint32), n, pa.array(part.column("doc_id").to_pylist(), pa.int64()), target))
                size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if size >= BLOCK_BYTES:
                    yield out()
                    number, size = number + 1, 0
        if held:
            yield out()

    plain = docs.withColumn("target", F.lit(None).cast("boolean"))
    if many:
        maybe = docs.mapInArrow(sift, docs.schema).join(ids.withColumn("target", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
        # a fixed order, so that a task that runs again makes the same blocks
        plain = plain.unionByName(maybe.sortWithinPartitions("doc_id", "text"))
    return plain.mapInArrow(run, ROWS)


def _piece(key: np.ndarray, pieces: int) -> np.ndarray:
    return ((key >> np.uint64(24)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)


def _answered(asked: DataFrame, pieces: int) -> DataFrame:
    """The blocks' texts as they are, as piece -1; instead of each question the counts
    of its keys in all blocks, and the piece's number of words, different and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def out() -> pa.RecordBatch:
            key = [np.cumsum(unpack(r["a"]), dtype=np.uint64) for r in held]
            ends = np.cumsum([0, *(k.size for k in key)])
            unsorted = np.concatenate(key)
            order = np.argsort(unsorted, kind="stable")
            key = unsorted[order]
            new = np.ones(key.size, dtype=bool)
            new[1:] = key[1:] != key[:-1]
            first, group = np.flatnonzero(new), np.cumsum(new) - 1
            word = first[(key[first] & np.uint64(1) == 1) & (key[first] != START_KEY)]
            totals, answers = [word.size], []
            place = np.empty_like(order)
            place[order] = group
            pairs = list(zip(ends[:-1], ends[1:]))
            for c in "bc":
                counts = np.concatenate([unpack(r[c]) for r in held])[order]
                sums = np.add.reduceat(counts, first) if first.size else counts
                totals.append(int(sums[group[word]].sum()))
                answers.append([pack(sums[place[i:j]]) for i, j in pairs])
            # the words' ends: a word's place among all keys, block by block
            inner = [np.flatnonzero(unsorted[i:j] & np.uint64(1)) + i for i, j in pairs]
            gone = [unpack(r["d"]).reshape(2, -1) for r in held]
            at = np.concatenate([place[x] for x in inner])
            lost = [np.bincount(at, weights=np.concatenate([g[k] for g in gone]), minlength=first.size).astype(np.uint64) for k in (0, 1)]
            last = [pack(np.stack([x[place[w]] for x in lost]).ravel()) for w in inner]
            facts = pack(np.array(totals, dtype=np.uint64))
            longs = [pa.array([r[c] for r in held], pa.int64()) for c in ("piece", "block", "mark")]
            blobs = [[facts] * len(held), *answers, last]
            return pa.RecordBatch.from_arrays([*longs, *(pa.array(x, pa.binary()) for x in blobs)], COLUMNS)

        for batch in freed(batches):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and row["piece"] != at:
                    yield out()
                    held = []
                at = row["piece"]
                if at < pieces:
                    held.append(row)
                else:
                    row["piece"] = -1
                    yield pa.RecordBatch.from_pylist([row], batch.schema)
        if held:
            yield out()

    return asked.repartition(pieces, "piece").sortWithinPartitions("piece", "block").mapInArrow(run, ROWS)


def _scored(answered: DataFrame, pieces: int) -> DataFrame:
    """The scores of every block's texts. A block whose rows do not belong together
    (its input came in another order when a lost task ran again) is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            texts, *answers = held
            if [r["piece"] for r in held] != list(range(-1, pieces)) or len({r["mark"] for r in held}) > 1:
                raise RuntimeError("the documents changed between two runs of one task; write them first")
            facts = np.sum([unpack(r["a"]) for r in answers], axis=0)
            seen = np.stack([np.concatenate([unpack(r[c]) for r in answers]) for c in "bc"]).astype(float)
            ends = np.concatenate([unpack(r["d"]).reshape(2, -1) for r in answers], axis=1).astype(float)
            n = unpack(texts["c"]).astype(np.int64)
            block = Block(np.cumsum(unpack(texts["a"]), dtype=np.uint64), unpack(texts["b"], np.uint32), n)
            doc_id, null = unpack(texts["d"], np.int64).reshape(-1, 2).T
            t, b = block.losses(seen, ends, facts[1:].astype(float), int(facts[0]))
            none = n == 0
            losses = [pa.array(x, mask=none) for x in (t, b, t - b)]
            return pa.RecordBatch.from_arrays([pa.array(doc_id, mask=null.astype(bool)), pa.array(n), *losses], ["doc_id", "n_words", "loss_target", "loss_background", "score"])

        for batch in freed(batches):
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if held and row["block"] != held[0]["block"]:
                    yield out()
                    held = []
                held.append(row)
        if held:
            yield out()

    return answered.repartition(pieces, "block").sortWithinPartitions("block", "piece").mapInArrow(run, SCORES)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """(doc_id, n_words, loss_target, loss_background, score), one row a row of
    ``docs`` (doc_id, text); the target corpus is the rows whose id is in
    ``target_ids`` (doc_id), the background all rows.

    A null, empty or blank text has no words and null losses; repeated rows are
    counted and scored each time, ids that repeat in ``target_ids`` count once, a
    null id is no target; without target rows the target model is its prior. Other
    columns are not read. An empty table gives an empty one. A text is never split:
    one of many megabytes is a block of its own.
    """
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    size = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, -(-size // PIECE_BYTES))
    return _scored(_answered(_asked(picked, ids, pieces), pieces), pieces)
