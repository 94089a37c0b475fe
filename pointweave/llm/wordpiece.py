"""Token counts with a linear longest-match automaton.

The pieces of a vocabulary form one trie with two roots: words start at the
first, and at the second after every piece. A node's failure link says where
the walk goes on when no child fits, and its *popped count* how many pieces
are complete by then. A word's count is a sum of popped counts along its walk:
each character is looked at once, and no piece is ever built.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import text_slices

#: Words of the text: runs of word characters, and runs of other visible ones.
WORDS = re.compile(r"\w+|[^\w\s]+")
#: Bytes of the longest word that is split, for comparison with the library: any.
LONGEST = (1 << 62) - 1
#: Runs whose counts a worker keeps at most.
KEPT = 600_000


class LongestMatch:
    """Counts greedy longest-match pieces of words over some symbols.

    ``first``: pieces that may start a word; ``later``: those that may follow.
    """

    def __init__(self, first: Iterable[str], later: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        final.append(False)
                    at = self.child[at][c]
                if piece:
                    final[at] = True
        self.link: list[int] = [-1] * len(self.child)
        self.popped: list[int] = [0] * len(self.child)
        todo = deque([0, 1])
        while todo:  # by depth, so a parent's link is known
            u = todo.popleft()
            for c, v in self.child[u].items():
                todo.append(v)
                if final[v]:  # the whole string up to here is one piece
                    self.link[v], self.popped[v] = 1, 1
                    continue
                at, n = self.link[u], self.popped[u]
                while at >= 0 and c not in self.child[at]:
                    n += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[v], self.popped[v] = self.child[at][c], n

    def count(self, word: str) -> int:
        """Pieces of ``word``; 1 (unknown) where no split exists; 0 if empty."""
        child, link, popped = self.child, self.link, self.popped
        at = n = 0
        for c in word:
            while (nxt := child[at].get(c)) is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return 1
            at = nxt
        while at > 1:
            n += popped[at]
            at = link[at]
            if at < 0:
                return 1
        return n


def byte_pieces(path: str) -> tuple[set[str], set[str]]:
    """Pieces over bytes (as latin-1) of a byte-level vocabulary: entries that
    begin with the blank's mark start words, the others follow; single bytes do both."""
    byte_of = {c: chr(b) for b, c in enumerate(byte_alphabet())}
    blank = byte_alphabet()[32]
    first = {chr(b) for b in range(256)}
    later = set(first)
    for name in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        if all(c in byte_of for c in name):
            (first if name[0] == blank else later).add("".join(byte_of[c] for c in name.removeprefix(blank)))
    return first - {""}, later - {""}


class Counts(dict):
    """Pieces plus words << 32 of runs without blanks; keeps up to ``KEPT``."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, run: str) -> int:
        words = WORDS.findall(run)
        made = sum(self.automaton.count(w.encode("utf-8", "surrogatepass").decode("latin-1")) for w in words) + (len(words) << 32)
        if len(run) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[run] = made
        return made


@lru_cache(maxsize=2)
def load(path: str) -> Counts:
    return Counts(LongestMatch(*byte_pieces(path)))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_words), one row a row of ``docs``, over whole texts.

    A null or blank text has 0 of both. Repeated rows stay; an empty table
    gives an empty one; other columns are not read.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load(path).__getitem__
        for batch in batches:
            for part in text_slices(batch, "text"):
                n = np.array([sum(map(counts, t.split(" "))) if t else 0 for t in part.column("text").to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n & 0xFFFFFFFF), pa.array(n >> 32)], ["doc_id", "n_tokens", "n_words"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, n_words long")
