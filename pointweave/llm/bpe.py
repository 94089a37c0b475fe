"""BPE with exact merges in time linear in the word, and its decoder.

A vocabulary's entries are strings of *symbols*: the characters of the byte
alphabet, the last one of a word joined with the word-end mark. A trie automaton
(Aho-Corasick over the symbols) gives, for every position of a word, the longest
entry that starts there. The encoder takes that entry if it is compatible with
the entry before it, else the next shorter prefix, else it backs up one entry
and marks the position as a dead end, so that each position is left at most
once. Two entries are compatible if merging their concatenation by rank would
not merge across their border; the answer for a pair is kept in a table.
Decoding copies the entries' bytes through an offset table.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LET_GO, freed, text_slices

#: Words whose pieces (twice as many), and pairs whose compatibility, a worker keeps at most.
KEPT_WORDS, KEPT_PAIRS = 250_000, 1_000_000
#: What a symbol at a word's end has in addition to its byte.
END = 0x200
#: Ids that one decoding step handles.
DECODE_STEP = 1 << 18


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Words(dict):
    """What ``make`` gave for short words. Full at ``KEPT_WORDS``, it becomes the
    older half, from which words still in use come back; the rest is let go."""

    def __init__(self, make):
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            made = self.make(word)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = made
        return made


class WordBpe:
    """Encoder and decoder of a word-level BPE file of the tokenizers library.

    Handles the kind of file whose normalizer is NFC, white space to one space
    and lower case; whose words are matches of a pattern; and whose merges end
    words with a suffix.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        late = late_letters(path)
        # the sets without late letters are slow, so only words that have one use them
        self.late = frozenset(c for c, (_, kind) in late.items() if kind == "other")
        self.late_pattern = regex.compile(known_letters(pattern, sorted(self.late)))
        self.pattern = regex.compile("(?V1)" + pattern)
        self.lower = {ord(c): low for c, (low, _) in late.items() if low != c}
        self.special = regex.compile("[" + "".join([*map(chr, self.lower), *apart(path)]) + "]") if self.lower or apart(path) else None
        self.apart = regex.compile("(?=[" + "".join(apart(path)) + "])") if apart(path) else None
        self.ascii_pattern = re.compile(ascii_letters(pattern), re.ASCII)
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        vocab: dict[str, int] = model["vocab"]
        names = {i: t for t, i in (vocab | self.added).items()}
        self.size = max(names) + 1
        # symbols: one character for each byte, another for it at a word's end
        self.inner = {c: chr(b) for c, b in byte_of.items()}
        self.final = {c: chr(END + b) for c, b in byte_of.items()}
        self.text_of: dict[int, str] = {i: self._symbols(t) for t, i in vocab.items()}
        self.length = {i: len(s) for i, s in self.text_of.items()}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            whole, left, right = vocab[a + b], vocab[a], vocab[b]
            self.merged.setdefault((left, right), whole)
            self.rank.setdefault(whole, rank)
            self.halves.setdefault(whole, (left, right))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words = Words(self.chunk)
        self._automaton()
        # the decoder's table: every entry's bytes with the blank that joins entries
        blobs = [(names.get(i, "") + " ").encode() for i in range(self.size)]
        self.span = np.array([len(b) for b in blobs], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.span)[:-1]])
        self.blob = np.frombuffer(b"".join(blobs), dtype=np.uint8)

    def _symbols(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return "".join(self.inner[c] for c in body[:-1]) + self.final[body[-1]]
        return "".join(self.inner[c] for c in token)

    def _automaton(self) -> None:
        """Over the entries that merging really gives. Every symbol is one of
        them, so the leftmost longest match from a position starts there."""
        ids = {s: i for i, s in self.text_of.items()}
        good = {i for i in self.text_of if self.length[i] == 1 or self._self_merged(i)}
        self.entries = ahocorasick.Automaton()
        for i in good:
            self.entries.add_word(self.text_of[i], i)
        self.entries.make_automaton()
        self.shorter: dict[int, int] = {}
        for i in good:
            s = self.text_of[i]
            for n in range(len(s) - 1, 0, -1):
                if (j := ids.get(s[:n])) in good:
                    self.shorter[i] = j
                    break

    def _self_merged(self, i: int) -> bool:
        """Whether merging the entry's own symbols by rank gives just the entry."""
        if i not in self.halves:
            return False
        parts = [self._single(c) for c in self.text_of[i]]
        while len(parts) > 1:
            ranks = [(self.rank[m], k) for k in range(len(parts) - 1) if (m := self.merged.get((parts[k], parts[k + 1]))) is not None]
            if not ranks:
                return False
            _, k = min(ranks)
            parts[k : k + 2] = [self.merged[parts[k], parts[k + 1]]]
        return parts == [i]

    @lru_cache(maxsize=1024)  # noqa: B019  as many as there are symbols
    def _single(self, symbol: str) -> int:
        return next(i for i, s in self.text_of.items() if s == symbol)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank keeps the border between two entries.

        The merges that built both are undone from the latest on; where a pair
        across the border has a merge that would have come before the one just
        undone, the border would have vanished.
        """
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._compatible(left, right)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        none = len(self.rank) + 1
        # what is undone next bounds the ranks that could have crossed; at equal
        # ranks the leftmost merge comes first: the left one before, the right one after the border
        limit: tuple[int, int] = (none, 0)
        while True:
            across = self.merged.get((a, b))
            if across is not None and (self.rank[across], 1) < limit:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb or ra == rb:
                # the border's merge of the same rank comes after the left part's
                limit = (ra, 0) if ra != rb else (rb, 2)
                if ra == rb:
                    b = self.halves[b][0]
                else:
                    a = self.halves[a][1]
            else:
                limit = (rb, 2)
                b = self.halves[b][0]

    def word(self, symbols: str) -> list[int]:
        """The entries that merging ``symbols`` by rank gives."""
        out: list[int] = []
        pairs, nxt = self.pairs, 0
        for _, nxt in self.entries.iter_long(symbols):  # longest entries, as long as they go together
            if out and not (pairs[out[-1], nxt] if (out[-1], nxt) in pairs else self.compatible(out[-1], nxt)):
                break
            out.append(nxt)
        else:
            return out
        n, length, longest = len(symbols), self.length, self.entries.iter_long
        at = sum(map(length.__getitem__, out))
        open_ = bytearray(b"\x01") * (n + 1)
        while at < n:
            i: int | None = nxt
            while i is not None:
                end = at + length[i]
                if open_[end] and (not out or self.compatible(out[-1], i)):
                    break
                i = self.shorter.get(i)
            if i is None:  # a dead end: take back the entry before it and shorten that
                open_[at] = 0
                nxt = out.pop()
                at -= length[nxt]
            else:
                out.append(i)
                at = end
                if at < n:
                    nxt = next(longest(symbols, at))[1]
        return out

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without spaces, as little-endian unsigned 32-bit integers."""
        pattern = self.ascii_pattern if chunk.isascii() else self.pattern if self.late.isdisjoint(chunk) else self.late_pattern
        parts = pattern.findall(chunk)
        if len(parts) == 1 and len(parts[0]) == len(chunk):
            return self._ids(chunk)
        out = []
        for w in parts:  # words of several chunks, with and without a comma, are encoded once
            made = self.words.get(w)
            if made is None:
                made = self._ids(w)
                if len(w) <= 64:
                    self.words[w] = made
            out.append(made)
        return b"".join(out)

    def _ids(self, word: str) -> bytes:
        s = word.encode("utf-8", "surrogatepass").decode("latin-1")
        ids = self.word(s[:-1] + chr(END + ord(s[-1])))
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """All ids of a text, little-endian; strings of added tokens give those."""
        if not self.split_added or "<" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.split_added.finditer(text):
            out += [self._plain(text[at : m.start()]), int(self.added[m[0]]).to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.normalized(text)))

    def normalized(self, text: str) -> list[str]:
        """Runs without white space of the text in NFC and lower case, one code point
        at a time (no final sigma)."""
        if not text.isascii():
            special = self.special is not None and self.special.search(text) is not None
            parts = self.apart.split(text) if special and self.apart else [text]
            text = "".join(unicodedata.normalize("NFC", x) for x in parts).replace("Σ", "σ")
            if special:
                text = text.translate(self.lower)
        text = text.lower()
        return text.split() if not any(c in text for c in NOT_SPACE) else SPACE.split(text)

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The UTF-8 of the entries joined by blanks, in pieces."""
        for a in range(0, ids.size, DECODE_STEP):
            part = ids[a : a + DECODE_STEP]
            span = self.span[part]
            ends = np.cumsum(span)
            at = np.repeat(self.offset[part] - (ends - span), span) + np.arange(ends[-1])
            if a + DECODE_STEP >= ids.size:
                at = at[:-1]
            yield self.blob[at].tobytes()


#: Code points that str.split takes for white space and the pattern does not.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
SPACE = regex.compile(r"\s+")


def ascii_letters(pattern: str) -> str:
    """``pattern`` for texts of ASCII alone, with its classes spelt out."""
    for name, those in (("L", "a-zA-Z"), ("N", "0-9")):
        pattern = pattern.replace(rf"[\p{{{name}}}]", f"[{those}]").replace(rf"[^\s\p{{L}}\p{{N}}]", r"[^\sa-zA-Z0-9]")
    if r"\p" in pattern:
        raise ValueError(f"unknown class in {pattern}")
    return pattern


@lru_cache(maxsize=2)
def late_letters(path: str) -> dict[str, tuple[str, str]]:
    """Code points that this Python's Unicode data lacks and the regex library or the
    tokenizers library knows: what the latter makes of each in lower case, and whether
    its words take it for a ``letter``, a ``number`` or an ``other``."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(path)
    every = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x110000)) if unicodedata.category(chr(c)) == "Cn"]
    lower = lib.normalizer.normalize_str("0".join(every)).split("0")
    if len(lower) != len(every):
        raise ValueError(f"the normalizer of {path} drops characters")
    known = set(regex.findall(r"[\p{L}\p{N}]", "".join(every)))
    out = {}
    for c, low in zip(every, lower):
        if c in known or low != c:
            pieces = lambda text: len(lib.pre_tokenizer.pre_tokenize_str(text))
            kind = "letter" if pieces("a" + c) == 1 else "other" if pieces("!" + c) == 1 else "number"
            out[c] = (low, kind)
    return out


@lru_cache(maxsize=2)
def apart(path: str) -> list[str]:
    """Code points that this Python composes with the one before and the library doesn't."""
    from tokenizers import Tokenizer

    lib, out = Tokenizer.from_file(path).normalizer, set()
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        pair = unicodedata.normalize("NFD", c)
        if len(pair) == 2 and unicodedata.normalize("NFC", pair) == c and lib.normalize_str(pair) != lib.normalize_str(c):
            out.add(pair[1])
    return sorted(out)


def known_letters(pattern: str, not_letters: list[str]) -> str:
    """``pattern`` with letters and numbers as the regex library has them, but for
    ``not_letters``: later ones, which count as others."""
    late = sorted(set(regex.findall(r"[\p{L}\p{N}]", "".join(not_letters))))
    if not late:
        return pattern
    new = "[" + "".join(f"\\U{ord(c):08x}" for c in late) + "]"
    for name in ("L", "N"):
        pattern = pattern.replace(rf"[\p{{{name}}}]", rf"[\p{{{name}}}--{new}]")
    return "(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{new}]")


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _let_go() -> None:
    if load.cache_info().currsize:
        load.cache_clear()
        WordBpe._single.cache_clear()
        gc.collect()


LET_GO.append(_let_go)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]), one row a row of ``docs``.

    Whole texts; a null text is empty and has no tokens. Repeated rows stay, an empty
    table gives an empty one. Long texts are decoded and hashed in pieces. Other
    columns are not read. ``path``: the vocabulary
    file, which every worker must find there.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in freed(batches):
            for part in text_slices(batch, "text"):
                n, ids_sha, text_sha, every = [], [], [], []
                for text in part.column("text").to_pylist():
                    raw = bpe.encode(text or "")
                    ids = np.frombuffer(raw, dtype="<u4")
                    h = hashlib.sha256()
                    for piece in bpe.decode(ids):
                        h.update(piece)
                    n.append(ids.size)
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(h.hexdigest())
                    every.append(ids.astype(np.int32))
                cols = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(every) if every else np.empty(0, np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
