"""Byte-pair encoding and decoding, word by word, from a tokenizer file.

Each word is a doubly linked list of symbols. A priority queue holds the ranks of all adjacent
pairs; the lowest rank (the leftmost of equals) is merged, the pairs it makes with its
neighbours are queued, and entries whose pair is no longer there are skipped. Decoding
concatenates the vocabulary's byte strings and reads them as UTF-8.

Defined results: a null text is encoded as the empty one, which has no ids; the text of an added
token becomes that token; bytes that are no UTF-8 decode to U+FFFD; repeated rows each get
theirs; a very long word costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillwise.llm.frames import with_struct
from tillwise.llm.tokens import LONGEST_KEPT, Pieces, added_tokens, cut, spelled

#: Fixed value: how byte-level tokenizers cut text into words.
WORD_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: Characters of the pieces that a worker keeps, 8 more for each: about 80 MB, as ids are packed.
KEPT_CHARS = 7_000_000
#: Short words without a space before them that a worker keeps.
WORDS_KEPT = 20_000

ENCODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded", T.StringType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def is_plain_word(text: str) -> bool:
    """Letters up to U+00FF alone, which every version of Unicode takes for letters."""
    return text.isalpha() and (text.isascii() or max(text) <= "\xff")


class BytePairs:
    """The merges and vocabulary of one tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.added = added_tokens(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        self.first = [vocabulary[c] for c in symbols]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            pair = vocabulary[left] << 32 | vocabulary[right]
            self.merges.setdefault(pair, (rank, vocabulary[left + right]))
        back = {c: b for b, c in enumerate(symbols)}
        top = max([*vocabulary.values(), *self.added.values()])
        self.bytes: list[bytes] = [b""] * (top + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.pattern = regex.compile(WORD_PATTERN)
        self.split = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len)[::-1])) + ")")
            if self.added
            else None
        )
        self.type = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.marks = {c: self.pack(self.merge(c.encode())) for c in ".,\n"}
        self.later = Pieces(self.later_piece, KEPT_CHARS)

    def merge(self, word: bytes) -> list[int]:
        """Merge one word's bytes into vocabulary ids."""
        ids = [self.first[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for at in range(n - 1):
            if known := merges.get(ids[at] << 32 | ids[at + 1]):
                queue.append(known[0] << 32 | at)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            at = entry & 0xFFFFFFFF
            right = after[at]
            if ids[at] < 0 or right >= n:
                continue
            known = merges.get(ids[at] << 32 | ids[right])
            if known is None or known[0] != entry >> 32:
                continue  # the pair that was queued here is gone
            ids[at], ids[right] = known[1], -1
            beyond = after[at] = after[right]
            if beyond < n:
                before[beyond] = at
                if known := merges.get(ids[at] << 32 | ids[beyond]):
                    heapq.heappush(queue, known[0] << 32 | at)
            if (left := before[at]) >= 0 and (known := merges.get(ids[left] << 32 | ids[at])):
                heapq.heappush(queue, known[0] << 32 | left)
        return [i for i in ids if i >= 0]

    def cut_words(self, text: str) -> list[str]:
        """Cut a text into words; characters on which Unicode versions differ go to the library."""
        if max(text, default="") < "ɐ" or all(c < "ɐ" or "‐" <= c <= "‧" for c in text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()

    def later_piece(self, piece: str) -> bytes:
        """A piece that follows others. A mark after letters, and a line feed, are words of their own."""
        if piece[-1] in ".," and is_plain_word(piece[:-1]):
            return self.later[piece[:-1]] + self.marks[piece[-1]]
        if piece[0] == "\n" and is_plain_word(piece[1:]):
            return self.marks["\n"] + self.pack(self.merge(piece[1:].encode()))
        if is_plain_word(piece):
            return self.pack(self.merge(b" " + piece.encode()))
        return self.piece(spelled(piece))

    def piece(self, text: str) -> bytes:
        """The packed ids of a text that holds no added token."""
        words = self.cut_words(text)
        if len(words) == 1:
            return self.pack(self.merge(words[0].encode()))
        return b"".join(map(self.word, words))

    def word(self, word: str) -> bytes:
        """One word of several; those after a space are pieces of their own."""
        if word[0] == " " and len(word) > 1 and not word.isspace():
            return self.later[word[1:]]
        ids = self.words.get(word)
        if ids is None:
            ids = self.pack(self.merge(word.encode()))
            if len(word) <= LONGEST_KEPT:
                if len(self.words) >= WORDS_KEPT:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        pieces = cut(text, self.added)
        if pieces is not None:
            found = [self.piece(pieces[0])]
            found.extend(map(self.later.__getitem__, pieces[1:]))
            if None not in found:
                return b"".join(found)
        ids = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                ids.append(self.pack([self.added[part]]))
            elif part:
                ids.append(self.piece(part))
        return b"".join(ids)

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return np.frombuffer(self.packed(text), self.type).tolist()

    def decode(self, ids: list[int]) -> str:
        """Concatenate the ids' vocabulary strings."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    """A worker's tokenizer, loaded once."""
    return BytePairs(path)


def add_tokens(
    docs: DataFrame, path: str, name: str = "tokens", keep: list[str] | None = None
) -> DataFrame:
    """Add n_tokens, the ids and the text decoded from them, as a struct column."""

    def prepare():
        pairs = byte_pairs(path)

        def compute(column: pa.Array) -> pa.StructArray:
            ids = [pairs.encode(x or "") for x in column.to_pylist()]
            return pa.StructArray.from_arrays(
                [
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([pairs.decode(x) for x in ids], pa.string()),
                ],
                names=ENCODED.names,
            )

        return compute

    return with_struct(docs, name, ENCODED, prepare, keep)


def add_token_digests(
    docs: DataFrame, path: str, name: str = "tokens", keep: list[str] | None = None
) -> DataFrame:
    """As :func:`add_tokens`, with SHA-256 digests in place of the ids and the decoded text.

    The ids are digested as decimal numbers joined by commas.
    """

    def prepare():
        pairs = byte_pairs(path)
        digits = np.array([str(i) for i in range(len(pairs.bytes))], object).tolist()

        def compute(column: pa.Array) -> pa.StructArray:
            counts, of_ids, of_text = [], [], []
            for value in column:
                ids = pairs.encode(value.as_py() or "")
                counts.append(len(ids))
                joined = ",".join(map(digits.__getitem__, ids))
                of_ids.append(hashlib.sha256(joined.encode()).hexdigest())
                of_text.append(hashlib.sha256(pairs.decode(ids).encode()).hexdigest())
            return pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                names=DIGESTS.names,
            )

        return compute

    return with_struct(docs, name, DIGESTS, prepare, keep)
