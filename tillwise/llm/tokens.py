"""Encoding whole texts piece by piece, with a cache of what a worker has met.

A byte-level tokenizer cuts a text before each single space, and before each single line feed,
that stands between other characters; what lies between two cuts (a piece) is encoded alike
wherever it stands. A text in which white space meets white space, or that begins or ends with
it, or that holds the text of an added token, is encoded as one piece.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import lru_cache

#: Characters in the two generations of a worker's cache.
CACHE_CHARS = 24_000_000
#: Pieces above this length are encoded without being kept.
LONGEST_KEPT = 64


class Pieces(dict):
    """Piece -> value, in two generations: what is not met again while one fills is dropped.

    The value of an odd piece is None, which cannot be joined with others.
    """

    def __init__(self, make: Callable[[str], object], limit: int = CACHE_CHARS) -> None:
        super().__init__()
        self.make, self.half, self.size, self.older = make, limit // 2, 0, {}

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            # letters alone are never odd
            value = self.make(piece) if piece.isalpha() or not is_odd(piece) else None
            if value is None or len(piece) > LONGEST_KEPT:
                return value
        if self.size > self.half:
            self.older, self.size = dict(self), 0
            self.clear()
        self.size += len(piece) + 8
        self[piece] = value
        return value


@lru_cache(maxsize=4)
def added_tokens(path: str) -> dict[str, int]:
    """The texts that a tokenizer file maps to ids before anything else."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    found = {}
    for token in spec["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"The added token {token['content']!r} takes its neighbours with it.")
        found[token["content"]] = token["id"]
    pre = spec["pre_tokenizer"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
        raise ValueError(f"{path} is not a plain byte-level tokenizer.")
    return found


def cut(text: str, added: Iterable[str]) -> list[str] | None:
    """The pieces after the first (with their space left off), or None for a text to keep whole.

    A piece that begins with a line feed stands as it is; any other follows a space. Where one of
    the pieces :func:`is_odd`, the text has to be kept whole after all.
    """
    if any(x in text for x in added):
        return None
    pieces = text.replace("\n", " \n").split(" ")
    return None if text and is_odd("\n" + pieces[0]) else pieces


def is_odd(piece: str) -> bool:
    """True if a piece shows that white space meets white space, or begins or ends the text."""
    body = piece[1:] if piece[:1] == "\n" else piece
    return not body or body[0].isspace() or body[-1].isspace()


def spelled(piece: str) -> str:
    """A later piece of :func:`cut` as it stands in the text."""
    return piece if piece[:1] == "\n" else " " + piece
