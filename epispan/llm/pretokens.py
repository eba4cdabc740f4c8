"""Cutting texts where a byte-level pre-token surely starts, so that encoders work on distinct pieces of text.

The pre-token pattern joins at most one space to the word after it. If a text has no other white space than single spaces and
single line feeds, every space starts a pre-token and every line feed is one, whatever stands around it. Such texts
are cut by two replacements; all other texts stay whole.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "\0"

#: What makes a text stay whole: the mark, white space in a row, and all white space but space and line feed.
ODD_CODES = (0x00, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B))
ODD_CODES += (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ODD = ("  ", " \n", "\n ", "\n\n", *map(chr, ODD_CODES))

#: Bytes of memory that one kept string takes besides its characters and ids: objects and table entries, roughly.
ENTRY_BYTES = 200
#: Bytes that the younger of the two generations of a table may take before it becomes the older one.
KEPT_BYTES = 64 << 20
#: Texts whose unknown pieces are encoded together.
TEXTS_AT_ONCE = 1024


def simple(text: str) -> bool:
    return not any(odd in text for odd in ODD)


def marked(texts: list[str]) -> list[str]:
    """The texts with a mark before every space and around every line feed; a text stays whole if its white space is not that simple."""
    ask = not simple("a".join(texts))  # the letter parts white space of neighbours
    return [t if ask and not simple(t) else t.replace(" ", "\0 ").replace("\n", "\0\n\0") for t in texts]


def pieces(text: str) -> list[str]:
    """The text cut before every space and around every line feed; whole if its white space is not that simple."""
    return marked([text])[0].split(MARK) if simple(text) else [text]


class Kept:
    """Encoded bytes per string, in two generations of bounded size: what is used again moves on to the younger one."""

    def __init__(self, find: Callable[[list[str]], list[bytes]], most: int = KEPT_BYTES):
        self.find, self.most = find, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def clear(self) -> None:
        self.young, self.old, self.size = {}, {}, 0

    def table(self, wanted: Collection[str]) -> dict[str, bytes]:
        """A table that holds all wanted strings, none of them named twice, the unknown ones found together. It is good until the next call.

        The order is kept throughout: strings that were made one after the other lie side by side in memory.
        """
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0
        young, old = self.young, self.old
        missing = [s for s in wanted if s not in young]
        fresh = {s: old[s] for s in missing if s in old}
        new = [s for s in missing if s not in fresh]
        fresh.update(zip(new, self.find(new), strict=True))
        self.size += ENTRY_BYTES * len(fresh) + 2 * sum(map(len, fresh)) + sum(map(len, fresh.values()))
        self.young.update(fresh)
        return self.young


class PieceEncoder:
    """Encodes texts by their distinct pieces, which are kept, and new pieces by their distinct pre-tokens."""

    def __init__(self, split: Callable[[str], list[str]], encode_tokens: Callable[[list[str]], list[bytes]], most: int = KEPT_BYTES):
        self.split, self.encode_tokens = split, encode_tokens
        self.known = Kept(self.encode_pieces, most)

    def encode_pieces(self, batch: list[str]) -> list[bytes]:
        split = list(map(self.split, batch))
        tokens = list(dict.fromkeys(chain.from_iterable(split)))
        find = dict(zip(tokens, self.encode_tokens(tokens), strict=True)).__getitem__
        return [find(own[0]) if len(own) == 1 else b"".join(map(find, own)) for own in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(texts), TEXTS_AT_ONCE):
            out += self.encode_together(texts[start : start + TEXTS_AT_ONCE])
        return out

    def encode_together(self, texts: list[str]) -> list[bytes]:
        """Every distinct piece of the texts is looked up once; its ids are put in its places column-wise."""
        whole = [k for k, t in enumerate(texts) if MARK in t]  # a mark of its own is no cut
        if not texts:
            return []
        if whole:
            rest = iter(self.encode_together([t for t in texts if MARK not in t]))
            find = self.known.table({texts[k] for k in whole}).__getitem__
            kept = {k: find(texts[k]) for k in whole}
            return [kept[k] if k in kept else next(rest) for k in range(len(texts))]
        cut = pc.split_pattern(pa.array(marked(texts), pa.large_string()), MARK)
        named = cut.flatten().dictionary_encode()
        every = pa.ListArray.from_arrays(pa.array([0, len(named.dictionary)], pa.int32()), named.dictionary)
        distinct = pc.binary_join(every, pa.scalar(MARK, pa.large_string()))[0].as_py().split(MARK)  # one string for all: Python makes them faster than Arrow
        find = self.known.table(distinct).__getitem__
        ids = pa.array(list(map(find, distinct)), pa.large_binary()).take(named.indices)
        data = ids.buffers()[2]
        data = memoryview(data) if data is not None else memoryview(b"")
        starts = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][cut.offsets.to_numpy()].tolist()
        return [bytes(data[a:b]) for a, b in zip(starts, starts[1:])]


#: Marks that are a pre-token of their own after a word.
MARKS = frozenset(".,;:!?")


def simple_tokens(piece: str) -> list[str] | None:
    """Pre-tokens of a word with at most one space before and one mark after it; None for any other piece."""
    word = piece[1:] if piece[:1] == " " else piece
    if word.isalpha():
        return [piece]
    if word[-1:] in MARKS and word[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return None
