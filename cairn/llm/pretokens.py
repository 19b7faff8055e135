"""Pre-tokens of the byte-level vocabularies, with caches over the stretches between single spaces."""

from __future__ import annotations

import base64
from itertools import chain

import public_tokenizers
import regex

PATTERN = public_tokenizers.PATTERN
#: Entries after which a worker starts its cache anew; it bounds the room taken, never the results.
CACHE = 120_000
#: Characters of a stretch beyond which it is not cached.
LONG = 64

split_pieces = regex.compile(PATTERN).findall
_uneven = regex.compile(r"^\s|\s$|\s | \s").search
_edge_space = regex.compile(r"^\s|\s$|^$").search


def stretches(text: str) -> list:
    """Cut before single spaces that no match of PATTERN can cross.

    A space between two characters that are no white space always begins the match of what follows it. So a text
    may be cut before it, and each part matched alone. Parts with white space at an edge are joined again. A string
    stands for itself after a space, a tuple of one string for the string alone.
    """
    parts = text.split(" ")
    if not _uneven(text):
        parts[0] = (parts[0],)
        return parts
    out, held = [], parts[0]
    for before, p in zip(parts, parts[1:], strict=False):
        if not _edge_space(before) and not _edge_space(p):
            out.append((held,))
            held = " " + p
        else:
            held += " " + p
    out.append((held,))
    return out


def pieces_of(stretch) -> list[str]:
    return split_pieces(" " + stretch if isinstance(stretch, str) else stretch[0])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Generations:
    """A cache of two generations: what is not asked for again while one fills is forgotten."""

    def __init__(self, size: int = CACHE):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are not known; the others are in ``young`` afterwards."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
        return new


class PieceCache:
    """Map each stretch of a batch of texts by ``solve(list of new pieces) -> list of values`` and ``join``."""

    def __init__(self, solve, join, size: int = CACHE):
        self.solve, self.join, self.pieces, self.known = solve, join, Generations(size), Generations(size)

    def values(self, parts: list[list]) -> list[list]:
        """For each list of stretches the list of their joined values."""
        new = self.known.missing(set(chain.from_iterable(parts)))
        known = self.known.young
        if new:
            split = list(map(pieces_of, new))
            fresh = self.pieces.missing(set(chain.from_iterable(split)))
            pieces = self.pieces.young
            pieces.update(zip(fresh, self.solve(fresh), strict=True))
            known.update((s, self.join([pieces[p] for p in ps])) for s, ps in zip(new, split, strict=True))
            for p in fresh:
                if len(p) > LONG:
                    del pieces[p]
        out = [[known[s] for s in p] for p in parts]
        for s in new:
            if len(s) > LONG or isinstance(s, tuple):
                del known[s]
        return out
