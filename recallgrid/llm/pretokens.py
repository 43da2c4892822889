"""Pre-tokens of byte-level vocabularies, found by array operations over many texts at once.

The byte-level pattern cuts a text into runs of letters, of numbers, of other characters
and of white space. One space leads the run after it; of longer white space before a run
the last character is cut off; and an apostrophe that no space leads takes s, t, m, d,
re, ve or ll with it. Merges never cross a pre-token, so each distinct one needs the
library once. Pre-tokens are told apart by a 64-bit hash and looked up in a table of
fixed size, in which a new one takes the place of one that has the same slot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

OTHER, LETTER, NUMBER, SPACE = range(4)


def char_classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))  # all but surrogates
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, every):
            out[ord(found[0][0]) : ord(found[0][-1]) + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def pretoken_starts(codes: np.ndarray, begins: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pre-tokens start in the code points of texts that lie one after the other from ``begins`` on."""
    n = len(codes)
    kind = classes[codes]
    edge = np.zeros(n + 1, bool)  # a text begins here, or all end
    edge[begins] = edge[0] = edge[n] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start, at = run[:n].copy(), np.flatnonzero(run)
    first, end = at[:-1], at[1:]
    own = kind[first]
    last = end[own == SPACE] - 1
    last = last[~edge[last + 1]]
    start[last] = True
    start[last[codes[last] == 32] + 1] = False  # led by the space
    quote = first[(own == OTHER) & (end - first == 1)]
    quote = quote[(codes[quote] == 39) & start[quote] & ~edge[quote + 1]]
    one = codes[quote + 1]
    two = np.where(edge[quote + 2], 0, codes[np.minimum(quote + 2, n - 1)])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for width, those in ((2, quote[short]), (3, quote[long])):
        start[those + 1] = False
        after = those + width
        start[after[after < n]] = True
    return np.flatnonzero(start)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PreTokenTable:
    """Number arrays of pre-tokens, made by ``learn`` for each new one and kept while there is room."""

    #: Slots as a power of two, and numbers that are kept.
    SLOTS, ROOM = 20, 6_000_000

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype=np.uint32):
        self.learn, self.classes = learn, char_classes()
        self.values, self.used = np.empty(self.ROOM, dtype), 0
        self.weights = np.empty(0, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(1 << self.SLOTS, np.uint64)
        self.at, self.size = (np.zeros(1 << self.SLOTS, np.int32) for _ in range(2))
        self.used = 0

    def _hashes(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(starts, append=len(codes))
        if sizes.max() > len(self.weights):
            places = np.arange(1, 2 * int(sizes.max()) + 1, dtype=np.uint64)
            self.weights = _mixed(places * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        x = codes.astype(np.uint64)
        x += np.uint64(1)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= self.weights[np.arange(len(codes)) - np.repeat(starts, sizes)]
        return np.add.reduceat(x, starts) | np.uint64(1)  # never an empty slot's 0

    def _append(self, made: np.ndarray) -> int:
        at, end = self.used, self.used + len(made)
        if end > len(self.values):
            self.values = np.concatenate([self.values, np.empty(max(end - len(self.values), self.ROOM), self.values.dtype)])
        self.values[at:end] = made
        self.used = end
        return at

    def numbers(self, whole: str, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pre-tokens of ``whole``, and where those of each text start; the last entry is their end."""
        if not whole:
            return np.empty(0, self.values.dtype), np.zeros(len(begins) + 1, np.int64)
        if self.used > self.ROOM:
            self._clear()
        codes = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        starts = pretoken_starts(codes, begins[begins < len(codes)], self.classes)
        keys = self._hashes(codes, starts)
        slot = (keys >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        new = np.flatnonzero(self.key[slot] != keys)
        if len(new):
            own, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            some = new[first]
            stops = np.append(starts, len(codes))[some + 1]
            made, sizes = self.learn([whole[s:e] for s, e in zip(starts[some].tolist(), stops.tolist(), strict=True)])
            places = (self._append(made) + np.cumsum(sizes) - sizes).astype(np.int32)
            at[new], size[new] = places[which], sizes[which]
            slot = slot[some]
            self.key[slot], self.at[slot], self.size[slot] = own, places, sizes
        ends = np.cumsum(size, dtype=np.int64)
        before = ends - size
        out = self.values[np.repeat(at - before, size) + np.arange(ends[-1])]
        return out, np.append(ends, 0)[np.searchsorted(starts, np.append(begins, len(codes))) - 1]
