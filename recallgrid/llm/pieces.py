"""Splitting of texts into pieces that a byte-level BPE vocabulary treats independently.

The byte-level pre-tokenizer never joins characters across a space except that one
space may lead a token, and a line end between other characters is a token of its own. So
a text whose spaces and line ends stand alone can be cut at each of them, and each
distinct piece needs work once per worker; any other text goes whole.
"""

from __future__ import annotations

from collections.abc import Callable


class PieceCache(dict):
    """piece -> value, computed where missing; emptied when it holds ``limit`` pieces, which bounds memory."""

    def __init__(self, make: Callable, limit: int = 400_000, longest: int = 256):
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = value
        return value


#: White space that would tie pieces together.
TIED = ("  ", " \n", "\n ", "\n\n")


def split_pieces(text: str, specials: tuple[str, ...]) -> tuple[str, list[str]] | None:
    """First piece and the others; None where the text must go whole.

    A piece follows one space, or starts with the line end that precedes it.
    """
    if any(s in text for s in TIED) or any(s in text for s in specials):
        return None
    first, *rest = text.replace("\n", " \n").split(" ")
    return first, rest
