"""Tokens, n-grams, chunks and answer normalisation as native string expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as one word. They are applied once, so favourite becomes
# favorite although favorite itself becomes likes.
ALIASES = {
    "automobile": "car",
    "vehicle": "car",
    "colour": "color",
    "hue": "color",
    "resides": "lives",
    "dwells": "lives",
    "enjoys": "likes",
    "prefers": "likes",
    "favourite": "favorite",
    "favorite": "likes",
    "purchased": "bought",
    "acquired": "bought",
}
#: A word is a run of letters, digits, underscores and apostrophes of any script.
TOKEN = r"[\p{L}\p{N}_']+"


def tokens(text: Column, aliases: dict[str, str] | None = None, boundaries: bool = False) -> Column:
    known = {**ALIASES, **(aliases or {})}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.isin(list(known)), F.try_element_at(table, t)).otherwise(t))
    return F.concat(F.array(F.lit("<bos>")), found, F.array(F.lit("<eos>"))) if boundaries else found


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, however often ``use`` names it: the variable of an outer transform."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(items: Column, n: int, prefix: str, between: str) -> Column:
    """``prefix`` and the joined items of each run of n: the array against itself moved by 1, 2, ... places, so linear in its length."""
    size = F.greatest(F.size(items) - n + 1, F.lit(0))
    moved = F.arrays_zip(*[F.slice(items, k + 1, size).alias(f"i{k}") for k in range(n)])
    return F.transform(moved, lambda z: F.concat(F.lit(prefix), F.concat_ws(between, *[z[f"i{k}"] for k in range(n)])))


def word_ngrams(words: Column, n: int) -> Column:
    return bound(words, lambda w: _runs(w, n, f"w{n}:", "_"))


def char_ngrams(words: Column, n: int) -> Column:
    return bound(F.split(F.array_join(words, " "), ""), lambda c: F.when(F.get(c, F.lit(0)) != "", _runs(c, n, f"c{n}:", "")).otherwise(F.array().cast("array<string>")))


def md5_bucket(feature: Column, dimension: int) -> Column:
    """60 bits of a digest, modulo the dimension: a hash that any SQL engine can repeat."""
    return (F.conv(F.substring(F.md5(feature), 1, 15), 16, 10).cast("bigint") % dimension).cast("int")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    without = F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " ")  # word ends of any script
    return F.trim(F.regexp_replace(without, r"\s+", " "))


def chunk_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of chunks; a text without units gives one empty chunk, a trailing contained one is kept."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    return F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1, F.lit(size - overlap))


def char_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end, chunk) over characters."""

    def cut(x: Column) -> Column:
        spans = lambda s: F.struct(s.alias("start"), F.least(s + size, x["n"]).alias("end"), F.array_join(F.slice(x["c"], s + 1, size), "").alias("chunk"))
        return F.transform(chunk_starts(x["n"], size, overlap), spans)

    return bound(F.struct(F.length(text).alias("n"), F.split(text, "").alias("c")), cut)


def word_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, end, chunk) over words at white space; chunks are joined by single spaces."""


    def cut(words: Column) -> Column:
        spans = lambda s: F.struct(s.alias("start"), F.least(s + size, F.size(words)).alias("end"), F.array_join(F.slice(words, s + 1, size), " ").alias("chunk"))
        return F.transform(chunk_starts(F.size(words), size, overlap), spans)

    return bound(F.filter(F.split(text, r"\s+"), lambda w: w != ""), cut)
