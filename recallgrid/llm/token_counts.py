"""Token counts by heap-and-linked-list byte-pair merging, without identifiers.

The symbols of a piece of text form a doubly linked list; a heap holds the adjacent
pairs that have a merge rank. The lowest rank, and the leftmost among equals, is popped
again and again; entries whose pair has changed meanwhile are stale and skipped. The
count is the number of initial symbols minus the number of merges.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); a special string inside a
text is one token, as the library has it by default; a null id is kept; repeated rows
are counted each; other columns of the input are ignored; an empty table gives none.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches, tokenizer_path
from .pieces import PieceCache, split_pieces


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each of the 256 bytes.

    Printable Latin-1 bytes stand for themselves, the others for code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class HeapBPE:
    """Counts the tokens of a text for a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        vocab = spec["model"]["vocab"]
        self.start = [vocab[c] for c in byte_alphabet()]
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            self.ranks[vocab[left] << 20 | vocab[right]] = rank
            self.joined.append(vocab[left + right])
        self.specials = tuple(x["content"] for x in spec["added_tokens"])
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        # The byte-level pre-tokenizer's fixed pattern.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.by_token = PieceCache(self.merge_count)
        self.by_piece = PieceCache(lambda piece: self.plain_count(piece if piece[:1] == "\n" else " " + piece))

    def merge_count(self, token: str) -> int:
        """Symbols that are left when no adjacent pair of the pre-token can be merged."""
        ids = [self.start[b] for b in token.encode()]
        size, ranks = len(ids), self.ranks
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [rank << 32 | i for i in range(size - 1) if (rank := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i]
            if ids[i] < 0 or j >= size or ranks.get(ids[i] << 20 | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self.joined[rank], -1
            after[i] = k = after[j]
            merges += 1
            if k < size:
                before[k] = i
                if (r := ranks.get(ids[i] << 20 | ids[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(ids[h] << 20 | ids[i])) is not None:
                heapq.heappush(heap, r << 32 | h)
        return size - merges

    def plain_count(self, text: str) -> int:
        return sum(map(self.by_token.__getitem__, self.pattern.findall(text)))

    def count(self, text: str) -> int:
        if (cut := split_pieces(text, self.specials)) is not None:
            return self.plain_count(cut[0]) + sum(map(self.by_piece.__getitem__, cut[1]))
        if self.split_special is None:
            return self.plain_count(text)
        found = len(self.split_special.findall(text))
        return found + sum(map(self.plain_count, self.split_special.split(text)))


_COUNTERS: dict[str, HeapBPE] = {}


def _counter(path: str) -> HeapBPE:
    if path not in _COUNTERS:
        _COUNTERS[path] = HeapBPE(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; map-only, one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path).count
        for batch in text_batches(batches, 1):
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([count(t) for t in texts], pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, F.coalesce(text_col, F.lit("")).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
