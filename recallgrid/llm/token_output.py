"""Token ids in fixed-width bit-packed files with block offsets.

Every id takes the bits that the vocabulary size needs (16 for 50,257 ids). A file is

    magic | width u32, ids per block u32 | blocks | document index | block offsets | footer | magic

Each block holds the same number of ids (the last one fewer), so that any run of ids is
unpacked from a few blocks by numpy, without what lies before it. The document index
has each document's id, first id and number of ids. Files hold ascending ranges of
doc_id; the manifest beside them has each file's first id within the whole corpus.

Edge cases: a null text is empty and yields only the end id; null doc_ids sort first;
repeated doc_ids are kept side by side, ordered by text,
in several files where their texts begin differently; an empty table gives a manifest
without files; other columns are ignored. A file is written under a name of its own
attempt and then renamed, so a lost or repeated task leaves whole files only.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_fs, scratch_dir, table, text_batches, tokenizer_path
from .pretokens import PreTokenTable

MAGIC = b"RGTOKEN1"
HEAD = struct.Struct("<8sII")
FOOT = struct.Struct("<QQQQQ8s")
#: Ids that are unpacked at a time when a file is read from end to end.
READ_IDS = 1 << 20
#: Bytes of a document in a file's index.
INDEX_BYTES = 32


def bit_width(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class PackedWriter:
    """Writes one file; holds one block and the document index in memory."""

    def __init__(self, out, vocab_size: int, block: int = 1 << 14):
        self.out, self.width, self.block = out, bit_width(vocab_size), block
        self.waiting: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.at = HEAD.size
        self.offsets: list[int] = []
        self.docs: list[tuple[int, int, int, int]] = []
        out.write(HEAD.pack(MAGIC, self.width, block))

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of several documents, one after the other."""
        starts = self.n_ids + np.cumsum(sizes) - sizes
        self.docs += [(d is None, d or 0, s, n) for d, s, n in zip(doc_ids, starts.tolist(), sizes.tolist(), strict=True)]
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.waiting)
            end = len(whole) // self.block * self.block
            for k in range(0, end, self.block):
                self._put(whole[k : k + self.block])
            self.waiting, self.held = [whole[end:]], len(whole) - end

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        index = np.array(self.docs, dtype="<i8").reshape(-1, 4).tobytes()
        offsets = np.array(self.offsets, dtype="<u8").tobytes()
        self.out.write(index)
        self.out.write(offsets)
        self.out.write(FOOT.pack(self.n_ids, len(self.docs), len(self.offsets), self.at, self.at + len(index), MAGIC))


class PackedReader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        magic, self.width, self.block = HEAD.unpack(self._bytes(0, HEAD.size))
        self.n_ids, n_docs, n_blocks, index_at, offsets_at, end = FOOT.unpack(self._bytes(source.size() - FOOT.size, FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token file, or cut off")
        self.docs = np.frombuffer(self._bytes(index_at, n_docs * 32), "<i8").reshape(-1, 4)
        self.offsets = np.frombuffer(self._bytes(offsets_at, n_blocks * 8), "<u8")
        self.index_at = index_at

    def _bytes(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def read(self, start: int, n: int) -> np.ndarray:
        """The ids [start, start + n) as uint32, from the blocks that hold them only."""
        if n <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.index_at
        parts, data, at = [], self._bytes(int(self.offsets[first]), end - int(self.offsets[first])), int(self.offsets[first])
        for k in range(first, last + 1):
            count = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(data[int(self.offsets[k]) - at :][: (count * self.width + 7) // 8], count, self.width))
        return np.concatenate(parts)[start - first * self.block :][:n]


class TextEncoder:
    """Whole texts to ids by the ``tokenizers`` library, which encodes each distinct pre-token once (see pretokens.py).

    New pre-tokens go in one call with a special token between them; texts that hold a
    special string are encoded whole.
    """

    #: Pre-tokens that the library gets in one call.
    TOGETHER = 20_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = self.library.get_added_tokens_decoder()
        self.specials = tuple(t.content for t in special.values())
        self.between = next(((t.content, k) for k, t in special.items() if not (t.lstrip or t.rstrip)), None)
        self.table = PreTokenTable(self._learn, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens, and how many each has."""
        if self.between is None:
            parts = [self._whole(t) for t in tokens]
            return np.concatenate(parts), np.array([len(x) for x in parts])
        made, sizes = [], []
        for k in range(0, len(tokens), self.TOGETHER):
            ids = self._whole(self.between[0].join(tokens[k : k + self.TOGETHER]))
            cuts = np.flatnonzero(ids == self.between[1])
            sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
            made.append(np.delete(ids, cuts))
        return np.concatenate(made), np.concatenate(sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each one's."""
        whole = "".join(texts)
        if any(s in whole for s in self.specials):
            parts = [self._whole(t) if any(s in t for s in self.specials) else self.encode([t])[0] for t in texts]
            return np.concatenate(parts), np.array([len(x) for x in parts])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        ids, bounds = self.table.numbers(whole, np.append(0, ends[:-1]))
        return ids, np.diff(bounds)


_ENCODERS: dict[str, TextEncoder] = {}


def _encoder(path: str) -> TextEncoder:
    """One encoder for all tasks of a worker: a function of the module is sent by name, so its dictionary is the worker's own."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, out_dir: str, path: str, vocab_size: int, end_id: int = 0, shard_bytes: int = 64 << 20) -> list[dict]:
    """Encode all rows of (doc_id, text) into files below ``out_dir``; returns the manifest, also kept there.

    One range exchange of the texts by doc_id and the text's beginning, then each task streams its range into one
    file. ``shard_bytes`` of text and index is the aim for one file; only the manifest, a row per
    file, comes to the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text") + INDEX_BYTES)).first()[0] or 0
    sorted_docs = docs.repartitionByRange(max(1, -(-total // shard_bytes)), "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, writer = _encoder(path).encode, TaskContext.get().partitionId(), None
        files, root = open_fs(out_dir)
        name, own = f"tokens-{shard:06d}.bin", f".{uuid.uuid4().hex}.tmp"
        for rows in text_batches(batches, 1):
            if writer is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(f"{root}/{own}")
                writer = PackedWriter(out, vocab_size)
            ids, sizes = encode(rows.column(1).to_pylist())
            writer.add(rows.column(0).to_pylist(), np.insert(ids, np.cumsum(sizes), end_id), sizes + 1)
        if writer is not None:
            writer.close()
            out.close()
            files.move(f"{root}/{own}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    made = sorted_docs.mapInArrow(run, "shard long, file string, n_docs long, n_ids long").collect()
    manifest, base = [], 0
    for row in sorted(made, key=lambda r: r.shard):
        manifest.append(row.asDict() | {"start": base})
        base += row.n_ids
    files, root = open_fs(out_dir)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"vocab_size": vocab_size, "end_id": end_id, "files": manifest}).encode())
    return manifest


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32, file."""
    files, root = open_fs(out_dir)
    with files.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())["files"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_fs(out_dir)
        for k in (k for batch in batches for k in batch.column(0).to_pylist()):
            with files.open_input_file(f"{root}/{manifest[k]['file']}") as source:
                reader = PackedReader(source)
                docs, crcs, lo, hi, ids = reader.docs, [], 0, 0, None
                for _, _, start, n in docs.tolist():
                    if start + n > hi:
                        lo, hi = start, min(reader.n_ids, start + max(n, READ_IDS))
                        ids = reader.read(lo, hi - lo)
                    crcs.append(zlib.crc32(ids[start - lo : start - lo + n].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs[:, 1], mask=docs[:, 0] == 1), pa.array(docs[:, 2] + manifest[k]["start"]), pa.array(docs[:, 3].copy()), pa.array(crcs, pa.int64()), pa.array([manifest[k]["file"]] * len(docs), pa.string())],
                names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
            )

    return spark.range(0, len(manifest), 1, max(1, len(manifest))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out_dir = scratch_dir(spark, "op1-tokens")
    write_token_files(table(spark, sf_dir, "documents"), out_dir, tokenizer_path("byte_bpe_50k.json"), 50_257)
    return read_token_files(spark, out_dir)
