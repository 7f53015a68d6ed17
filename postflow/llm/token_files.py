"""Token ids in fixed-width binary files (operator 7).

Rows are put in ascending doc_id order by a range exchange, so a task holds a run of the order and
writes one file: every id takes the minimum number of bits for the vocabulary.  Ids come in blocks of
``BLOCK``; each block begins at a byte, and a table of block offsets at the end of the file lets a reader
fetch and unpack (numpy, no loop over ids) just the blocks that a document lies in.

    magic (8 bytes) | packed blocks | block offsets (u8 each) | document ids (i8) | null marks (u1)
    | document starts in this file (u8) | trailer: bits, block size, ids, documents, blocks (u8 each), magic

A document's ids follow one another, lowest bit first.  Files go to the folder that all executors share,
under a name of the attempt; the manifest names the file of the attempt that ended, so repeated or lost
attempts change nothing.

Cases: a null text counts as an empty one and has the end id alone.  Null doc_ids come first.  Rows with
the same doc_id follow one another in the order of a hash of their texts.  An empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import shared_dir
from .encoders import ID, word_encoder
from .tables import stored, with_text_ids

MAGIC = b"PFIDS001"
BLOCK = 1 << 16
TRAILER = np.dtype([("bits", "<u8"), ("block", "<u8"), ("ids", "<u8"), ("documents", "<u8"), ("blocks", "<u8")])
DOCS_PER_FILE = 8_192


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same bytes as below
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype(ID).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(ID)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view(ID).ravel()


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """One file.  Holds one block of ids and the table of documents."""

    def __init__(self, path: str, bits: int):
        where, name = _place(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.out, self.bits = where.open_output_stream(name), bits
        self.out.write(MAGIC)
        self.at, self.count = len(MAGIC), 0
        self.offsets: list[int] = []
        self.documents: list[tuple[int, bool, int]] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id or 0, doc_id is None, self.count))
        self.count += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ids = np.concatenate(self.waiting)
            full = len(ids) // BLOCK * BLOCK
            for k in range(0, full, BLOCK):
                self._block(ids[k:k + BLOCK])
            self.waiting, self.held = [ids[full:].copy()], len(ids) - full

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        ids, null, starts = zip(*self.documents) if self.documents else ((), (), ())
        for values, kind in ((self.offsets, "<u8"), (ids, "<i8"), (null, "u1"), (starts, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(np.array([(self.bits, BLOCK, self.count, len(ids), len(self.offsets))], TRAILER).tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        where, name = _place(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        tail = TRAILER.itemsize + len(MAGIC)
        raw = self.file.read_at(tail, size - tail)
        if raw[-len(MAGIC):] != MAGIC:
            raise ValueError(f"{path} is not a file of token ids")
        t = np.frombuffer(raw, TRAILER, 1)[0]
        self.bits, self.block, self.count = int(t["bits"]), int(t["block"]), int(t["ids"])
        n, blocks = int(t["documents"]), int(t["blocks"])
        table = self.file.read_at(8 * blocks + 17 * n, size - tail - 8 * blocks - 17 * n)
        self.end_of_blocks = size - tail - 8 * blocks - 17 * n
        self.offsets = np.frombuffer(table, "<u8", blocks).astype(np.int64)
        self.doc_ids = np.frombuffer(table, "<i8", n, 8 * blocks)
        self.null = np.frombuffer(table, "u1", n, 8 * blocks + 8 * n).astype(bool)
        self.starts = np.frombuffer(table, "<u8", n, 8 * blocks + 9 * n).astype(np.int64)
        self.stops = np.append(self.starts[1:], self.count)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; reads the blocks that they lie in."""
        if start >= stop:
            return np.zeros(0, ID)
        first, last = start // self.block, (stop - 1) // self.block
        out = []
        for k in range(first, last + 1):
            end = self.offsets[k + 1] if k + 1 < len(self.offsets) else self.end_of_blocks
            count = min(self.block, self.count - k * self.block)
            out.append(unpack(self.file.read_at(int(end - self.offsets[k]), int(self.offsets[k])), count, self.bits))
        return np.concatenate(out)[start - first * self.block:stop - first * self.block]


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Writes the files and returns their manifest: file (number in the order), path, n_ids."""
    files = max(1, -(-docs.count() // docs_per_file))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(files, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, encoder, out = TaskContext.get(), word_encoder(path), None
        name = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.ids"
        for b in batches:
            for doc_id, text in zip(b["doc_id"], b["text"]):
                out = out or Writer(name, bits_for(encoder.size))
                ids = np.frombuffer(encoder.encode(text), ID)
                out.add(None if doc_id is None else int(doc_id), np.append(ids, np.array([end_id], ID)))
        if out:
            out.close()
            yield pd.DataFrame({"file": [task.partitionId()], "path": [name], "n_ids": [out.count]})

    return stored(with_text_ids(ordered, "text").mapInPandas(put, "file long, path string, n_ids long"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest."""
    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, base in zip(b["path"], b["base"]):
                r = Reader(name)
                cuts = np.searchsorted(r.starts, np.arange(0, r.count, 16 * BLOCK))  # bounded groups of documents
                for lo, hi in zip(cuts, [*cuts[1:], len(r.starts)]):
                    if lo == hi:
                        continue
                    first = r.starts[lo]
                    ids = r.ids(first, r.stops[hi - 1])
                    spans = list(zip((r.starts[lo:hi] - first).tolist(), (r.stops[lo:hi] - first).tolist()))
                    yield pd.DataFrame({
                        "doc_id": pd.arrays.IntegerArray(r.doc_ids[lo:hi].astype(np.int64), r.null[lo:hi].copy()),
                        "start": base + r.starts[lo:hi], "n_tokens": [e - s for s, e in spans],
                        "ids_crc32": [zlib.crc32(ids[s:e].tobytes()) for s, e in spans]})

    # One row for each file: small, and a running sum over files in order.
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    spread = placed.repartition(max(1, manifest.count()), "file")
    return spread.select("path", "base").mapInPandas(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, path: str) -> DataFrame:
    """Writes all texts' ids below the shared folder and reports on what the files hold."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}-ids"
    return read(write(docs, path, folder))
