"""Byte-level BPE encoding and decoding (operator 3).

A text longer than ``chunk`` characters is cut into chunks that overlap.  The chunks are dealt to tasks
one by one and pre-tokenised side by side, each from its own start, which may lie within a pre-token.
Stitching then goes along the chunks of a text: where two neighbours have a pre-token border in common,
both go on alike, because what follows a border depends only on the characters after it.  At these
borders the text is cut into pieces, the pieces are dealt to tasks and encoded, and their ids are put
together.  If an overlap has no common border (one pre-token is longer than it), the scan of the left
chunk goes on through the right one.  A text of one chunk needs no stitching.  Decoding concatenates the
raw bytes of the tokens.

Cases: a null text counts as an empty one, which has no ids.  A row is followed by a number of its own,
so null or repeated ids and repeated rows stay apart.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .encoders import ID, byte_encoder
from .tables import slices, with_long_ids, with_text_ids

CHUNK, OVERLAP = 32_768, 1_024
#: A border this near to the end of a chunk may hang on characters that the chunk does not hold.
UNSURE = 4


@lru_cache(maxsize=4)
def _scanner(pattern: str):
    import regex

    return regex.compile(pattern)


def borders(text: str, start: int, last: bool, pattern: str) -> np.ndarray:
    """Ends of the pre-tokens of a chunk that begins at ``start``, as places in the whole text."""
    ends = np.array([m.end() for m in _scanner(pattern).finditer(text)], np.int64)
    return start + (ends if last else ends[ends <= len(text) - UNSURE])


def stitch(chunks: list[tuple[int, str, np.ndarray]], pattern: str) -> list[str]:
    """Pieces of a text from its chunks (start, text, borders) in order; pieces begin and end at
    pre-token borders and encode on their own."""
    pieces: list[str] = []
    start, text, own = chunks[0]
    for k, (next_start, next_text, next_own) in enumerate(chunks[1:], 2):
        common = np.intersect1d(own[own > next_start], next_own)
        # White space before a cut could join what follows it, so the cut comes after another character.
        cut = next((p for p in common.tolist() if not text[p - start - 1].isspace()), None)
        if cut is None:
            text += next_text[start + len(text) - next_start:]
            own = borders(text, start, k == len(chunks), pattern)
            continue
        pieces.append(text[:cut - start])
        start, text, own = cut, next_text[cut - next_start:], next_own[next_own > cut]
    return [*pieces, text]


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), one row for each row of ``docs``."""
    return with_long_ids(_encode(with_text_ids(docs, "text"), path, pattern, chunk, overlap))


def _encode(rows: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    if chunk <= 2 * overlap:
        raise ValueError("chunks must be longer than two overlaps")
    long = F.char_length("text") > chunk

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path, pattern)
        for b in (part for batch in batches for part in slices(batch)):
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [encoder.encode(t) for t in b["text"]]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, doc_id, text in zip(b["row"], b["doc_id"], b["text"]):
                starts = range(0, len(text), chunk)
                yield pd.DataFrame({"row": row, "doc_id": pd.Series([doc_id] * len(starts), dtype=object),
                                    "start": starts, "last": [s + chunk >= len(text) for s in starts],
                                    "text": [text[s:s + chunk + overlap] for s in starts]})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["borders"] = [borders(t, s, last, pattern).tobytes() for t, s, last in zip(b["text"], b["start"], b["last"])]
            yield b

    def join(chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values("start")
        pieces = stitch([(s, t, np.frombuffer(x, np.int64)) for s, t, x in zip(chunks["start"], chunks["text"], chunks["borders"])], pattern)
        return pd.DataFrame({"row": chunks["row"].iloc[0], "doc_id": pd.Series([chunks["doc_id"].iloc[0]] * len(pieces), dtype=object),
                             "piece": range(len(pieces)), "text": pieces})

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path, pattern)
        for b in batches:
            b["ids"] = [encoder.encode(t) for t in b["text"]]
            yield b[["row", "doc_id", "piece", "ids"]]

    chunks = (rows.where(long).withColumn("row", F.monotonically_increasing_id())
              .mapInPandas(cut, "row long, doc_id string, start long, last boolean, text string")
              .repartition("row", "start")
              .mapInPandas(scan, "row long, doc_id string, start long, last boolean, text string, borders binary"))
    pieces = (chunks.groupBy("row").applyInPandas(join, "row long, doc_id string, piece long, text string")
              .repartition("row", "piece")
              .mapInPandas(ids, "row long, doc_id string, piece long, ids binary"))
    together = (pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"),
                                          F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
                .select("doc_id", F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids")))
    return rows.where(~long).mapInPandas(whole, "doc_id string, ids binary").unionByName(together)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data: the bytes that the ids stand for."""
    def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "data": [encoder.decode(x) for x in b["ids"]]})
    return with_long_ids(with_text_ids(encoded, "ids").mapInPandas(raw, "doc_id string, data binary"))


def report(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path, pattern)
        names = [str(i) for i in range(len(encoder.tokens))]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in (part for batch in batches for part in slices(batch)):
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_tokens": [len(x) // ID.itemsize for x in b["ids"]],
                "ids_sha256": [sha(",".join([names[i] for i in np.frombuffer(x, ID).tolist()]).encode()) for x in b["ids"]],
                "decoded_sha256": [sha(encoder.decode(x)) for x in b["ids"]]})
    return with_long_ids(_encode(with_text_ids(docs, "text"), path, pattern, chunk, overlap).mapInPandas(
        digest, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"))
