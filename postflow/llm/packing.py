"""Best-fit packing of token sequences (operator 6).

Documents longer than a sequence are cut into pieces of the full length; the first piece may be shorter.
Pieces are then packed best-fit, the long ones first, in bulk-synchronous rounds:

* Pieces and gaps are ordered by size.  Sizes are whole numbers up to ``CAPACITY``, so the sorted order
  is held as runs: all pieces of one length, and ranges of sequences with one gap.  The lengths are
  counted by a distributed aggregation; the runs are at most a few thousand, whatever the input.
* A round takes the run of the longest pieces left and sweeps the gaps upwards from their length: the
  successor gap takes as many of them as fit, and what is left of the round goes to the next larger gap.
  Pieces that no gap takes open new sequences.  Then the gaps are updated.
* Many pieces want the same gap; their rank decides.  Each piece has a rank among those of its length,
  given by its task and its place there, and takes the place of that rank, by a join on length and rank.

Cases: a null text counts as an empty one and has the end id alone.  Pieces are told apart by task and
place, so null or repeated ids and repeated rows do no harm.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .encoders import ID, byte_encoder
from .tables import stored, with_long_ids, with_text_ids

CAPACITY = 1024
#: length, ranks [first, first + count) go, ``each`` to a sequence, to sequences from ``sequence`` on,
#: behind ``offset``.
PLAN = "length long, first long, count long, each long, sequence long, offset long"


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False,
           added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with task and place: the rank of the piece
    among those of its length in the task.  Place and task hold for one evaluation: store the rows."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, encoder = TaskContext.get().partitionId(), byte_encoder(path, pattern, added)
        seen: defaultdict[int, int] = defaultdict(int)
        end = np.array([end_id], ID).tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = encoder.encode(text) + end
                n = len(ids) // ID.itemsize
                stop, start, piece = (n - 1) % capacity + 1, 0, 0
                while start < n:
                    part = ids[start * ID.itemsize:stop * ID.itemsize]
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), task, seen[length], part if with_ids else None))
                    seen[length] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"])
            yield out if with_ids else out.drop(columns="ids")
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, task long, place long" + ", ids binary" * with_ids
    return with_long_ids(with_text_ids(docs, "text").mapInPandas(cut, schema))


def best_fit(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The plan (see ``PLAN``) for so many pieces of each length.

    Each entry uses up a run of pieces or a range of equal gaps.  A round adds at most two ranges and a
    range's gap more than halves when it is used, so for 1024 there are some ten thousand entries at most.
    """
    plan = []
    gaps: list[int] = []  # sizes that have ranges, ascending
    ranges: defaultdict[int, list[tuple[int, int]]] = defaultdict(list)  # size -> (first sequence, sequences)
    opened = 0

    def leave(size: int, first: int, count: int) -> None:
        if size and count:
            if size not in ranges:
                insort(gaps, size)
            ranges[size].append((first, count))

    def fill(length: int, rank: int, left: int, size: int, first: int, count: int) -> int:
        """Puts up to ``left`` pieces into a range of gaps; returns how many."""
        each = size // length
        put = min(left, each * count)
        plan.append((length, rank, put, each, first, capacity - size))
        full, rest = divmod(put, each)
        leave(size - each * length, first, full)
        if rest:
            leave(size - rest * length, first + full, 1)
        used = full + bool(rest)
        leave(size, first + used, count - used)
        return put

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        at = bisect_left(gaps, length)
        for size in gaps[at:]:
            if not left:
                break
            taken = ranges.pop(size)
            gaps.remove(size)
            for k, (first, count) in enumerate(taken):
                if not left:
                    for first, count in taken[k:]:
                        leave(size, first, count)
                    break
                put = fill(length, rank, left, size, first, count)
                rank, left = rank + put, left - put
        if left:
            count = -(-left // (capacity // length))
            fill(length, rank, left, capacity, opened, count)
            opened += count
    return plan


def assign(stored_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    runs = stored(stored_pieces.groupBy("task", "length").agg(F.count("*").alias("n")))
    # One row for each length: at most ``capacity``.
    lengths = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = stored_pieces.sparkSession.createDataFrame(best_fit(lengths, capacity) or [], PLAN)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = runs.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = stored_pieces.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    p = F.broadcast(plan.select(F.col("length").alias("p_length"), "first", "count", "each", "sequence", F.col("offset").alias("p_offset")))
    k = F.col("rank") - F.col("first")
    return (ranked.join(p, (F.col("length") == F.col("p_length")) & (k >= 0) & (k < F.col("count")))
            .withColumns({"sequence_id": F.col("sequence") + F.floor(k / F.col("each")),
                          "offset": F.col("p_offset") + k % F.col("each") * F.col("length")})
            .drop("task", "place", "base", "rank", "p_length", "first", "count", "each", "sequence", "p_offset"))


def report(docs: DataFrame, path: str, pattern: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False,
           added: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece; ``added`` are
    the (content, id) of tokens that no merge yields."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return assign(stored(pieces(docs, path, pattern, end_id, capacity, with_ids, added)), capacity).select(*columns)
