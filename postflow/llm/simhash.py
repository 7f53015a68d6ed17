"""SimHash near-dedup with pivot distance tables (operator 5).

Every text gets a 64-bit fingerprint of its 3-word shingles.  ``REFERENCES`` fixed reference
fingerprints (pivots) serve as coordinates: the table holds the Hamming distance of each distinct
fingerprint to each reference, kept apart for six bit blocks, so that the sum over the blocks is the
distance to the whole reference.

By the triangle inequality two fingerprints within k bits differ by at most k in every coordinate, and
the differences of the blocks add up to at most k.  Distances of evenly spread fingerprints crowd around
32, so whole coordinates alone would leave far too many pairs to look at.  But with k = 3 differing bits
at least three of the six blocks have none, and there all coordinates are equal.  The table is therefore
joined to itself on the coordinates of every three blocks (20 keys).  Pairs that meet are discarded by
their largest coordinate difference over the whole references, and the survivors are verified by their
differing bits.

Equal fingerprints are one row of the table, so groups of exact copies cost nothing.  Keys that many
fingerprints share are split into pairs of blocks, and what leaves a block is a spanning forest of its
links, not all pairs.

Cases: a null or blank text has the fingerprint zero and links like any other.  Null ids are never the
smallest of a group unless all are null.  Repeated rows have the same fingerprint and are one group.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components, forest, in_blocks
from .tables import stored

SHINGLE = 3
SEED = 42
NEAR = 3
#: Widths of the bit blocks; with NEAR differing bits, len(WIDTHS) - NEAR blocks have none.
WIDTHS = (11, 11, 11, 11, 10, 10)
MASKS = [((1 << w) - 1) << sum(WIDTHS[:k]) for k, w in enumerate(WIDTHS)]
#: Pivots, drawn by a fixed seed.  A block's distance to one is at most 11, half a byte.
REFERENCES = np.random.default_rng(SEED).integers(0, 1 << 64, 15, dtype=np.uint64)
IN_BLOCK = 1_024


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str) -> int:
    """Bit b is set if it is set in more than half the XXH64 values of the text's shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.append(0, ends[:-1] + 1)
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[:1 - SHINGLE].tolist(), ends[SHINGLE - 1:].tolist())]
    each = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(each), 8192):
        ones += np.unpackbits(each[k:k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(each), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and fp, the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t)) for t in texts.fillna("")], dtype="int64")
    return docs.select(*keep, find(F.col("text")).alias("fp"))


def block_coordinates(fp: Column, mask: int) -> Column:
    """Distances to all references within a bit block, four bits each."""
    terms = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(r)))).bitwiseAND(F.lit(_signed(mask)))).cast("long"), 4 * k)
             for k, r in enumerate(REFERENCES)]
    return reduce(Column.bitwiseOR, terms)


def links(prints: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of all links between distinct fingerprints ``fp`` of NEAR or fewer
    differing bits."""
    distinct = stored(prints.select("fp").distinct())
    table = distinct.select("fp", *[block_coordinates(F.col("fp"), m).alias(f"b{k}") for k, m in enumerate(MASKS)])
    keys = [F.xxhash64(F.lit(n), *[F.col(f"b{k}") for k in chosen])
            for n, chosen in enumerate(combinations(range(len(MASKS)), len(MASKS) - NEAR))]
    rows = stored(table.select("fp", F.explode(F.array(*keys)).alias("key")))
    met = (in_blocks(rows, ["key"], "fp", IN_BLOCK).groupBy("key", "_i", "_j")
           .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = b["fps"].map(len).to_numpy()
            us, vs = [], []
            if (sizes == 2).any():
                two = np.stack(b["fps"][sizes == 2].to_list()).astype(np.int64).view(np.uint64)
                coordinates = np.bitwise_count(two[:, :, None] ^ REFERENCES).astype(np.int8)
                two = two[np.abs(coordinates[:, 0] - coordinates[:, 1]).max(1) <= NEAR]
                two = two[np.bitwise_count(two[:, 0] ^ two[:, 1]) <= NEAR]
                us.append(two[:, 0]), vs.append(two[:, 1])
            for fps in b["fps"][sizes > 2]:
                f = np.asarray(fps, np.int64).view(np.uint64)
                coordinates = np.bitwise_count(f[:, None] ^ REFERENCES).astype(np.int8)
                left, right = [], []
                for k in range(0, len(f), 256):
                    differ = np.zeros((len(f[k:k + 256]), len(f)), np.int8)
                    for c in range(len(REFERENCES)):
                        np.maximum(differ, np.abs(coordinates[k:k + 256, None, c] - coordinates[None, :, c]), out=differ)
                    i, j = np.nonzero(differ <= NEAR)
                    i += k
                    i, j = i[i < j], j[i < j]
                    near = np.bitwise_count(f[i] ^ f[j]) <= NEAR
                    left.append(i[near]), right.append(j[near])
                root = forest(np.concatenate(left), np.concatenate(right), len(f))
                moved = root != np.arange(len(f))
                us.append(f[moved]), vs.append(f[root[moved]])
            if us:
                yield pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})
    return met.select("fps").mapInPandas(verify, "u long, v long").distinct()


def groups(prints: DataFrame) -> DataFrame:
    """(fp, group): the linked group of each distinct fingerprint."""
    found = components(links(prints)).withColumnRenamed("node", "fp")
    return (prints.select("fp").distinct().join(found, "fp", "left")
            .select("fp", F.coalesce("component", "fp").alias("group")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    prints = stored(fingerprints(docs, "doc_id"))
    member = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups(prints), "fp")
    smallest = member.groupBy("group").agg(F.min("least").alias("component_id"))
    of = member.select("fp", "group").join(smallest, "group").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null ids last)."""
    numbered = docs.withColumn("_sh_row", F.monotonically_increasing_id())
    prints = stored(fingerprints(numbered, "_sh_row", "doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("_sh_row").alias("row")))
    least = prints.groupBy("fp").agg(first.alias("least")).join(groups(prints), "fp")
    chosen = least.groupBy("group").agg(F.min("least").alias("least")).select(F.col("least.row").alias("_sh_row"))
    return numbered.join(chosen, "_sh_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
