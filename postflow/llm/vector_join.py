"""Embedding near-dedup by a subspace pigeonhole join (operator 8).

Unit vectors with a cosine of at least t are at a squared distance of at most 2 - 2 t.  All vectors are
turned by one fixed rotation, which spreads distances evenly, and split into blocks of neighbouring
coordinates.  If a pair were over its share of the squared distance (in proportion to the block's
width) in every block, it would be over the whole; so it is within the share in some block, and a range
join of each block under its share finds every pair.

The range join of a block runs on a grid over its first coordinates: a vector goes to every cell that the
ball of its share touches.  A pair is taken in the home cell of its smaller member and in the first
block that finds it, so it counts once.  Each candidate is verified by its cosine in double precision
within the cell: no pairs are shuffled.  The grid uses as many coordinates as the largest label needs for
cells of about ``CELL`` vectors, and cells with more are split into pairs of bounded blocks.

Equal vectors of a label are one class, whose members count but are never compared; what leaves a cell are
link counts and a spanning forest.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and those without a
label, link with nothing and are groups of their own.  Vectors of different lengths do not link.  Rows
are told apart by themselves, so repeated vec_ids count as separate vectors; null ids are never smallest
unless all are null.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .graph import components, forest, in_blocks
from .tables import stored

COSINE = 0.98
BLOCKS = 4
CELL = 1_024
IN_BLOCK = 4_096
SEED = 8


@lru_cache(maxsize=8)
def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def turned(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; rounded so that every task sees the same figures."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.round(unit @ rotation(vectors.shape[1]), 9)


def cuts(width: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """Bounds of the blocks; narrow vectors have fewer."""
    edges = np.linspace(0, width, min(blocks, width) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:]))


def share(width: int, lo: int, hi: int, cosine: float) -> float:
    """The block's part of the squared distance, with room for rounding."""
    return (2 - 2 * cosine) * (hi - lo) / width * (1 + 1e-6) + 1e-8


def touched(points: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cells): the cells, 2 * radius wide, that a ball round each point touches."""
    w = 2 * radius
    home = np.floor(points / w)
    side = np.where(points - home * w < radius, -1, 1)  # the nearer neighbour; the other one is out of reach
    gap = np.where(side < 0, points - home * w, (home + 1) * w - points)
    for move in product((0, 1), repeat=points.shape[1]):
        m = np.array(move)
        rows = np.flatnonzero((gap ** 2 * m).sum(1) <= radius ** 2)
        yield rows, (home + side * m)[rows].astype(np.int64)


def grid_width(largest: int) -> int:
    """Coordinates that split so many vectors to cells of about ``CELL``, at three cells for each."""
    width = 0
    while largest > CELL * 3 ** width and width < 8:
        width += 1
    return width


def _cells(width: int, cosine: float):
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, part in b.groupby(b["embedding"].map(len)):
                t = turned(np.array(part["embedding"].to_list(), np.float64))
                for block, (lo, hi) in enumerate(cuts(size)):
                    radius = np.sqrt(share(size, lo, hi, cosine))
                    for rows, cells in touched(t[:, lo:min(hi, lo + width)], radius):
                        if len(rows):
                            yield pd.DataFrame({"label": part["label"].to_numpy()[rows], "size": size, "block": block,
                                                "cell": [c.tobytes() for c in cells], "cid": part["cid"].to_numpy()[rows],
                                                "n": part["n"].to_numpy()[rows], "embedding": part["embedding"].to_numpy()[rows]})
    return deal


def _compare(width: int, cosine: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid").drop_duplicates("cid")
        cid, n, own = rows["cid"].to_numpy(), rows["n"].to_numpy(), rows["_own"].to_numpy()
        size, block = int(rows["size"].iloc[0]), int(rows["block"].iloc[0])
        halves = int(rows["_i"].iloc[0]) != int(rows["_j"].iloc[0])
        vectors = np.array(rows["embedding"].to_list(), np.float64)
        norms = np.linalg.norm(vectors, axis=1)
        t = turned(vectors)
        bounds = cuts(size)
        limits = np.array([share(size, lo, hi, cosine) for lo, hi in bounds])
        lo, hi = bounds[block]
        radius = np.sqrt(limits[block])
        cell = np.frombuffer(rows["cell"].iloc[0], np.int64)
        at_home = (np.floor(t[:, lo:min(hi, lo + width)] / (2 * radius)) == cell).all(1)
        squares = (t[:, lo:hi] ** 2).sum(1)
        us, vs = [], []
        for k in range(0, len(t), 512):
            near = squares[k:k + 512, None] + squares - 2 * t[k:k + 512, lo:hi] @ t[:, lo:hi].T <= limits[block] + 1e-7
            i, j = np.nonzero(near & at_home[k:k + 512, None])
            i += k
            keep = (i < j) & ((own[i] != own[j]) if halves else True)
            us.append(i[keep]), vs.append(j[keep])
        u, v = np.concatenate(us), np.concatenate(vs)
        within = np.stack([((t[u, a:b] - t[v, a:b]) ** 2).sum(1) for a, b in bounds]) <= limits[:, None]
        linked = (within[block] & ~within[:block].any(0)
                  & ((vectors[u] * vectors[v]).sum(1) / (norms[u] * norms[v]) >= cosine))
        u, v = u[linked], v[linked]
        count = np.bincount(u, n[v], len(t)) + np.bincount(v, n[u], len(t))
        root = forest(u, v, len(t))
        some = count > 0
        return pd.DataFrame({"cid": cid[some], "links": count[some].astype(np.int64), "root": cid[root[some]]})
    return compare


def report(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    e = F.col("embedding")
    rows = vectors.select("vec_id", "embedding", "label")
    whole = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    valid = rows.where(whole & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull())
    other = rows.where(~F.coalesce(whole & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False)))
    classes = stored(valid.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
                     .withColumn("cid", F.monotonically_increasing_id()))
    # One row for each label would do; the largest label sizes the grid.
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    width, kinds = grid_width(largest), dict(rows.dtypes)
    cells = stored(classes.select("label", "embedding", "n", "cid").mapInPandas(
        _cells(width, cosine), f"label {kinds['label']}, size int, block int, cell binary, cid long, n long, embedding {kinds['embedding']}"))
    keys = ["label", "size", "block", "cell"]
    found = stored(in_blocks(cells, keys, "cid", IN_BLOCK).groupBy(*keys, "_i", "_j").applyInPandas(
        _compare(width, cosine), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    stars = components(found.select(F.col("cid").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "cid")
    known = (classes.join(links, "cid", "left").join(stars, "cid", "left")
             .withColumn("component", F.coalesce("component", "cid")))
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "component").select(
        "label", "embedding", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    judged = valid.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return judged.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
