"""Connected components, and groups split into pairs of bounded blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v: long) can reach.

    Alternates large-star and small-star steps; each is a partial aggregation and a join, written to
    the shared folder.  Ends when a round changes no edge.
    """
    def lighter(df: DataFrame) -> DataFrame:
        return df.where("u <> v").distinct()

    def large(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return lighter(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return lighter(moved.unionByName(least.select("u", F.col("m").alias("v"))))

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())

    current = stored(lighter(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    seen = mark(current)
    while seen[0]:
        current = stored(small(large(current)))
        now = mark(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges (u, v)."""
    label = np.arange(n)
    while len(u):
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def in_blocks(rows: DataFrame, keys: list[str], by: str, limit: int) -> DataFrame:
    """Splits the groups of ``keys`` with more than ``limit`` rows so that no task meets a whole one.

    A group of c rows falls into ceil(c / limit) blocks by a hash of ``by``; a row goes to every pair
    of blocks (``_i`` <= ``_j``) that holds its own (``_own``), so each pair of rows meets once: in the
    pair of their blocks.  Groups within the limit stay whole, as the pair (0, 0).
    """
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_c")).where(F.col("_c") > limit)
    hot = hot.withColumn("_blocks", F.ceil(F.col("_c") / limit).cast("int")).drop("_c")
    own = F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")
    return (rows.join(hot, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
            .withColumn("_own", own)
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
            .drop("_blocks", "_other"))
