"""Importance resampling towards a target distribution (operator 12).

Runs of words fall into hashed buckets.  A bucket's gain is the logarithm of how much more often the target
holds it than the corpus; a text's weight is the mean gain of its features, read from an array.  Adding
noise drawn from the id (Gumbel) and taking the highest scores draws without replacement, in proportion
to the weights.

The cutoff is found by weighted medians of medians: each task tells the median of the keys that are still
open, and how many they are; the median of these medians, weighted by those numbers, has at least a quarter
of the open keys on either side, so each round settles that many.  A round is one pass, which counts and
halves both sides at once; the table is rewritten when three quarters of it are settled.  Then the winners
alone are sorted.

Keys are (score descending, null ids last, doc_id, row), so no two are equal and any number can be drawn.

Cases: a null text has no words, weight 0, and is not drawn, like every text of fewer than ``least`` words.
Null ids draw noise as the id ``null``.  Repeated rows have equal scores and ranks one after another.  An empty
target leaves each gain to the corpus alone.  Where nothing can be drawn all ranks are null.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .tables import slices, stored

# Fixed values of the draw.
BUCKETS = 10_000
RUN = 1
LEAST = 20
DRAWN_PCT = 10
SEED = "2024"
#: Open keys that one task may sort at the end.
OPEN = 4_096
#: Lower-cases A-Z; every ASCII character that is no letter or digit parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
KEY = ["_down", "_last", "_id", "_row"]


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def features(text: str, run: int, buckets: int, known: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """(bucket of every feature, number of words); ``known`` remembers the buckets of single words."""
    own = words(text)
    for w in set(own).difference(known):
        known[w] = zlib.crc32(w) % buckets
    found = [known[w] for w in own]
    for n in range(2, run + 1):
        found += [zlib.crc32(b" ".join(own[k:k + n])) % buckets for k in range(len(own) - n + 1)]
    return np.array(found, np.int64), len(own)


def _fresh(known: dict) -> dict:
    return known if len(known) < 500_000 else {}


def bucket_counts(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: each task adds up its own."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, known = np.zeros(buckets, np.int64), {}
        for b in batches:
            for text in b["text"]:
                found, _ = features(text, run, buckets, known)
                if len(found) > buckets // 8:
                    total += np.bincount(found, minlength=buckets)
                else:
                    np.add.at(total, found, 1)
                known = _fresh(known)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of each bucket's share in the target over its share in the source."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: str, seed: str = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: str = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, n_features, n_words, weight, score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one figure a bucket

    @F.pandas_udf("struct<n_features:long,n_words:long,weight:long,score:long>")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for texts, ids in parts:
            out = []
            for b in slices(pd.DataFrame({"t": texts, "i": ids})):
                for text, i in zip(b["t"], b["i"]):
                    found, n_words = features(text, run, len(shared.value), known)
                    weight = int(shared.value[found].sum()) // len(found) if len(found) else 0
                    out.append((len(found), n_words, weight, weight + noise(i, seed)))
                known = _fresh(known)
            yield pd.DataFrame(out, columns=["n_features", "n_words", "weight", "score"])
    found = score(F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return docs.select("doc_id", *keep, found.alias("s")).select("doc_id", *keep, "s.*")


# ---- selection ----

def weighted_median(keys: list[tuple], sizes: list[int]) -> tuple:
    """The first key in order with at least half of all sizes up to it."""
    half, done = sum(sizes) / 2, 0
    for key, size in sorted(zip(keys, sizes)):
        done += size
        if done >= half:
            return key
    raise ValueError("nothing to choose from")


def _sorted(b: pd.DataFrame) -> np.ndarray:
    """The keys of a frame, ascending, one in each row."""
    rows = b[KEY].to_numpy(np.int64)
    return rows[np.lexsort(rows.T[::-1])]


def _place(rows: np.ndarray, key: tuple | None) -> int:
    """How many of the sorted rows are smaller than the key."""
    lo, hi = 0, len(rows)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if tuple(rows[mid].tolist()) < key else (lo, mid)
    return lo


def _within(keys: DataFrame, low: tuple | None, high: tuple | None) -> DataFrame:
    """Rows that can still lie between both keys, by the first column; the tasks look at the others."""
    if low is not None:
        keys = keys.where(F.col(KEY[0]) >= low[0])
    return keys if high is None else keys.where(F.col(KEY[0]) <= high[0])


def _look(keys: DataFrame, low: tuple | None, pivot: tuple | None, high: tuple | None) -> list:
    """Each task's number and median of open keys below (side 0) and above (side 1) the pivot, and whether
    it holds the pivot; without a pivot all open keys are on side 0."""
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = _sorted(pd.concat(frames))
        rows = rows[_place(rows, low) if low else 0:_place(rows, high) if high else len(rows)]
        if low and len(rows) and tuple(rows[0].tolist()) == low:
            rows = rows[1:]
        at = _place(rows, pivot) if pivot else len(rows)
        hit = int(at < len(rows) and pivot is not None and tuple(rows[at].tolist()) == pivot)
        out = [(side, len(x), hit if not side else 0, *(x[(len(x) - 1) // 2].tolist() if len(x) else [0] * len(KEY)))
               for side, x in enumerate((rows[:at], rows[at + hit:])) if len(x) or (hit and not side)]
        yield pd.DataFrame(out, columns=["side", "n", "hit", *KEY])
    return _within(keys, low, high).mapInPandas(look, f"side int, n long, hit int, {', '.join(k + ' long' for k in KEY)}").collect()


def cutoff(keys: DataFrame, k: int, left: int = OPEN) -> tuple:
    """The k-th smallest key of a stored table with the columns ``KEY``."""
    low = high = None
    side = [r for r in _look(keys, None, None, None) if r["n"]]
    stored_rows = sum(r["n"] for r in side)
    while True:
        remaining = sum(r["n"] for r in side)
        if remaining <= left:
            rows = sorted(tuple(r[c] for c in KEY) for r in _within(keys, low, high).collect())
            rows = [r for r in rows if (low is None or r > low) and (high is None or r < high)]
            return rows[k - 1]
        if 4 * remaining <= stored_rows:
            keys, stored_rows = stored(_within(keys, low, high)), remaining
        pivot = weighted_median([tuple(r[c] for c in KEY) for r in side], [r["n"] for r in side])
        found = _look(keys, low, pivot, high)
        below = sum(r["n"] for r in found if r["side"] == 0)
        if k <= below:
            high, side = pivot, [r for r in found if r["side"] == 0 and r["n"]]
        elif k == below + 1:
            return pivot
        else:
            low, k, side = pivot, k - below - 1, [r for r in found if r["side"] == 1]


def drawn(rows: DataFrame, pct: int = DRAWN_PCT, least: int = LEAST, left: int = OPEN) -> DataFrame:
    """Adds ``rank``: 1, 2, 3 … by falling score for the highest ``pct`` percent of the rows of at least
    ``least`` words, null for all others.  ``rows`` are those of ``scored``."""
    kept = stored(rows.withColumns({"_down": -F.col("score"), "_last": F.col("doc_id").isNull().cast("long"),
                                    "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_row": F.monotonically_increasing_id()}))
    keys = kept.where(F.col("n_words") >= least).select(*KEY)
    k = pct * keys.count() // 100
    if not k:
        return kept.withColumn("rank", F.lit(None).cast("long")).drop(*KEY)
    last = cutoff(keys, k, left)
    order = F.struct(*KEY)
    wins = (F.col("n_words") >= least) & (order <= F.struct(*[F.lit(x).cast("long").alias(c) for x, c in zip(last, KEY)]))
    sorted_ = stored(kept.where(wins).repartitionByRange(*KEY).withColumn("_part", F.spark_partition_id()))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*KEY))
    ranked = sorted_.join(before, "_part").withColumn("rank", (F.col("_before") + inside).cast("long")).drop("_part", "_before")
    losers = kept.where(~wins).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(losers).drop(*KEY)


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row for each row of ``docs``."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return drawn(scored(docs.select("doc_id", "text"), gain)).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, pct: int = DRAWN_PCT, least: int = LEAST, run: int = RUN, buckets: int = BUCKETS,
             seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, with its columns, that are drawn.  Rows are told apart by task and place, so
    ``docs`` is a stored table, which deals them alike each time."""
    gain = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets))
    numbered = docs.withColumn("_ir_row", F.monotonically_increasing_id())
    ranked = drawn(scored(numbered, gain, run, seed, ("_ir_row",)), pct, least)
    won = ranked.where(F.col("rank").isNotNull()).select("_ir_row")
    return numbered.join(won, "_ir_row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE crc_step(i, k, c) AS (
    SELECT range::UBIGINT, 0, range::UBIGINT FROM range(256)
    UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
          UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
words AS MATERIALIZED (
    SELECT side, r, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM words),
bytes AS (SELECT w, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::UBIGINT) AS b FROM vocabulary),
bucket_of AS MATERIALIZED (
    SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
    FROM bytes, crc_table),
features AS MATERIALIZED (SELECT side, r, bucket, count(*) AS n FROM words JOIN bucket_of USING (w) GROUP BY ALL),
sums AS (SELECT b.range AS bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t
         FROM range(10000) b LEFT JOIN features f ON f.bucket = b.range GROUP BY b.range),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE)
                                        / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS g FROM sums),
weighed AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS total FROM features JOIN gain USING (bucket) WHERE side = 0 GROUP BY r),
hashed AS (SELECT r, doc_id, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM texts WHERE side = 0),
rows AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features,
                CASE WHEN n_features IS NULL THEN 0
                     ELSE (total - (total % n_features + n_features) % n_features) // n_features END AS weight, h
         FROM hashed LEFT JOIN weighed USING (r)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM rows),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""
