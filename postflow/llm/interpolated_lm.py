"""Language-model scoring by deleted interpolation (operator 11).

The model mixes the maximum-likelihood estimates of all orders up to ``order`` with a uniform one:

    P0 = 1 / (V + 1),   Pk = w * f(token | last k - 1 tokens) + (1 - w) * P(k-1)

The weight w of an order depends on how often the context was seen, by powers of two.  One learned text in
``DELETED`` is deleted from the counts; expectation-maximisation finds the weights under which the counts
of the others predict the deleted ones best.  The scores use the counts of all learned texts.

All counts cover the whole corpus and travel packed, not token by token:

1. Texts are packed into blocks of about ``BLOCK`` bytes and stored; deleted texts have blocks of their own.
2. A block asks for the counts of its distinct n-grams: 64-bit keys, sorted, with the block's own counts,
   one row for each range of keys.  Ranges grow with the corpus, so a range always holds about as many keys,
   and a frequent n-gram is in it once a block, not once an occurrence.
3. A range adds up what the blocks have counted and answers each block with the totals, in the order asked.
4. Blocks meet their answers; the tokens' counts are then look-ups in arrays.

Keys are hashes: two of n n-grams share one with a probability of about n * n / 2 ** 63.

Cases: a null, empty or blank text has the end token alone.  Null ids count as learned.  Repeated rows count,
and are scored, as often as they occur.  Without learned texts every token has probability 1 in both scores
(N = V = 0).  Without deleted tokens the weights are ``START``.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .tables import crc_remainder, packed, stored, unpacked, with_long_ids, with_text_ids

FOLDS, HELD = 7, 2
ORDER = 2
DELETED = 16
BLOCK = 4 << 20
#: Bytes of text for one range of keys.
RANGE = 16 << 20
ROUNDS, SETTLED, START = 15, 2e-3, 0.5
#: No white space can be in a word, so these are none.
END, BEFORE = b" ", np.uint64(0x5851F42D4C957F2D)
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
CONTEXTS = 65


# ---- blocks ----

def block(docs: DataFrame, learned: Column, size: int = BLOCK) -> DataFrame:
    """Stored blocks of whole texts: their ids, lengths and learned flags beside one compressed string."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        def closed(deleted):
            ids, texts, flags = held[deleted]
            held[deleted] = [], [], []
            data = b"".join(texts)
            return pd.DataFrame([{
                "ids": ids, "sizes": np.array([len(t) for t in texts], "<i8").tobytes(), "learned": np.array(flags, bool).tobytes(),
                "texts": zstandard.ZstdCompressor(1).compress(data), "bytes": len(data), "n_learned": sum(flags), "deleted": deleted}])
        held, filled = {False: ([], [], []), True: ([], [], [])}, {False: 0, True: 0}
        for b in batches:
            for i, text, learned_, deleted in zip(b["doc_id"], b["text"], b["_lm_learned"], b["_lm_deleted"]):
                deleted = bool(deleted)
                data = text.encode("utf-8", "surrogatepass")
                for part, x in zip(held[deleted], (None if pd.isna(i) else i, data, bool(learned_))):
                    part.append(x)
                filled[deleted] += len(data) + 16
                if filled[deleted] >= size:
                    filled[deleted] = 0
                    yield closed(deleted)
        for deleted in held:
            if held[deleted][0]:
                yield closed(deleted)
    flags = docs.withColumns({"_lm_learned": learned, "_lm_deleted": learned & (F.pmod(F.xxhash64("doc_id"), F.lit(DELETED)) == 0)})
    rows = with_text_ids(flags, "text", "_lm_learned", "_lm_deleted")
    return stored(rows.mapInPandas(pack, "ids array<string>, sizes binary, learned binary, texts binary, bytes long, n_learned long, deleted boolean")
                  .withColumn("part", F.monotonically_increasing_id()))


@dataclass
class Tokens:
    """A block's tokens: where texts start, whether they are learned, and its distinct n-grams."""

    starts: np.ndarray
    learned: np.ndarray  # of each token
    keys: np.ndarray  # distinct, ascending; the two lowest bits tell the order less one
    at: list[np.ndarray]  # of each order: the place among the keys of the n-gram that ends with each token


def tokens(texts: bytes, sizes: bytes, learned: bytes, order: int) -> Tokens:
    import xxhash
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(texts) if texts else b""
    known: dict[bytes, int] = {END: xxhash.xxh64_intdigest(END)}
    each, start, lengths = [], 0, []
    for size in np.frombuffer(sizes, "<i8").tolist():
        words = data[start:start + size].lower().split()  # bytes: only A-Z and ASCII white space count
        start += size
        words.append(END)
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        each.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        lengths.append(len(words))
    word = np.concatenate(each)
    starts = np.cumsum(lengths) - lengths
    grams, gram = [], word
    for k in range(order):
        if k:
            before = np.concatenate([gram[:1], gram[:-1]])
            before[starts] = BEFORE
            gram = (before ^ (before >> np.uint64(32))) * FACTOR + word
            gram = (gram ^ (gram >> np.uint64(29))) * MIX
        grams.append((gram & ~np.uint64(3)) | np.uint64(k))
    keys, at = np.unique(np.concatenate(grams), return_inverse=True)
    return Tokens(starts, np.repeat(np.frombuffer(learned, bool), lengths), keys, np.split(at, order))


# ---- counts, asked for and answered ----

def asked(blocks: DataFrame, order: int, ranges: int) -> DataFrame:
    """One row for each block and range of keys: the keys, and how often learned texts of the block hold them."""
    borders = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, texts, sizes, learned, deleted in zip(b["part"], b["texts"], b["sizes"], b["learned"], b["deleted"]):
                found = tokens(texts, sizes, learned, order)
                counts = np.bincount(np.concatenate([a[found.learned] for a in found.at]), minlength=len(found.keys))
                cuts = [0, *np.searchsorted(found.keys, borders).tolist(), len(found.keys)]
                rows = [(k, part, deleted, i, packed(found.keys[i:j]), packed(counts[i:j]), j - i)
                        for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
                yield pd.DataFrame(rows, columns=["range", "part", "deleted", "first", "keys", "counts", "n"])
    return blocks.select("part", "texts", "sizes", "learned", "deleted").mapInPandas(
        ask, "range int, part long, deleted boolean, first long, keys binary, counts binary, n int")


def answered(asks: DataFrame) -> DataFrame:
    """For each row asked the totals over all blocks (``totals``) and, to blocks of deleted texts, over those
    (``out``); ``tokens``, ``out_tokens`` and ``distinct`` add up over all rows to N, its deleted part and V."""
    def total(b: pd.DataFrame) -> pd.DataFrame:
        sizes = b["n"].to_numpy()
        keys = np.concatenate([unpacked(k, n) for k, n in zip(b["keys"], sizes)])
        counts = np.concatenate([unpacked(c, n) for c, n in zip(b["counts"], sizes)]).astype(np.float64)
        deleted = np.repeat(b["deleted"].to_numpy(bool), sizes)
        distinct, at = np.unique(keys, return_inverse=True)
        totals = np.bincount(at, counts)
        out = np.bincount(at[deleted], counts[deleted], len(distinct))
        words = (distinct & np.uint64(3)) == 0
        ends = np.cumsum(sizes)
        rows = pd.DataFrame({"part": b["part"], "first": b["first"], "n": b["n"],
                             "totals": [packed(totals[at[e - n:e]]) for e, n in zip(ends, sizes)],
                             "out": [packed(out[at[e - n:e]]) if d else None for e, n, d in zip(ends, sizes, b["deleted"])]})
        first = np.arange(len(rows)) == 0
        for name, x in (("tokens", totals[words].sum()), ("out_tokens", out[words].sum()), ("distinct", (totals[words] > 0).sum())):
            rows[name] = np.where(first, int(x), 0)
        return rows
    return stored(asks.groupBy("range").applyInPandas(
        total, "part long, first long, n int, totals binary, out binary, tokens long, out_tokens long, distinct long"))


@dataclass(frozen=True)
class Sums:
    tokens: int
    texts: int
    distinct: int


def _totals(answers: pd.DataFrame, column: str) -> np.ndarray:
    answers = answers.sort_values("first")
    return np.concatenate([unpacked(t, n) for t, n in zip(answers[column], answers["n"])]).astype(np.float64)


def estimates(found: Tokens, counts: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, context classes), one row for each order and one column for each token."""
    f, c = np.zeros((len(found.at), len(found.at[0]))), np.zeros((len(found.at), len(found.at[0])), np.uint8)
    context = np.full(len(found.at[0]), float(sums.tokens))
    for k, at in enumerate(found.at):
        own = counts[at]
        seen = context > 0
        f[k][seen] = own[seen] / context[seen]
        c[k] = np.where(seen, np.frexp(context)[1], 0)  # class b: from 2 ** (b - 1) up to but not at 2 ** b
        context = np.concatenate([own[:1], own[:-1]])
        context[found.starts] = sums.texts
    return f, c


def mixed(f: np.ndarray, c: np.ndarray, weights: np.ndarray, uniform: float) -> list[np.ndarray]:
    """The probabilities by order, from the uniform one up."""
    p = [np.full(f.shape[1], uniform)]
    for k in range(len(f)):
        w = weights[k][c[k]]
        p.append(w * f[k] + (1 - w) * p[-1])
    return p


def expected(f: np.ndarray, c: np.ndarray, n: np.ndarray, weights: np.ndarray, uniform: float) -> np.ndarray:
    """[taken, reached] by order and context class: how many of n tokens each order explains, and how many
    come as far down as it."""
    p, out = mixed(f, c, weights, uniform), np.zeros((2, *weights.shape))
    stay = n / p[-1]
    for k in reversed(range(len(f))):
        w = weights[k][c[k]]
        out[0, k] += np.bincount(c[k], stay * w * f[k], CONTEXTS)
        out[1, k] += np.bincount(c[k], stay * p[k + 1], CONTEXTS)
        stay = stay * (1 - w)
    return out


def renewed(sums: np.ndarray) -> np.ndarray:
    """Weights from [taken, reached]; a class without deleted tokens takes its order's overall weight."""
    taken, reached = sums
    whole = np.where(reached.sum(1) > 0, taken.sum(1) / np.maximum(reached.sum(1), 1e-300), START)
    weights = np.where(reached > 1e-9, taken / np.maximum(reached, 1e-300), whole[:, None])
    return _held(weights)


def _held(weights: np.ndarray) -> np.ndarray:
    weights = np.clip(weights, 1e-4, 1 - 1e-4)
    weights[:, 0] = 0  # an unseen context says nothing
    return weights


def learn(blocks: DataFrame, answers: DataFrame, order: int, rest: Sums, rounds: int = ROUNDS) -> np.ndarray:
    """The weights by expectation-maximisation on the deleted texts; ``rest`` are the sums without them."""
    def sample(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for texts, sizes, learned in zip(b["texts"], b["sizes"], b["learned"]):
            found = tokens(texts, sizes, learned, order)
            f, c = estimates(found, _totals(a, "totals") - _totals(a, "out"), rest)
            _, place, n = np.unique(found.at[-1], return_index=True, return_counts=True)
            rows.append((f[:, place].tobytes(), c[:, place].tobytes(), n.astype("<f8").tobytes()))
        return pd.DataFrame(rows, columns=["f", "c", "n"])
    parts = stored(blocks.where("deleted").select("part", "texts", "sizes", "learned").groupBy("part")
                   .cogroup(answers.where("out is not null").select("part", "first", "n", "totals", "out").groupBy("part"))
                   .applyInPandas(sample, "f binary, c binary, n binary"))
    weights, uniform = _held(np.full((order, CONTEXTS), START)), 1 / (rest.distinct + 1)
    for _ in range(rounds):
        def step(batches: Iterator[pd.DataFrame], now=weights) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, *now.shape))
            for b in batches:
                for f, c, n in zip(b["f"], b["c"], b["n"]):
                    total += expected(np.frombuffer(f).reshape(order, -1), np.frombuffer(c, np.uint8).reshape(order, -1), np.frombuffer(n), now, uniform)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"at": at, "x": total.ravel()[at]})
        total = np.zeros((2, *weights.shape))
        for r in parts.mapInPandas(step, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():  # at most 2 * order * CONTEXTS
            total.ravel()[r["at"]] = r["x"]
        if not total.any():
            break
        new = renewed(total)
        moved = np.abs(new - weights)[total[1] > 0].max()
        weights = new
        if moved < SETTLED:
            break
    return weights


def fit_and_score(docs: DataFrame, learned: Column, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row, learning where ``learned``."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    blocks = block(docs, learned)
    size = blocks.agg(F.sum("bytes").alias("bytes"), F.sum("n_learned").alias("texts"), F.sum(F.when(F.col("deleted"), F.col("n_learned"))).alias("out")).first()
    answers = answered(asked(blocks, order, 1 + (size["bytes"] or 0) // RANGE))
    count = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "out_tokens", "distinct")]).first()
    every = Sums(count["tokens"], size["texts"] or 0, count["distinct"])
    rest = Sums(every.tokens - count["out_tokens"], every.texts - (size["out"] or 0), every.distinct)
    weights, uniform = learn(blocks, answers, order, rest), 1 / (every.distinct + 1)

    def judge(b: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, texts, sizes, learned_ in zip(b["ids"], b["texts"], b["sizes"], b["learned"]):
            found = tokens(texts, sizes, learned_, order)
            counts = _totals(a, "totals")
            own = counts[found.at[0]]
            each = lambda x: np.add.reduceat(x, found.starts)
            out.append(pd.DataFrame({
                "doc_id": list(ids), "n_tokens": each(np.ones(len(own), np.int64)), "n_known": each((own > 0).astype(np.int64)), "train_tokens": every.tokens,
                "base_score": each(np.log10((own + 1) / (every.tokens + every.distinct + 1))),
                "score": each(np.log10(mixed(*estimates(found, counts, every), weights, uniform)[-1]))}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")})
    scored = (blocks.select("part", "ids", "texts", "sizes", "learned").groupBy("part")
              .cogroup(answers.select("part", "first", "n", "totals").groupBy("part"))
              .applyInPandas(judge, "doc_id string, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
    return with_long_ids(scored)


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out and the figures of ``fit_and_score``: one row for each row of ``docs``."""
    held = crc_remainder(F.col("doc_id"), FOLDS) == HELD
    return fit_and_score(docs, ~held, order).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
