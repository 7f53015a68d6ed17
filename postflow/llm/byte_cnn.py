"""Quality classifier: a byte-level convolutional network in numpy (operator 9).

A text is read as bytes.  Learned filters (a byte embedding, then one convolution of ``WIDTH`` bytes)
run over overlapping chunks that cover the whole text, so that no window falls between two chunks; each
filter keeps its maximum over all chunks, and a logistic layer combines the maxima into one probability.
Because the maximum is taken over windows, chunks only bound the memory: any chunk length gives the same
score.

Training reads a bounded sample of whole texts: of each label the first ``per_class`` by the order of a
hash of their ids, and of these as many as ``PER_CLASS_BYTES`` hold (always the first).  No text is cut: a
filter learns from its best window of the whole text, which chunks find as in scoring.

Cases: a null text counts as an empty one; it is padded to one window, like every text shorter than a
window, and so has a score.  Rows with null labels or ids are not learned from.  Without any labels, or
with labels of one kind, all scores are that kind's share (0.5 without labels).  Several labels of one
id: the largest counts.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .tables import crc_remainder

FOLDS = 5
WIDTH, STRIDE = 12, 1
FACES, FILTERS = 8, 24
DECAY = 1e-4
CHUNK = 4_096
PER_CLASS = 1_200
PER_CLASS_BYTES = 32 << 20


@dataclass
class Net:
    """embedding (256, FACES), filters (WIDTH * FACES, FILTERS), their biases, output weights and bias."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @staticmethod
    def fresh(seed: int) -> Net:
        r = np.random.default_rng(seed)
        f = np.float32
        return Net(r.normal(0, 0.5, (256, FACES)).astype(f), r.normal(0, (WIDTH * FACES) ** -0.5, (WIDTH * FACES, FILTERS)).astype(f),
                   np.zeros(FILTERS, f), r.normal(0, FILTERS ** -0.5, FILTERS).astype(f), 0.0)


def padded(data: np.ndarray) -> np.ndarray:
    """The bytes, with blanks behind them so that windows at every STRIDE-th place end with the text."""
    lacking = max(WIDTH - len(data), 0) or -(len(data) - WIDTH) % STRIDE
    return np.concatenate([data, np.full(lacking, 32, np.uint8)])


def windows(data: np.ndarray) -> np.ndarray:
    """All windows of WIDTH bytes at every STRIDE-th place."""
    return np.lib.stride_tricks.sliding_window_view(padded(data), WIDTH)[::STRIDE]


def responses(net: Net, data: np.ndarray) -> np.ndarray:
    """Of every filter to every window."""
    faces = net.embedding[padded(data)].reshape(-1)
    seen = np.lib.stride_tricks.sliding_window_view(faces, WIDTH * FACES)[::STRIDE * FACES]
    return np.ascontiguousarray(seen) @ net.filters


def chunks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Overlapping pieces of a text, so that every window lies in some piece."""
    step = CHUNK - CHUNK % STRIDE
    for start in range(0, max(1, len(data)), step):
        # A chunk reaches into the next one by a window.
        piece = data[start:start + step + WIDTH - STRIDE]
        if start and len(piece) <= WIDTH - STRIDE:
            break
        yield piece


def peaks(net: Net, data: np.ndarray) -> np.ndarray:
    """Each filter's maximum over the whole text, chunk by chunk."""
    best = np.full(FILTERS, -np.inf, np.float32)
    for piece in chunks(data):
        np.maximum(best, responses(net, piece).max(0), out=best)
    return best


def best_windows(net: Net, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's maximum over the whole text and the bytes of the first window that has it."""
    best, won = np.full(FILTERS, -np.inf, np.float32), np.zeros((FILTERS, WIDTH), np.uint8)
    for piece in chunks(data):
        z = responses(net, piece)
        at = z.argmax(0)
        top = z[at, np.arange(FILTERS)]
        better = top > best
        best[better], won[better] = top[better], windows(piece)[at[better]]
    return best, won


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score(net: Net, text: str) -> float:
    held = np.maximum(peaks(net, np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)) + net.bias, 0)
    return float(_sigmoid(held @ net.out + net.out_bias))


class _Adam:
    def __init__(self, net: Net, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in vars(net).items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            m, v = self.moments[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.moments[k] = m, v
            move = self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)
            setattr(self.net, k, getattr(self.net, k) - move.astype(np.float32) if k != "out_bias" else float(self.net.out_bias - move))


def gradients(net: Net, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean logistic loss (and the decay of the output weights) over whole texts."""
    found = [best_windows(net, t) for t in texts]
    tops, won = np.stack([f[0] for f in found]), np.stack([f[1] for f in found])
    held = np.maximum(tops + net.bias, 0)
    slope = ((_sigmoid(held @ net.out + net.out_bias) - labels) * weight / len(texts)).astype(np.float32)
    back = slope[:, None] * net.out * (held > 0)
    seen = net.embedding[won].reshape(len(texts), FILTERS, -1)
    to_bytes = (back[:, :, None] * net.filters.T).reshape(-1, FACES)
    faces = np.zeros_like(net.embedding)
    np.add.at(faces, won.reshape(-1), to_bytes)
    return {"embedding": faces, "filters": np.einsum("tf,tfw->wf", back, seen), "bias": back.sum(0),
            "out": held.T @ slope + DECAY * net.out, "out_bias": np.float32(slope.sum())}


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 9) -> Net:
    """Fits a net to the bytes of whole texts, by Adam on the weighted logistic loss."""
    net, r = Net.fresh(seed), np.random.default_rng(seed)
    adam = _Adam(net, rate)
    share = np.clip(labels.mean(), 0.05, 0.95)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for epoch in range(epochs):
        adam.rate = rate * (1 - epoch / epochs)
        order = r.permutation(len(texts))
        for k in range(0, len(order), batch):
            chosen = order[k:k + batch]
            adam.step(gradients(net, [texts[x] for x in chosen], labels[chosen], weight[chosen]))
    return net


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """doc_id, text, quality of at most ``per_class`` labelled rows of each kind outside fold 0."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
             .where(crc_remainder(F.col("doc_id"), FOLDS) != 0))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Labels of rows that docs no longer holds are passed over; ids alone decide the sample.
    known = known.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    kinds = [known.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = kinds[0].unionByName(kinds[1])
    # At most 2 * per_class ids.
    whole = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("text").alias("text"))
    # At most per_class rows a kind, so that one task may add them up.
    w = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    held = F.sum(F.octet_length("text").cast("long"))
    return whole.withColumn("_before", F.coalesce(held.over(w), F.lit(0))) \
        .where((F.col("_before") == 0) | (F.col("_before") + F.octet_length("text") <= PER_CLASS_BYTES)).drop("_before")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Net | float:
    """A net, or one score for all where there is nothing to learn."""
    # At most 2 * per_class texts of 2 * PER_CLASS_BYTES (and, if longer, the first text of a kind).
    rows = sample(docs, labels, per_class).select("quality", F.encode("text", "utf-8").alias("data"), "doc_id") \
        .orderBy("doc_id").collect()
    kinds = {r["quality"] for r in rows}
    if len(kinds) < 2:
        return float(kinds.pop()) if kinds else 0.5
    return train([np.frombuffer(bytes(r["data"]), np.uint8) for r in rows], np.array([r["quality"] for r in rows], np.float32))


def scored(docs: DataFrame, net: Net | float, column: str = "_cnn_score") -> DataFrame:
    """Adds the score of every whole text."""
    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if isinstance(net, float):
            return pd.Series(net, index=texts.index)
        return pd.Series([score(net, t) for t in texts.fillna("")], index=texts.index, dtype=float)
    return docs.withColumn(column, of(F.col("text")))


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels, per_class), "score")
    return rows.select("doc_id", (crc_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None, threshold: float = 0.3,
         per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, with its columns, that score at least ``threshold``.

    ``learn_from`` holds the texts to learn from where ``docs`` has been filtered and may lack one kind.
    """
    rows = scored(docs, fit(docs if learn_from is None else learn_from, labels, per_class))
    return rows.where(F.col("_cnn_score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
