"""Language identification (operator 10).

Sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams, trained with
follow-the-regularised-leader (FTRL-proximal, elastic net), then calibrated by one temperature on rows
that the training has not seen.

Document frequencies are counted over all learnable documents: each task sums up its own and the sums meet
in one aggregation by n-gram.  The regression reads a bounded sample: of each language the first
``per_language`` ids by the order of a hash, or an equal share of ``SAMPLE`` texts where the languages are too
many for that (at least one of each).  One pass chooses for all languages and one collects their n-grams.
The regression takes half a megabyte of the driver for each language.  Scoring reads every text whole.

Cases: a null text, one without a letter, and every text where nothing could be learned get ``und`` with
score 0.  Rows are judged on their own, so null or repeated ids do no harm; null ids count as held out.
Of the texts that share an id and a language the largest is learned from.
With one known language every other text gets it, with score 1.  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .tables import crc_remainder

FOLDS = 5
SIZES = (1, 2, 3)
BUCKETS = 1 << 15
PER_LANGUAGE = 600
SAMPLE = 12_000
#: Texts longer than this are counted part by part, which bounds the memory.
PART = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of a text's n-grams, lower case, every run of digits or blanks as one sign."""
    text = re.sub(r"\d+", "0", re.sub(r"\s+", " ", f" {text.lower()} "))
    total = np.zeros(BUCKETS, np.int64) if len(text) > 4096 else None
    found = []
    for start in range(0, len(text), PART):
        c = np.frombuffer(text[start:start + PART + max(SIZES) - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        here = min(PART, len(text) - start)
        code = np.zeros(len(c), np.uint32)
        for n in range(1, max(SIZES) + 1):
            if n > len(c):
                break
            code = code[:len(c) - n + 1] * np.uint32(0x01000193) ^ c[n - 1:]
            if n in SIZES:
                mixed = (code[:here] + np.uint32(n)) * np.uint32(0x9E3779B1)
                found.append((mixed >> np.uint32(17)).astype(np.int64))
        if total is not None:
            total += np.bincount(np.concatenate(found), minlength=BUCKETS)
            found = []
    if total is None:
        return np.unique(np.concatenate(found), return_counts=True)
    at = np.flatnonzero(total)
    return at, total[at]


def weights(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their TF-IDF weights (logarithmic frequency, unit length)."""
    at, n = counts(text)
    w = (1 + np.log(n)) * idf[at]
    return at, w / max(np.linalg.norm(w), 1e-12)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, df) over every row of ``docs``; bucket -1 holds the number of rows."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b[text]:
                df[counts(t)[0]] += 1
            n += len(b)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(at, -1), "df": np.append(df[at], n)})
    return docs.select(text).mapInPandas(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df"))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not LETTER.search(text):
            return UNKNOWN, 0.0
        at, w = weights(text, self.idf)
        p = _softmax((w @ self.weight[at] + self.bias) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, languages: int, epochs: int = 4, alpha: float = 0.5,
          beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with an elastic net; the bias is not penalised."""
    z, n = np.zeros((BUCKETS + 1, languages)), np.zeros((BUCKETS + 1, languages))
    penalty = np.full((BUCKETS + 1, 1), l1)
    penalty[-1] = 0

    def leader(at):
        s, q, p = z[at], n[at], penalty[at]
        return np.where(np.abs(s) <= p, 0, -(s - np.sign(s) * p) / ((beta + np.sqrt(q)) / alpha + l2))

    r = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in r.permutation(len(rows)):
            at, x = np.append(rows[i][0], BUCKETS), np.append(rows[i][1], 1.0)
            w = leader(at)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            q = n[at]
            z[at] += g - (np.sqrt(q + g * g) - np.sqrt(q)) / alpha * w
            n[at] = q + g * g
    w = leader(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def temperature(z: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(_softmax(z / np.exp(t))[np.arange(len(z)), labels], 1e-12)).mean()
    lo, hi, g = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from text and non-null lang of the rows outside fold 0."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_remainder(F.col("doc_id"), FOLDS) != 0))
    df = np.zeros(BUCKETS + 1)
    for r in document_frequencies(known).collect():  # at most BUCKETS + 1 rows
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect())
    place = {lang: k for k, lang in enumerate(languages)}
    share = min(per_language, max(1, SAMPLE // max(1, len(languages))))
    # Spark applies the limit of a group before it shuffles, so one language with all rows is no large group.
    chosen = known.select("lang", "doc_id").distinct().withColumn(
        "_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))) \
        .where(F.col("_n") <= share).drop("_n")
    # At most SAMPLE ids, or one for each language.
    texts = known.join(F.broadcast(chosen), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.max("text").alias("text"))

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [counts(t) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "doc_id": b["doc_id"], "at": [a.astype("<i4").tobytes() for a, _ in found],
                                "n": [n.astype("<i4").tobytes() for _, n in found]})
    rows, labels, later = [], [], []
    sampled = texts.mapInPandas(grams, "lang string, doc_id long, at binary, n binary").collect()
    for r in sorted(sampled, key=lambda r: (place[r["lang"]], r["doc_id"])):
        at, n = (np.frombuffer(bytes(x), "<i4").astype(np.int64) for x in (r["at"], r["n"]))
        w = (1 + np.log(n)) * idf[at]
        rows.append((at, w / max(np.linalg.norm(w), 1e-12)))
        labels.append(place[r["lang"]])
        later.append(len(rows) % 5 == 0)
    if len(languages) < 2:
        return Model(languages, idf, np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)), 1.0)
    y, later = np.array(labels), np.array(later)
    weight, bias = train([x for x, held in zip(rows, later) if not held], y[~later], len(languages))
    z = np.array([w @ weight[at] + bias for (at, w), held in zip(rows, later) if held])
    return Model(languages, idf, weight, bias, temperature(z, y[later]) if len(z) else 1.0)


def report(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``."""
    model = fit(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * (languages + 1) figures

    @F.pandas_udf("struct<lang:string,score:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(None if t is None or t is pd.NA else t) for t in texts]
        return pd.DataFrame(found, columns=["lang", "score"])
    return docs.select("doc_id", of(F.col("text")).alias("p")).select(
        "doc_id", (crc_remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
        F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
