"""Quality rules as weak supervision (operator 4).

Each rule votes +1 (good), -1 (bad) or 0 (abstains) on a text.  Expectation-maximisation over the
counted vote patterns estimates, without labels, how often each rule is right on good and on bad
texts; the posterior probability of "good" then decides, in place of "every rule must pass".

Everything is row-local SQL but one count by vote pattern, which has at most 3 ** rules rows, whatever the
input.  These come to the driver, where the estimation is arithmetic on a small array.

Cases: a null or blank text has no words, fails the base rules and is not kept.  Rows are judged on
their own, so null or repeated ids and repeated rows do no harm.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .tables import stored, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PCT = 30

RULES = ("length", "word_length", "symbols", "letters", "bare_words", "lines", "repeats", "stutter", "upper", "shouts", "sentences")
_PREFIX = "_qr_"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures of every whole text as columns ``_qr_*``; all input columns stay."""
    p = _PREFIX
    c = lambda name: F.col(p + name)
    body = F.coalesce(F.col(text), F.lit(""))
    has_word = F.lit("[^ \\t\\n\\x0B\\f\\r]")
    step = docs.withColumns({
        f"{p}words": words_of(F.col(text)),
        f"{p}lines": F.filter(F.split(body, "\n"), lambda x: F.rlike(x, has_word)),
        f"{p}n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        f"{p}n_letters": F.regexp_count(body, F.lit("[\\p{L}\\p{N}]")).cast("long"),
        f"{p}n_bare": F.regexp_count(body, F.lit("(?<![^ \\n])[^\\p{L}\\p{N} \\n]+(?![^ \\n])")).cast("long"),
        f"{p}n_stutters": F.regexp_count(body, F.lit("(?<![^ \\n])([^ \\n]+) \\1(?![^ \\n])")).cast("long"),
        f"{p}n_upper": F.regexp_count(body, F.lit("\\p{Lu}")).cast("long"),
        f"{p}n_shouts": F.regexp_count(body, F.lit("!")).cast("long"),
        f"{p}n_stops": F.regexp_count(body, F.lit("[.?](?=[ \\n]|$)")).cast("long"),
    })
    step = step.withColumns({
        f"{p}n_words": F.size(c("words")).cast("long"),
        f"{p}word_chars": F.char_length(F.concat_ws("", c("words"))).cast("long"),
        f"{p}n_lines": F.size(c("lines")).cast("long"),
        f"{p}n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        f"{p}windows": F.when(F.size(c("words")) >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size(c("words")) - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(c("words"), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")),
    })
    # Only texts with a repeated window pay for the sort that finds its places.
    repeated = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    step = step.withColumn(f"{p}sorted", F.when(repeated, F.array_sort(F.transform(
        c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    place = lambda e, k: (F.get(c("sorted"), k - 1)["h"] == e["h"]) | (F.get(c("sorted"), k + 1)["h"] == e["h"])
    step = step.withColumn(f"{p}places", F.array_sort(F.transform(
        F.filter(c("sorted"), lambda e, k: F.coalesce(place(e, k), F.lit(False))), lambda e: e["i"])))
    covered = F.aggregate(
        F.transform(c("places"), lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(c("places"), k + 1) - i, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, n: total + n)
    step = step.withColumn(f"{p}n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    step = step.withColumn(f"{p}base_failed", (c("n_words") < MIN_WORDS)
                           | (100 * c("n_repeat_words") > MAX_REPEATED_PCT * c("n_words")))
    return step.drop(*(p + n for n in ("words", "lines", "windows", "sorted", "places")))


def _three_way(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def votes() -> dict[str, Column]:
    """The rules' votes on the measures of a row."""
    c = lambda name: F.col(_PREFIX + name)
    share = lambda part, whole: c(part) / F.greatest(c(whole), F.lit(1))
    long_enough = c("n_words") >= MIN_WORDS
    return {
        "length": _three_way(c("n_words") >= 2 * MIN_WORDS, ~long_enough),
        "word_length": _three_way(share("word_chars", "n_words").between(3, 10), ~share("word_chars", "n_words").between(2, 14)),
        "symbols": _three_way(share("n_symbols", "n_words") <= 0.02, share("n_symbols", "n_words") > 0.1),
        "letters": _three_way(share("n_letters", "word_chars") >= 0.9, share("n_letters", "word_chars") < 0.8),
        "bare_words": _three_way(share("n_bare", "n_words") <= 0.02, share("n_bare", "n_words") > 0.1),
        "lines": _three_way(share("n_dup_lines", "n_lines") <= 0.1, share("n_dup_lines", "n_lines") > 0.3),
        "repeats": _three_way(share("n_repeat_words", "n_words") <= 0.1, share("n_repeat_words", "n_words") > 0.3),
        "stutter": _three_way(share("n_stutters", "n_words") <= 0.02, share("n_stutters", "n_words") > 0.2),
        "upper": _three_way(share("n_upper", "word_chars") <= 0.15, share("n_upper", "word_chars") > 0.4),
        "shouts": _three_way(share("n_shouts", "n_words") <= 0.05, share("n_shouts", "n_words") > 0.25),
        "sentences": _three_way(long_enough & share("n_stops", "n_words").between(0.02, 0.5), long_enough & (share("n_stops", "n_words") < 0.002)),
    }


@dataclass(frozen=True)
class Model:
    """Prior of "good", and for each rule how often it is right on good and on bad texts when it votes."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def log_odds(self, votes: list[Column]) -> Column:
        terms = [F.when(v == 1, F.lit(math.log(g / (1 - b)))).when(v == -1, F.lit(math.log((1 - g) / b))).otherwise(0.0)
                 for v, g, b in zip(votes, self.good, self.bad)]
        return reduce(Column.__add__, terms, F.lit(math.log(self.prior / (1 - self.prior))))

    def posterior(self, votes: list[Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))


#: Before any text is seen a rule counts as right in 99 of 100 of its votes on good texts, while bad
#: texts are bad in several ways and a rule sees 3 in 10 of them; 8 of 10 texts are good.  These
#: figures weigh as much as ``EARLIER`` texts.
GOOD, BAD, PRIOR, EARLIER = 0.99, 0.3, 0.8, 10.0


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 25, settled: float = 1e-3) -> Model:
    """Expectation-maximisation on vote patterns (one row each, one column for each rule) and their counts.

    Stops when no figure moves by more than ``settled``.
    """
    rules = patterns.shape[1]
    now = np.array([PRIOR] + [GOOD] * rules + [BAD] * rules)
    yes, no = patterns == 1, patterns == -1
    start, n = now.copy(), counts.astype(float)
    for _ in range(rounds if len(n) else 0):
        good, bad = now[1:rules + 1], now[rules + 1:]
        odds = np.log(now[0] / (1 - now[0])) + yes @ np.log(good / (1 - bad)) + no @ np.log((1 - good) / bad)
        is_good = n / (1 + np.exp(-odds))
        is_bad = n - is_good
        hits = np.concatenate([[is_good.sum()], is_good @ yes, is_bad @ no])
        all_ = np.concatenate([[n.sum()], is_good @ (yes | no), is_bad @ (yes | no)])
        new = np.clip((hits + EARLIER * start) / (all_ + EARLIER), 1e-4, 1 - 1e-4)
        moved, now = np.abs(new - now).max(), new
        if moved < settled:
            break
    return Model(float(now[0]), tuple(now[1:rules + 1].tolist()), tuple(now[rules + 1:].tolist()))


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``_qr_posterior`` and ``_qr_kept`` to rows of ``measure``; writes them once in between,
    so the texts are measured once."""
    own, code = votes(), F.col(f"{_PREFIX}code")
    table = stored(measured.withColumn(f"{_PREFIX}code", reduce(Column.__add__, [
        (own[rule].cast("int") + 1) * 3 ** j for j, rule in enumerate(RULES)])))
    rows = table.groupBy(code.alias("code")).agg(F.count("*").alias("n")).collect()  # at most 3 ** rules
    codes = np.array([r["code"] for r in rows], np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1
    model = estimate(patterns, np.array([r["n"] for r in rows], np.int64))
    vs = [F.floor(code / 3 ** j) % 3 - 1 for j in range(len(RULES))]
    return table.withColumn(f"{_PREFIX}posterior", model.posterior(vs)).withColumn(
        f"{_PREFIX}kept", ~F.col(f"{_PREFIX}base_failed") & (F.col(f"{_PREFIX}posterior") >= threshold))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, both verdicts and the posterior, one row for each row of ``docs``."""
    own = [F.col(_PREFIX + n).alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                  "base_failed", "kept", "posterior")]
    measured = measure(docs.select("doc_id", "text")).drop("text")
    return judge(measured).select("doc_id", *own)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its columns, that the rules keep."""
    return judge(measure(docs)).where(F.col(f"{_PREFIX}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
