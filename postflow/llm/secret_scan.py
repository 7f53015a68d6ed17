"""Secret scans over a trigram inverted index (operator 2).

From each rule's regular expression follows a Boolean query over the trigrams that every match must
hold.  Texts are indexed in segments of one Arrow batch: the segment's postings say which of its texts
hold which trigram.  The query's postings are intersected and united, and the regular expression then
verifies the candidates that are left, over their whole text.  A rule whose expression has no mandatory
trigram (such as a run of hex digits) verifies every text.  As postings, query and verification stay in
the segment, no text is shuffled, and a lost executor costs the segments of its tasks.

Trigrams are of lower-cased ASCII letters and all other bytes of the UTF-8 text, so the index serves
rules with and without regard to case.

Cases: a null text counts as an empty one and has no spans.  Rows are scanned on their own, so null or
repeated ids do no harm.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as op, _parser as parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import with_long_ids, with_text_ids


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost matches that do not overlap; a match whose ``group`` is shorter than
    ``least`` is dropped afterwards."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    flags: int = 0


ANY_CASE = re.IGNORECASE | re.ASCII

#: The three base kinds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ANY_CASE),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: A line break, also one written as an escape inside a string.
BREAK = r"(?:\r?\n|\\r\\n|\\n)"
#: From the BEGIN line to the END line, if that comes before another BEGIN.  Otherwise to the end of the
#: base64 block: header lines, then lines of nothing else, or long or padded runs.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{BREAK}[A-Za-z0-9-]+:(?:(?!{BREAK})[^\n])*)*(?:[ \t]*{BREAK}(?=[ \t]*{BREAK}))*"
    rf"(?:{BREAK}[ \t]*[A-Za-z0-9+/]+={{0,2}}(?=[ \t]*(?:{BREAK}|[\"']|\Z))|(?:[ \t]+|{BREAK}[ \t]*)?(?:[A-Za-z0-9+/]{{20,}}={{0,2}}|[A-Za-z0-9+/]+={{1,2}}(?!\S)))*)")
#: Kinds with a mark of their own, by which the index finds them.
MARKED = (
    Rule("private_key", PRIVATE_KEY),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("login_url", r"://[^\s/:@]+:[^\s/:@]{3,}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MARKED

# ---- Boolean trigram queries -------------------------------------------------------------------
# A query is None (every text may match) or a set of clauses; a text may match if it holds all
# trigrams of some clause.

#: Above so many strings or clauses an expression is taken as "anything".
MANY = 32


def _both(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    if a is None or b is None:
        return b if a is None else a
    joined = frozenset(x | y for x in a for y in b)
    return joined if len(joined) <= MANY else min(a, b, key=len)


def _either(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    return None if a is None or b is None or len(a | b) > MANY else a | b


def _grams(strings: frozenset[bytes]) -> frozenset | None:
    """The query that one of the strings occurs."""
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


class _Walk:
    """Reads a parsed expression from left to right and keeps the exact strings that may stand at the
    reading point; where they are lost, their trigrams go into the query."""

    def __init__(self, fold: bool):
        self.fold = fold

    def letters(self, items) -> frozenset[bytes] | None:
        points: set[int] = set()
        for kind, value in items:
            if kind is op.LITERAL:
                points.add(value)
            elif kind is op.RANGE and value[1] - value[0] < MANY:
                points.update(range(value[0], value[1] + 1))
            else:
                return None
        if self.fold and any(c >= 128 or chr(c) in "iksIKS" for c in points):
            return None  # Unicode gives these letters other cases than the two of ASCII
        found = frozenset((chr(c).lower() if c < 128 else chr(c)).encode() for c in points)
        return found if 0 < len(found) <= 8 else None

    def of(self, parsed) -> tuple[frozenset[bytes] | None, frozenset | None]:
        """(all strings it can match, or None where they are too many; the query)"""
        exact: frozenset[bytes] | None = frozenset([b""])
        query, whole = None, True
        for kind, value in parsed:
            strings, inner = self.item(kind, value)
            if strings is not None and exact is not None and len(exact) * len(strings) <= MANY:
                exact = frozenset(a + b for a in exact for b in strings)
                continue
            whole = False
            if exact is not None:
                query = _both(query, _grams(exact))
            query = _both(query, inner if strings is None else None)
            exact = strings if strings is not None else frozenset([b""])
        return (exact, None) if whole else (None, _both(query, _grams(exact)))

    def item(self, kind, value):
        if kind is op.LITERAL:
            return self.letters([(kind, value)]), None
        if kind is op.IN:
            return self.letters(value), None
        if kind is op.SUBPATTERN:
            return self.of(value[-1])
        if kind is op.BRANCH:
            parts = [self.of(p) for p in value[1]]
            strings = [s for s, _ in parts]
            if all(s is not None for s in strings) and sum(map(len, strings)) <= MANY:
                return frozenset().union(*strings), None
            query = frozenset()
            for s, q in parts:
                query = _either(query, _grams(s) if s is not None else q)
            return None, query
        if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, part = value
            strings, query = self.of(part)
            if strings is not None and most == 1 and least == 0:
                return strings | {b""}, None
            if least == 0:
                return None, None
            if strings is not None:
                if least == most == 1:
                    return strings, None
                repeated = frozenset([b""])
                for _ in range(min(least, 3)):
                    if len(repeated) * len(strings) > MANY:
                        return None, None
                    repeated = frozenset(a + b for a in repeated for b in strings)
                return None, _grams(repeated)
            return None, query
        if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            return frozenset([b""]), None
        return None, None


def trigram_query(rule: Rule) -> frozenset | None:
    """Clauses of trigrams, one of which every match of the rule holds entirely; None: no such clauses."""
    fold = bool(rule.flags & re.IGNORECASE) and not rule.flags & re.ASCII
    strings, query = _Walk(fold).of(parser.parse(rule.pattern, rule.flags & ~re.IGNORECASE))
    query = _grams(strings) if strings is not None else query
    return query and frozenset(c for c in query if not any(other < c for other in query))


# ---- Index segments -----------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: Texts of an index segment in ``redact``.
SEGMENT = 512


@lru_cache(maxsize=4)
def _plan(rules: tuple[Rule, ...]):
    """Compiled expressions, queries over gram numbers, and the table from gram code to gram number."""
    queries = [trigram_query(r) for r in rules]
    grams = sorted({g for q in queries if q for clause in q for g in clause})
    number = {g: k for k, g in enumerate(grams)}
    lookup = np.full(1 << 24, -1, np.int16)
    for g, k in number.items():
        lookup[(g[0] << 16) | (g[1] << 8) | g[2]] = k
    return ([re.compile(r.pattern, r.flags) for r in rules],
            [None if q is None else [sorted(number[g] for g in clause) for clause in q] for q in queries],
            lookup, len(grams))


def postings(texts: list[str], lookup: np.ndarray, grams: int) -> list[np.ndarray]:
    """For each gram of the rules, the sorted places of the texts that hold it."""
    held: list[list[int]] = [[] for _ in range(grams)]
    for place, text in enumerate(texts):
        b = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].astype(np.int32)
        if len(b) >= 3:
            found = lookup[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            for g in np.unique(found[found >= 0]).tolist():
                held[g].append(place)
    return [np.array(x, np.int64) for x in held]


def candidates(query, index: list[np.ndarray], texts: int) -> np.ndarray:
    """Places that the query leaves: clauses intersect postings, shortest first, and are united."""
    if query is None:
        return np.arange(texts)
    found = [np.zeros(0, np.int64)]
    for clause in query:
        lists = sorted((index[g] for g in clause), key=len)
        left = lists[0]
        for more in lists[1:]:
            if not len(left):
                break
            left = np.intersect1d(left, more, assume_unique=True)
        found.append(left)
    return np.unique(np.concatenate(found))


def spans_of(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text, (start, rule number, end) in code points, in that order."""
    compiled, queries, lookup, grams = _plan(rules)
    index = postings(texts, lookup, grams)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, pattern, query) in enumerate(zip(rules, compiled, queries)):
        for place in candidates(query, index, len(texts)).tolist():
            for m in pattern.finditer(texts[place]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[place].append((m.start(), k, m.end()))
    return [sorted(x) for x in out]


# ---- Operators ----------------------------------------------------------------------------------

SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, column: str = "_secret_spans", rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the spans of all rules in every whole text, by start and then by rule; other columns stay."""
    @F.pandas_udf(SPANS)
    def find(series: pd.Series) -> pd.Series:
        found = spans_of(series.fillna("").tolist(), rules)
        return pd.Series([[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found], dtype=object)
    return docs.withColumn(column, find(F.col(text)))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``, and ``n_chars`` counted anew where a text has
    changed.  Spans that overlap become one, named by the first."""
    def cleaned(text: str, found) -> str:
        out, end = [], 0
        for k, (start, rule, stop) in enumerate(found):
            if k == 0 or start >= end:
                out += [text[end:start], f"[{rules[rule].kind}]"]
            end = max(end, stop)
        return "".join(out) + text[end:]

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        # The texts of a segment become Python strings, not those of the whole batch.
        parts = [pa.array([], column.type)]
        for at in range(0, len(column), SEGMENT):
            texts = column.slice(at, SEGMENT).to_pylist()
            found = spans_of([t or "" for t in texts], rules)
            parts.append(pa.array([cleaned(t, f) if f else t for t, f in zip(texts, found)], column.type))
        return pa.concat_arrays(parts)
    new = docs.withColumn("_secret_text", clean(F.col("text")))
    changed = ~F.col("_secret_text").eqNullSafe(F.col("text"))
    columns = {"text": F.col("_secret_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.char_length("_secret_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return new.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, how many spans each base kind has, a digest of the base spans, and all spans as text."""
    base = [r.kind for r in BASE]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = spans_of(rows["text"].tolist(), rules)
            named = [[(rules[k].kind, f"{rules[k].kind}:{s}:{e}") for s, k, e in x] for x in found]
            out = {"doc_id": rows["doc_id"]}
            for kind in base:
                out[f"n_{kind}"] = [sum(k == kind for k, _ in x) for x in named]
            out["base_sha256"] = [hashlib.sha256(",".join(t for k, t in x if k in base).encode()).hexdigest() for x in named]
            out["spans"] = [",".join(t for _, t in x) for x in named]
            yield pd.DataFrame(out)
    counts = ", ".join(f"n_{k} long" for k in base)
    return with_long_ids(with_text_ids(docs, "text").mapInPandas(digest, f"doc_id string, {counts}, base_sha256 string, spans string"))
