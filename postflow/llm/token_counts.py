"""Token counts of sections by offsets (operator 1).

A whole text is encoded once.  The byte lengths of its tokens give their byte spans, and these the spans
of characters that they touch.  An interval join of the token spans with the section spans of the same
text (two binary searches for each token, both sides being sorted) finds the sections that each token
touches.  A token that lies in one section counts there.  A token that crosses a border counts

* whole (``n_tokens``) for the section with the most of its characters, the earlier one on a tie, and
* in parts (``token_share``) for every section, by the share of its characters there.

A token that touches no section counts for none.  Sections of a text do not overlap.

Cases: a null text counts as an empty one.  A text without sections gives no row; an empty section gives
a row of zeros.  Rows are counted on their own, so null or repeated ids do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .encoders import ID, ByteEncoder, byte_encoder
from .tables import with_long_ids, with_text_ids

Spans = tuple[np.ndarray, np.ndarray]


def lines(text: str) -> Spans:
    """The lines of a text, each with its line feed; together they hold every character."""
    cuts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 10) + 1
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    return starts, np.append(starts[1:], len(text))


def token_spans(text: str, encoder: ByteEncoder) -> Spans:
    """First and behind-last character that each token of the text touches."""
    ends = np.cumsum(encoder.lengths[np.frombuffer(encoder.encode(text), ID)])
    if not len(ends):
        return ends, ends
    data = np.frombuffer(text.encode(), np.uint8)
    place = np.cumsum((data & 0xC0) != 0x80) - 1  # of the character that holds a byte
    return place[np.append(0, ends[:-1])], place[ends - 1] + 1


def attribute(tokens: Spans, sections: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each section: tokens that count for it, tokens of it that cross one of its borders, and
    the sum of its shares."""
    (a, b), (s, e) = tokens, sections
    n = len(s)
    owned, crossing, share = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    if not n or not len(a):
        return owned, crossing, share
    order = np.lexsort((e, s))
    full = order[e[order] > s[order]]  # an empty section holds no character
    if not len(full):
        return owned, crossing, share
    s, e = s[full], e[full]
    first, last = np.searchsorted(e, a, "right"), np.searchsorted(s, b, "left") - 1
    touched = np.maximum(last - first + 1, 0)
    token = np.repeat(np.arange(len(a)), touched)
    section = np.arange(len(token)) - np.repeat(np.cumsum(touched) - touched, touched) + first[token]
    held = np.minimum(b[token], e[section]) - np.maximum(a[token], s[section])
    long = (b - a)[token]
    np.add.at(share, full[section], held / long)
    np.add.at(crossing, full[section], held < long)
    best = np.lexsort((section, -held, token))
    leads = np.append(True, token[best][1:] != token[best][:-1]) if len(best) else np.zeros(0, bool)
    np.add.at(owned, full[section[best[leads]]], 1)
    return owned, crossing, share


def section_tokens(docs: DataFrame, path: str, pattern: str, sections: Callable[[str], Spans] = lines) -> DataFrame:
    """doc_id, section (from 0), start, end (characters), n_tokens, n_crossing, token_share."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_encoder(path, pattern)
        for b in batches:
            ids, parts = [], []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                spans = sections(text)
                own = attribute(token_spans(text, encoder), spans)
                ids += [doc_id] * len(spans[0])
                parts.append((np.arange(len(spans[0])), *spans, *own))
            columns = [np.concatenate(x) for x in zip(*parts)]
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=object)} | dict(zip(
                ("section", "start", "end", "n_tokens", "n_crossing", "token_share"), columns)))
    return with_long_ids(with_text_ids(docs, "text").mapInPandas(
        count, "doc_id string, section int, start long, end long, n_tokens long, n_crossing long, token_share double"))
