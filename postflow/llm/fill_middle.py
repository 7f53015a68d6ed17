"""Fill-in-the-middle transformation (operator 13).

A text is cut into units by one full match of ``(unit)*``: the ``regex`` library keeps every repetition of
the group, so the ends of the group tell how many units there are and where both cuts fall.  Two numbers
drawn from a hash of the id say after how many units prefix and middle end; two more choose the form:

* ``plain``: the text as it is, also where it is empty or holds one of the marks;
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

No mark can arise where parts meet, for a mark starts with ``<`` and has no other; so the form and the
output give the text back.

Cases: a null text counts as an empty one, null ids draw as the id ``null``.  Repeated rows change alike.  A
text of one unit has two empty parts.  An empty table gives no rows.  Memory follows the units of the texts
of one part of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tables import slices

# Marks and shares of the transformation.
P, S, M = "<P>", "<S>", "<M>"
CHANGED_PCT = 90
SPM_PCT = 20
SEED = "1"
CODE_POINT = r"(?s:.)"


@dataclass(frozen=True)
class Middle:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def transform(text: str, doc_id: str, unit: str = CODE_POINT, seed: str = SEED, changed_pct: int = CHANGED_PCT, spm_pct: int = SPM_PCT) -> Middle:
    """One text; units must match it from end to end."""
    import regex

    match = regex.fullmatch(f"({unit})*", text)
    if match is None:
        raise ValueError(f"text {doc_id} is no run of units {unit}")
    ends = match.ends(1)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(mark in text for mark in (P, S, M)) or h[2] % 100 >= changed_pct:
        return Middle(n, "plain", None, None, text)
    first, second = (ends[k - 1] if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h[3] % 100 < spm_pct:
        return Middle(n, "spm", first, second - first, f"{S}{suffix}{P}{prefix}{M}{middle}")
    return Middle(n, "psm", first, second - first, f"{P}{prefix}{S}{suffix}{M}{middle}")


def restore(output: str, form: str) -> str:
    """The text that ``transform`` has changed."""
    if form == "plain":
        return output
    head, middle = output.split(M)
    left, right = head.removeprefix(P if form == "psm" else S).split(S if form == "psm" else P)
    prefix, suffix = (left, right) if form == "psm" else (right, left)
    return prefix + middle + suffix


def changed(docs: DataFrame, unit: str = CODE_POINT, seed: str = SEED, changed_pct: int = CHANGED_PCT, spm_pct: int = SPM_PCT) -> DataFrame:
    """``docs`` with a struct ``_fim`` of n, form, prefix_chars, middle_chars and output."""
    @F.pandas_udf("struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, ids in parts:
            done = []
            for rows in slices(pd.DataFrame({"t": texts, "i": ids}), 64):
                found = [transform(t, i, unit, seed, changed_pct, spm_pct) for t, i in zip(rows["t"], rows["i"])]
                frame = pd.DataFrame([vars(m) for m in found], columns=["n", "form", "prefix_chars", "middle_chars", "output"])
                done.append(frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"}))
            yield pd.concat(done, ignore_index=True)
    return docs.withColumn("_fim", cut(F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def restored(output, form):
    """Column of the texts behind ``output`` and ``form``."""
    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms)], index=outputs.index, dtype=object)
    return back(output, form)


def fill_in_middle(docs: DataFrame, **options) -> DataFrame:
    """``docs``, with its columns, and the output as its text."""
    rows = changed(docs, **options).withColumn("text", F.col("_fim.output"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and both digests: one row for each row of ``docs``."""
    rows = changed(docs.select("doc_id", "text")).select("doc_id", "_fim.*")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
h AS (SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
