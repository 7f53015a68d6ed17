"""Term rules: compiling a term (P15) and finding terms in a text.

A term is plain text.  Spaces and hyphens in it are optional and interchangeable, it must
start as a word, and a trailing ``*`` lets the word go on.  Case does not matter: patterns
are lower-case and run on the :func:`search_form` of a text, which is much faster than
case-insensitive matching.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, functions as F

from .text import let

# --- Fixed values: the characters that make a word (of a search form), and those that
# --- may stand between the parts of a term -----------------------------------
WORD = "0-9a-zäöüß"
LETTERS = "0123456789abcdefghijklmnopqrstuvwxyzäöüß"  # the same without ranges, which Java searches ten times faster
JOINED = "ſıİ"  # only case folding joins these letters to s, i, i
GAP = r"(?U:[\s\x1c-\x1f\-]*)"


def _escape(part: str) -> str:
    return re.sub(rf"([^A-Z{WORD}_])", r"\\\1", part)


@dataclass(frozen=True)
class Term:
    """One compiled rule term: ``pattern`` decides, ``needle`` only prunes, ``plain`` (the term between spaces) only confirms.

    ``head`` is the first part, if word characters make it; a hit then starts a word with it.
    """

    term: str
    pattern: str
    needle: str
    context: tuple["Term", ...] = ()
    plain: str = ""
    head: str = ""


def compile_term(entry) -> Term | None:
    """P15 on the driver: ``"text"`` or ``{"term": ..., "with": [...]}``."""
    context: list = []
    if isinstance(entry, dict):
        context = [t for t in map(compile_term, entry.get("with") or []) if t]
        entry = entry.get("term")
    raw = str(entry or "").strip()
    parts = [p for p in re.split(r"[\s\-]+", raw.rstrip("*").strip()) if p]
    if not parts:
        return None
    tail = "" if raw.endswith("*") else f"(?![{WORD}])"
    # The letters come first and look back at the word start, so a text is searched for the letters.
    first, *others = [_escape(p.lower()) for p in parts]
    pattern = GAP.join([f"{first}(?<![{WORD}]{first})", *others]) + tail
    plain = " " + " ".join(parts).lower() + ("" if raw.endswith("*") else " ")
    head = parts[0].lower() if re.fullmatch(f"[{WORD}]+", parts[0].lower()) else ""
    return Term(raw, pattern, max(parts, key=len).lower(), tuple(context), plain, head)


def compile_terms(entries) -> list[Term]:
    return [t for t in map(compile_term, entries or []) if t]


def term_pattern(term: Column, first: str = "letters") -> Column:
    """P15 as a column, for rule tables that are built in Spark.

    Both forms have the same hits.  With ``first="letters"`` it is the one that texts are searched with, as in
    :func:`compile_term`; with ``first="start"`` the word start comes first, as P15 writes a pattern.
    """
    core = F.lower(F.trim(F.regexp_replace(F.trim(term), r"\*+\z", "")))
    parts = F.filter(F.split(core, r"[\s\-]+"), lambda p: p != "")
    escaped = F.transform(parts, lambda p: F.regexp_replace(p, rf"([^{WORD}_])", r"\\$1"))
    if first == "start":
        body = F.concat(F.lit(f"(?<![{WORD}])"), F.array_join(escaped, GAP))
    else:
        body = F.array_join(F.transform(escaped, lambda p, i: F.when(i > 0, p).otherwise(
            F.concat(p, F.lit(f"(?<![{WORD}]"), p, F.lit(")")))), GAP)
    tail = F.when(F.trim(term).endswith("*"), "").otherwise(f"(?![{WORD}])")
    return F.when(F.size(parts) > 0, F.concat(body, tail))


def search_form(text: Column) -> Column:
    """Lower case; the letters that only case folding joins to ASCII are mapped too."""
    def low(t: Column) -> Column:
        odd = reduce(lambda a, b: a | b, [t.contains(c) for c in JOINED])
        return F.lower(F.when(odd, F.translate(t, JOINED, "sii")).otherwise(t))  # translating is slow and seldom needed

    return let(text, low)


def term_words(terms: list[Term], low: Column, others: list[str] | None = None) -> Column:
    """The words of a search form that begin with the head of a term or one of ``others``, each between spaces.

    One search of the text for all terms.  A term of one part is then a word of this short list, and a
    longer one can only occur where its head is in it.
    """
    heads = {h for t in terms for h in (t.head, *[c.head for c in t.context]) if h} | set(others or [])
    heads = sorted(h for h in heads if not any(h.startswith(o) for o in heads - {h}))
    if not heads:
        return F.when(low.isNotNull(), F.lit(""))
    tails = {c: "|".join(h[1:] for h in group) for c, group in groupby(heads, lambda h: h[0])}
    begins = "|".join(f"{c}(?:{tail})" for c, tail in tails.items())
    pattern = f"[^{LETTERS}](?=[{''.join(tails)}])((?:{begins})[{LETTERS}]*+)"
    found = F.regexp_extract_all(F.concat(F.lit(" "), low), F.lit(pattern), F.lit(1))
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def hits(term: Term, low: Column, words: Column | None = None) -> Column:
    """True when the term occurs.  The substring tests are cheap and run first; ``words`` may be :func:`term_words`."""
    word = low.rlike(term.pattern)
    found = low.contains(term.needle) & (low.contains(term.plain) | word if term.plain else word)
    if words is not None and term.head:
        single = term.plain.strip() == term.head
        found = words.contains(term.plain) if single else words.contains(f" {term.head}") & found
    if term.context:
        found = found & reduce(lambda a, b: a | b, [hits(c, low, words) for c in term.context])
    return found


def matched(terms: list[Term], low: Column, words: Column | None = None) -> Column:
    """The distinct matched terms in rule order; ``low`` is a search form."""
    if not terms:
        return F.expr("cast(array() as array<string>)")
    return F.array_compact(F.array(*[F.when(hits(t, low, words), F.lit(t.term)) for t in terms]))


def first_match(terms: list[Term], low: Column) -> Column:
    if not terms:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(hits(t, low), F.lit(t.term)) for t in terms])


def any_match(terms: list[Term], low: Column) -> Column:
    if not terms:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [hits(t, low) for t in terms])


def exclude_pattern(term: str) -> str:
    """a term that is no valid regex is taken literally (settled at load time)."""
    try:
        re.compile(term)
        return f"(?iu){term}"
    except re.error:
        return "(?iu)" + _escape(term)
