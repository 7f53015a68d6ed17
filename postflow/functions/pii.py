"""Personal-data scrubbing and the safe-to-send gate."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .text import let, rstrip, strip, with_fixed

MIN_USEFUL_CHARS = 150

# --- Fixed values: patterns and placeholders ---------------------------------
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE = (r"(?:\+?\d{1,3}[\s\-.]?\(?\d{2,5}\)?[\s\-.]?\d{2,5}[\s\-.]?\d{2,5}"
         r"|0\d{2,5}[\s\/\-]?\d{3,8})")
IBAN = (r"\b[A-Z]{2}\d{2}[\s]?[0-9A-Z]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}"
        r"(?:[\s]?[0-9]{0,4}){0,4}\b")
IBAN_LEFT = r"\b[A-Z]{2}\d{2}[\s]?[0-9A-Z]{4}[\s]?[0-9]{4}[\s]?[0-9]{4}"
NAME = (r"\b(?:Herr|Frau|Hr\.|Fr\.|Mr\.|Mrs\.|Ms\.)\s+[A-ZÄÖÜ][a-zäöüß\-]+"
        r"(?:\s+[A-ZÄÖÜ][a-zäöüß\-]+)?")
SIGNATURE = (r"^(?:[\-_*]{2,}\s*$|Mit\s+freundlichen?\s+Grü|Mit\s+freundlichen?\s+Gru"
             r"|Freundliche\s+Grü|Viele\s+Grü|Beste\s+Grü|Best\s+regards|Kind\s+regards"
             r"|Yours\s+sincerely|Thanks\s+and\s+regards)")
THREAD = (r"^(?:[-]{4,}\s*(?:Forwarded|Weitergeleitet|Original)\s+[Mm]essage"
          r"|Von:\s+.+\nGesendet:|From:\s+.+\nSent:"
          r"|On\s+\d{1,2}\s+\w+\s+\d{4}.+wrote:|Am\s+\d{1,2}\.\s+\w+\s+\d{4}.+schrieb:)")
CONTACT = r"^(?:Tel(?:efon)?|Fax|Mobil|Mobile|Phone|Handy|Direct)[.:]?\s*[\+\d].*$"
PLACEHOLDER = r"\[(?:EMAIL|PHONE|IBAN|NAME|SCRUBBED)\]"


@dataclass(frozen=True)
class Rules:
    """The scrubbing patterns with their flags, in order of use."""

    thread: str = f"(?iUmsd){THREAD}"
    signature: str = f"(?iUmd){SIGNATURE}"
    steps: tuple[tuple[str, str, str], ...] = (
        ("iban", f"(?iU){IBAN}", "[IBAN]"),
        ("email", f"(?iU){EMAIL}", "[EMAIL]"),
        ("contact_label", f"(?iUmd){CONTACT}", "[SCRUBBED]"),
        ("phone", f"(?iU){PHONE}", "[PHONE]"),
        ("name", f"(?U){NAME}", "[NAME]"),
    )


DEFAULT = Rules()
KINDS = ["thread", "signature"] + [kind for kind, _, _ in DEFAULT.steps]
#: What every match of a default pattern holds; a cheap test for it spares most texts the pattern.
DIGIT = r"(?U)\d"
TITLES = ("Herr", "Frau", "Hr.", "Fr.", "Mr.", "Mrs.", "Ms.")
NEEDS_DIGIT = {pattern for kind, pattern, _ in DEFAULT.steps if kind in ("iban", "phone")}


def _cut_before(text: Column, pattern: str) -> Column:
    """The text before the first match."""
    return rstrip(F.element_at(F.split(text, pattern, 2), 1))


def _apply(text: Column, rules: Rules, steps: list[tuple[str, str, str | None]], counts: list[Column],
           digit: Column | None = None) -> Column:
    """One step after the other; each count and each text is bound once.  ``digit``: whether the text may hold
    one; no step adds any."""
    if not steps:
        return let(strip(text), lambda done: F.struct(
            done.alias("scrubbed"), *[n.alias(f"n_{k}") for k, n in zip(KINDS, counts)],
            is_safe(done, digit).alias("safe")))
    (kind, pattern, placeholder), rest = steps[0], steps[1:]
    if placeholder is None:
        count, changed = text.rlike(pattern).cast("int"), _cut_before(text, pattern)
    elif digit is None:
        return let(text.rlike(DIGIT), lambda d: _apply(text, rules, steps, counts, d))
    else:
        count, changed = F.regexp_count(text, F.lit(pattern)), F.regexp_replace(text, pattern, placeholder)
    if kind == "email":  # the cheap test spares most texts the pattern
        count = F.when(text.contains("@"), count).otherwise(0)
    elif pattern in NEEDS_DIGIT:
        count = F.when(digit, count).when(text.isNotNull(), 0)
    elif pattern == DEFAULT.steps[-1][1]:
        titled = reduce(lambda a, b: a | b, [text.contains(t) for t in TITLES])
        count = F.when(titled, count).when(text.isNotNull(), 0)
    return let(count, lambda n: let(F.when(n > 0, changed).otherwise(text), lambda after: _apply(
        after, rules, rest, counts + [n], digit)))


def scrub_struct(text: Column, rules: Rules = DEFAULT) -> Column:
    """P43-P45 as one value: struct(scrubbed, n_<kind>…, safe)."""
    cuts = [("thread", rules.thread, None), ("signature", rules.signature, None)]
    return _apply(text, rules, cuts + list(rules.steps), [])


def scrub(df: DataFrame, text: str = "text", rules: Rules = DEFAULT) -> DataFrame:
    """Adds ``scrubbed``, one ``n_<kind>`` count per kind, and ``safe``."""
    return with_fixed(df, "_pii", scrub_struct(F.col(text), rules)).select(*df.columns, "_pii.*")


def replacements(prefix: str = "n_") -> Column:
    """P44 as a map; kinds without a hit are left out."""
    return F.map_filter(
        F.create_map(*[c for k in KINDS for c in (F.lit(k), F.col(prefix + k))]),
        lambda _, n: n > 0)


def total_replacements(prefix: str = "n_") -> Column:
    return sum((F.col(prefix + k) for k in KINDS[1:]), F.col(prefix + KINDS[0]))


def useful_text(scrubbed: Column) -> Column:
    plain = F.when(scrubbed.contains("["), F.regexp_replace(scrubbed, PLACEHOLDER, "")).otherwise(scrubbed)
    return strip(F.regexp_replace(plain, r"(?U) \s+|[^\S ]\s*", " "))  # single blanks stay as they are


def is_safe(scrubbed: Column, digit: Column | None = None) -> Column:
    """Enough text is left and none of it still looks like personal data; a caller that knows may say
    whether there is any ``digit``."""
    digit = scrubbed.rlike(DIGIT) if digit is None else digit
    return let(useful_text(scrubbed), lambda clean: (
        (F.length(clean) >= MIN_USEFUL_CHARS)
        & ~(clean.contains("@") & clean.rlike(f"(?U){EMAIL}")) & ~(digit & clean.rlike(f"(?U){PHONE}"))
        & ~(digit & clean.rlike(f"(?iU){IBAN_LEFT}"))))
