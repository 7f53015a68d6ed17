"""Alert messages: matching (F14) and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import strip


def mail_match(sender: Column, subject: Column, senders: list[str], subjects: list[str]) -> Column:
    """any sender substring and any subject pattern."""
    if not senders or not subjects:
        return F.lit(False)
    by_sender = reduce(lambda a, b: a | b, [sender.contains(s) for s in senders])
    by_subject = reduce(lambda a, b: a | b, [subject.rlike(f"(?iU){p}") for p in subjects])
    return by_sender & by_subject


def message_urls(text: Column, html: Column, include: list[str], exclude: list[str]) -> Column:
    """Hits in the text part and http links of the HTML part, filtered and distinct."""
    if not include:
        return F.expr("cast(array() as array<string>)")
    none = F.expr("cast(array() as array<string>)")
    links = F.coalesce(F.regexp_extract_all(
        html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'](http[^\"']*)[\"']"), F.lit(1)), none)
    hits = [F.coalesce(F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(0)), none) for p in include]
    found = F.transform(F.concat(links, *hits), strip)

    def keep(url: Column) -> Column:
        wanted = reduce(lambda a, b: a | b, [url.rlike(f"(?iU){p}") for p in include])
        for p in exclude or []:
            wanted = wanted & ~url.rlike(f"(?iU){p}")
        return (url != "") & wanted

    return F.array_distinct(F.filter(found, keep))
