"""Facts read from a posting's text."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, functions as F

from .terms import search_form
from .text import blank_to_null, let, strip

# --- Fixed values: synonyms in search order ----------------------------------
WORK_MODES = {
    "remote": "remote", "100% remote": "remote", "vollständig remote": "remote",
    "home office": "remote", "homeoffice": "remote", "voll remote": "remote",
    "fully remote": "remote",
    "hybrid": "hybrid", "teilweise vor ort": "hybrid", "partially onsite": "hybrid",
    "hybrid (remote / vor ort)": "hybrid", "remote/hybrid": "hybrid",
    "vor ort": "onsite", "onsite": "onsite", "on-site": "onsite",
    "präsenz": "onsite", "in house": "onsite",
}
CONTRACT_TYPES = {
    "freelance": "freelance", "freiberuflich": "freelance", "selbständig": "freelance",
    "projektbasis": "freelance", "projekt": "freelance",
    "anü": "anue", "arbeitnehmerüberlassung": "anue", "zeitarbeit": "anue",
    "leiharbeit": "anue", "arbeitnehmerüberlassung (anü)": "anue",
    "festanstellung": "permanent", "fest": "permanent", "vollzeit": "permanent",
    "vollzeitstelle": "permanent", "unbefristet": "permanent",
    "angestelltenverhältnis": "permanent", "full-time employee": "permanent", "fte": "permanent",
}
NEGATION_WINDOW = 30

# --- Fixed values: patterns --------------------------------------------------
NEGATION = (r"\b(kein(?:e|en|em|er|es)?|nicht|no\s|without|ohne|ausgeschlossen|"
            r"nicht\s+vorgesehen|nicht\s+möglich)\s+")
# A language is named by a word start or by its code as a word.
LANGUAGES = {
    "de": (["deutsch", "german"], "de"),
    "en": (["english", "englisch"], "en"),
    "nl": (["dutch", "niederländisch", "vlaams"], "nl"),
}
HOURLY_LABELS, DAILY_LABELS = ["stundensatz", "hourly rate", "stundenlohn"], ["tagessatz", "rate"]
HOURLY_LABELLED = r"(?:stundensatz|hourly rate|stundenlohn)\D{0,10}(\d+(?:[.,]\d+)?)"
_AMOUNT = r"(\d+(?:[.,]\d+)?)\s*(?:€|EUR|eur)?\s*/?\s*"
_HOUR, _DAY = r"(?:std\.?|stunde|h\b|hour)", r"(?:tag|day|pt\b|pd\b|pro tag|per day)"
HOURLY_UNIT = _AMOUNT + _HOUR
DAILY_LABELLED = r"(?:tagessatz|daily rate|rate)\D{0,10}(\d+(?:[.,]\d+)?)"
DAILY_UNIT = _AMOUNT + _DAY
UNITS = f"{_AMOUNT}(?:{_HOUR}|{_DAY})"

# Headings start a line or follow two asterisks; the text is read behind a line end.
MUST_WORDS = ["must", "muss", "zwingend", "voraussetzungen", "anforderungen", "profil", "talente",
              "requirements", "qualifikation"]
MUST_START = (
    r"[\n*](?:(?<=\n)|(?<=\*)\*)[ \t]*(?:ihr |dein |deine )?"
    r"(must[ \t-]*haves?|muss[ \t-]*(?:kriterien|anforderungen)|zwingend erforderlich|"
    r"voraussetzungen|anforderungen|profil|talente|requirements|qualifikation(?:en)?)"
    r"[ \t]*(?::|\*\*|\n|$)"
)
MUST_END = (r"(nice[ \t-]*to[ \t-]*have|soll[ \t-]*kriterien|kann[ \t-]*kriterien|"
            r"wünschenswert|von vorteil|rahmenparameter|rahmendaten|wir bieten|konditionen)")
MUST_CHARS = 2500

_HOURS = r"(?:Stunden|Std\.?|h)"
_PER_WEEK = r"(?:pro|/|je|die|per)\s*Woche"
HOURS_RANGE = rf"(\d{{1,2}})\s*(?:-|–|bis)\s*(\d{{1,2}})\s*{_HOURS}\s*{_PER_WEEK}"
HOURS = rf"(\d{{1,2}})\s*{_HOURS}\s*{_PER_WEEK}"
DAYS = rf"(\d)(?:\s*(?:-|–|bis)\s*(\d))?\s*Tage\s*{_PER_WEEK}"
#: Every hit of the three forms lies in one hit of this.
WEEKLY = rf"\d{{1,2}}\s*+(?:(?:-|–|bis)\s*+\d{{1,2}}\s*+)?(?:{_HOURS}|Tage)\s*{_PER_WEEK}"
#: A hit without blanks is at most a quarter as long.
WEEKLY_CHARS = 100
# These run on the search form.
PERCENT = r"auslastung\W{0,8}(\d{2,3})\s*%"
FULL_TIME = r"[vf](?:(?<=\bv)ollzeit|(?<=\bf)ull[ -]?time)\b"
PART_TIME = r"[tp](?:(?<=\bt)eilzeit|(?<=\bp)art[ -]?time)\b"
REMOTE_SHARE = r"(\d{1,3})\s*%\s*remote"

MONTHS = {
    "januar": 1, "january": 1, "februar": 2, "february": 2, "märz": 3, "maerz": 3,
    "march": 3, "april": 4, "mai": 5, "may": 5, "juni": 6, "june": 6, "juli": 7,
    "july": 7, "august": 8, "september": 9, "oktober": 10, "october": 10,
    "november": 11, "dezember": 12, "december": 12,
}
# Projektzeitraum, Zeitraum, Laufzeit, Projektstart, Einsatzbeginn, Starttermin, Start, Beginn, told apart by their first letter.
START_LABEL = (r"([zlpesb](?:(?<=z)eitraum|(?<=l)aufzeit|(?<=p)rojekt(?:zeitraum|start)|(?<=e)insatzbeginn|"
               r"(?<=s)tart(?:termin)?|(?<=b)eginn))\**\s*:?\**\s*([^\n]{0,80})")
START_STEMS, START_PREFIX = ["zeit", "start", "beginn"], len("projekt")
DAY_DATE = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
MONTH_DATE = r"(?:(Anfang|Mitte|Ende)\s+)?(" + "|".join(MONTHS) + r")(?:\s+(\d{4}))?"
IMMEDIATE = r"\b(asap|ab sofort|sofort|schnellstmöglich|kurzfristig)\b"
PERIOD_LABELS = ["zeitraum", "projektzeitraum", "laufzeit"]

# --- Fixed values: status of a condition -------------------------------------
OK, PARTIAL, NOT_OK = "erfüllt", "teilweise", "nicht erfüllt"
UNKNOWN, NOT_CHECKED, CONFLICT = "unbekannt", "nicht geprüft", "Konflikt"

FLAGS = "(?iU)"


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for item in values.items() for v in item])


def german_number(col: Column) -> Column:
    """Dots are thousands separators, the comma is the decimal mark."""
    plain = F.replace(F.replace(col, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def _on_low(text: Column, low: Column | None, body) -> Column:
    """``body`` over the search form of the text, which a caller may have at hand."""
    return body(low) if low is not None else let(search_form(text), body)


def _contains(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def _tail(text: Column, needle: str) -> Column:
    """The text from its first needle (four letters or more) on; this search skips, substring functions try every place."""
    return F.regexp_extract(text, f"(?s){needle}.*", 0)


def _from_byte(text: Column, start: Column) -> Column:
    """The text behind its first ``start`` bytes: counting characters would take longer than finding a needle."""
    size = F.octet_length(text)
    return F.substr(text.cast("binary"), F.greatest(F.lit(0), start) + 1, size).cast("string")


def _first_byte(text: Column, needles: list[str], words: Column | None = None) -> Column:
    """The bytes ahead of the first needle; all bytes without one.

    ``words`` may be the words of the text that begin with a needle, if only such words matter.
    """
    return F.octet_length(text) - F.greatest(*[F.when(
        text.contains(n) if words is None else words.contains(f" {n}"), F.octet_length(_tail(text, n))) for n in needles], F.lit(0))


def _from_first(text: Column, needles: list[str], before: int = 0) -> Column:
    """The text from ``before`` bytes ahead of its first needle on, null without a needle.

    ``before`` may cut a letter outside ASCII; a pattern must not look at what is left of it.
    """
    return let(_first_byte(text, needles), lambda first: F.when(
        first < F.octet_length(text), _from_byte(text, first - before)))


def _from_line_of_first(text: Column, needles: list[str], words: Column | None = None) -> Column:
    """The text from the line of its first needle on, null without a needle."""
    def cut(first: Column) -> Column:
        head = F.substr(text.cast("binary"), F.lit(1), first).cast("string")
        return F.when(first < F.octet_length(text), _from_byte(
            text, first - F.octet_length(F.substring_index(head, "\n", -1))))

    return let(_first_byte(text, needles, words), cut)


def _amount(low: Column, pattern: str) -> Column:
    return german_number(blank_to_null(F.regexp_extract(low, f"(?U){pattern}", 1)))


def _labelled(low: Column, labels: list[str], pattern: str) -> Column:
    return _amount(_from_first(low, labels), pattern)


def hourly_rate(text: Column, low: Column | None = None) -> Column:
    """P10: first number of the first pattern that hits (every hit of these parses)."""
    return _on_low(text, low, lambda t: F.coalesce(_labelled(t, HOURLY_LABELS, HOURLY_LABELLED), _amount(t, HOURLY_UNIT)))


def daily_rate(text: Column, low: Column | None = None) -> Column:
    """P10."""
    return _on_low(text, low, lambda t: F.coalesce(_labelled(t, DAILY_LABELS, DAILY_LABELLED), _amount(t, DAILY_UNIT)))


def rates(text: Column, low: Column | None = None) -> Column:
    """P10: struct(hourly, daily), with one search for the amounts of both units."""
    def both(t: Column) -> Column:
        found = F.array_join(F.regexp_extract_all(t, F.lit(f"(?U){UNITS}"), F.lit(0)), "\n")
        return let(found, lambda units: F.struct(
            F.coalesce(_labelled(t, HOURLY_LABELS, HOURLY_LABELLED), _amount(units, HOURLY_UNIT)).alias("hourly"),
            F.coalesce(_labelled(t, DAILY_LABELS, DAILY_LABELLED), _amount(units, DAILY_UNIT)).alias("daily")))

    return _on_low(text, low, both)


def work_mode(text: Column, low: Column | None = None) -> Column:
    """Exact synonym, else the first synonym (in order) the text contains."""
    listed = list(WORK_MODES)  # one that holds an earlier one is never the first
    first = {s: m for i, (s, m) in enumerate(WORK_MODES.items()) if not any(e in s for e in listed[:i])}
    return _on_low(text, low, lambda t: F.coalesce(
        _literal_map(WORK_MODES)[t],
        *[F.when(t.contains(s), F.lit(m)) for s, m in first.items()]))


def contract_type(text: Column, low: Column | None = None) -> Column:
    """Like P12, but a synonym whose first hit is negated just before counts as absent."""
    def window(text_: Column, synonym: str) -> Column:
        return let(F.instr(text_, synonym), lambda pos: F.substring(
            text_, F.greatest(F.lit(1), pos - NEGATION_WINDOW),
            pos - F.greatest(F.lit(1), pos - NEGATION_WINDOW)))

    def inside(text_: Column, synonym: str, canonical: str) -> Column:
        # The plain substring test is cheap; few texts go on to position and window.
        return F.when(text_.contains(synonym) & ~window(text_, synonym).rlike(f"(?U){NEGATION}"),
                      F.lit(canonical))

    def short(t: Column) -> Column:
        """A long text is a synonym in blanks only if it starts or ends with many; stripping it is slow."""
        return (F.length(t) <= 200) | (strip(F.substring(t, 1, 50)) == "") | (strip(F.right(t, F.lit(50))) == "")

    return _on_low(text, low, lambda t: F.coalesce(
        F.when(short(t), _literal_map(CONTRACT_TYPES)[strip(t)]),
        *[inside(t, s, m) for s, m in CONTRACT_TYPES.items()]))


def languages(text: Column, low: Column | None = None) -> Column:
    """P14."""
    def named(t: Column, stems: list[str], code: str) -> Column:
        hits = [t.contains(s) & t.rlike(rf"(?U){s}(?<=\b{s})") for s in stems]
        hits.append(t.contains(code) & (t.contains(f" {code} ") | t.rlike(rf"(?U){code}\b(?<=\b{code})")))
        return reduce(lambda a, b: a | b, hits)

    return _on_low(text, low, lambda t: F.array_compact(F.array(*[
        F.when(named(t, *names), F.lit(code)) for code, names in LANGUAGES.items()])))


def must_sections(text: Column, low: Column | None = None, folded: bool = False,
                  words: Column | None = None) -> Column:
    """Up to 2,500 characters after each requirement heading, cut at an end marker.

    The look-ahead captures the text after a heading without consuming it, so windows
    may overlap, and no row leaves the JVM.  ``low`` may be a search form that holds that of the text;
    ``folded`` says that ``text`` is a search form itself, which the patterns read without folding case,
    and ``words`` may hold all its words that begin with ``MUST_WORDS`` (a heading's word starts a word).
    """
    if folded:  # no line end parts a heading from its word, so nothing ahead of the first word's line matters
        return F.when(text.isNotNull(), F.coalesce(let(
            _from_line_of_first(text, MUST_WORDS, words), lambda t: _must_sections(t, "(?Ud)")), F.lit("")))
    sections = _must_sections(text, "(?iUd)")
    return sections if low is None else F.when(text.isNull() | _contains(low, MUST_WORDS), sections).otherwise("")


def _must_sections(text: Column, flags: str) -> Column:
    start = f"{flags}{MUST_START}(?=((?s:.{{0,{MUST_CHARS}}})))"
    windows = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(start), F.lit(2))
    # Spark keeps a compiled pattern here; a split would compile it for every window.
    end = f"{flags}{MUST_END}(?s:.*)"
    return F.array_join(F.transform(windows, lambda w: F.regexp_replace(w, end, "")), "\n")


def _near_first_week(text: Column, rest: Column) -> Column:
    """The last ``rest`` characters of a text, whose first "woche" follows ``WEEKLY_CHARS`` of them.

    A hit ends with the word and has few characters but blanks, so one that begins still earlier
    fills these with blanks; such a text is read whole.
    """
    before = F.substring(text, -rest, F.lit(WEEKLY_CHARS))
    blank = F.length(F.regexp_replace(before, r"(?U)\s+", "")) < WEEKLY_CHARS // 4
    return F.when(blank, text).otherwise(F.right(text, rest))


def weekly_hours(text: Column, full_time: float = 40.0, low_text: Column | None = None) -> Column:
    """P20: struct(lo, hi, label) of the first form that is stated, null when none is."""

    def groups(source: Column, pattern: str, n: int) -> Column:
        """The whole hit and its groups, null without a hit."""
        return F.array(*[blank_to_null(F.regexp_extract(source, pattern, i)) for i in range(n + 1)])

    def struct(lo: Column, hi: Column, label: Column) -> Column:
        return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"),
                        label.cast("string").alias("label"))

    def form(source: Column, pattern: str, n: int, build) -> Column:
        return let(groups(source, pattern, n), lambda g: F.when(F.get(g, F.lit(1)).isNotNull(), build(
            *[F.get(g, F.lit(i)) for i in range(n + 1)])))

    def days(hit: Column, first: Column, last: Column) -> Column:
        return struct(first.cast("double") * 8, F.coalesce(last, first).cast("double") * 8, hit)

    def percent(_: Column, share: Column) -> Column:
        hours = share.cast("double") * full_time / 100
        return struct(hours, hours, F.concat(share, F.lit(" %")))

    none = F.lit(None)

    def first_form(low: Column) -> Column:
        # Each form needs its key word, so the cheap test spares most texts the patterns.
        near = let(F.length(_tail(low, "woche")), lambda rest: _near_first_week(text, rest + WEEKLY_CHARS))
        found = F.array_join(F.regexp_extract_all(near, F.lit(FLAGS + WEEKLY), F.lit(0)), "\n")
        weekly = let(found, lambda hits: F.coalesce(
            form(hits, FLAGS + HOURS_RANGE, 2, lambda _, a, b: struct(a, b, none)),
            form(hits, FLAGS + HOURS, 1, lambda _, a: struct(a, a, none)), form(hits, FLAGS + DAYS, 2, days)))
        whole = struct(F.lit(full_time), F.lit(full_time), F.lit("Vollzeit"))
        return F.coalesce(
            F.when(low.contains("woche"), weekly),
            F.when(low.contains("auslastung"), form(_from_first(low, ["auslastung"]), "(?U)" + PERCENT, 1, percent)),
            F.when((low.contains("vollzeit") | low.contains("full")) & low.rlike("(?U)" + FULL_TIME), whole))

    return first_form(low_text) if low_text is not None else let(search_form(text), first_form)


def _general(number: Column) -> Column:
    """Shortest decimal text: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(
        F.format_string("%.4f", number), r"0+\z", ""), r"\.\z", "")


def workload(text: Column, low: float = 20, high: float = 40, full_time: float = 40,
             low_text: Column | None = None) -> Column:
    """P20 as a condition: struct(status, value, note).  ``low_text`` is the search form, if at hand."""
    if low_text is None:
        return let(search_form(text), lambda found: workload(text, low, high, full_time, found))
    # Read only when no hours are stated.
    part_time = (low_text.contains("teilzeit") | low_text.contains("part")) & low_text.rlike("(?U)" + PART_TIME)

    def judge(hours: Column) -> Column:
        lo, hi, label = hours["lo"], hours["hi"], hours["label"]
        span = F.when(lo == hi, _general(lo)).otherwise(F.concat(_general(lo), F.lit("–"), _general(hi)))
        plain = F.concat(span, F.lit(" h/Woche"))
        inside = (hi >= low) & (lo <= high)
        return F.struct(
            F.when(lo.isNull(), UNKNOWN).when(inside, OK).otherwise(NOT_OK).alias("status"),
            F.when(lo.isNull(), F.when(part_time, "Teilzeit"))
            .when(label.isNotNull(), F.concat(label, F.lit(" ("), plain, F.lit(")")))
            .otherwise(plain).alias("value"),
            F.when(lo.isNull() & part_time, "Teilzeit ohne Stundenangabe")
            .when(lo.isNull(), "Keine Auslastung angegeben")
            .when(~inside, f"Außerhalb von {low:g}–{high:g} h/Woche").alias("note"),
        )

    return let(weekly_hours(text, full_time, low_text), judge)


def remote_share(text: Column, low: Column | None = None) -> Column:
    """The stated percentage, or null."""
    return _on_low(text, low, lambda t: F.when(t.contains("%") & t.contains("remote"), blank_to_null(
        F.regexp_extract(t, "(?U)" + REMOTE_SHARE, 1)).cast("int")))


def _segment_dates(segment: Column, today: dt.date) -> Column:
    """Dates of one labelled segment (lower case), numeric dates first, then month names."""
    numeric = F.transform(
        F.regexp_extract_all(segment, F.lit("(?U)" + DAY_DATE), F.lit(0)),
        lambda d: F.try_to_date(d, "d.M.yyyy"))
    pattern = "(?U)" + MONTH_DATE.lower()

    def month(found: Column) -> Column:
        part, name = F.regexp_extract(found, pattern, 1), F.regexp_extract(found, pattern, 2)
        year = blank_to_null(F.regexp_extract(found, pattern, 3)).cast("int")
        number = _literal_map(MONTHS)[name]
        day = F.when(part == "mitte", 15).when(part == "ende", 28).otherwise(1)
        this_year = F.make_date(F.lit(today.year), number, day)
        return F.when(year.isNotNull(), F.make_date(year, number, day)) \
            .when(this_year < F.lit(today.replace(day=1)), F.make_date(F.lit(today.year + 1), number, day)) \
            .otherwise(this_year)

    named = F.transform(F.regexp_extract_all(segment, F.lit(pattern), F.lit(0)), month)
    return F.array_compact(F.concat(numeric, named))


def start_date(text: Column, today: dt.date, low_text: Column | None = None) -> Column:
    """struct(start, shown) of the first labelled segment that states a start.

    The whole rule is array functions over the labelled segments of the row.  It runs on
    the search form, so no pattern has to fold case.
    """
    def stated(low: Column) -> Column:
        return let(_from_first(low, START_STEMS, START_PREFIX), lambda labelled: F.when(
            labelled.isNotNull(), _first_start(labelled, today)))

    return stated(low_text) if low_text is not None else let(search_form(text), stated)


def _first_start(low: Column, today: dt.date) -> Column:
    pattern = "(?Ud)" + START_LABEL
    segments = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), lambda hit: F.struct(
        F.regexp_extract(hit, pattern, 1).alias("label"), F.regexp_extract(hit, pattern, 2).alias("segment")))
    parsed = F.transform(segments, lambda z: F.struct(
        z["label"].alias("label"), _segment_dates(z["segment"], today).alias("dates"),
        z["segment"].rlike("(?U)" + IMMEDIATE).alias("immediate")))
    stated = F.filter(parsed, lambda p: (F.size(p["dates"]) > 0) | p["immediate"])

    def result(p: Column) -> Column:
        dates = p["dates"]
        period = p["label"].isin(PERIOD_LABELS)
        start = F.when(F.size(dates) == 0, F.lit(today)) \
            .when(period, F.get(dates, F.lit(0))).otherwise(F.array_max(dates))
        shown = F.date_format(start, "dd.MM.yyyy")
        return F.struct(
            start.alias("start"),
            F.when(F.size(dates) == 0, "sofort").when(period, shown)
            .when(p["immediate"], F.concat(F.lit("sofort bis spätestens "), shown))
            .when(F.size(dates) > 1, F.concat(F.lit("spätestens "), shown))
            .otherwise(shown).alias("shown"),
        )

    return F.get(F.transform(F.slice(stated, 1, 1), result), F.lit(0))
