"""Structured fields from page HTML.

Pages are cut at tags with regular expressions inside one row: a page never leaves its
task and nothing is exploded before it is wanted as rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from ..functions.text import blank_to_null, let, rest, strip

# --- Fixed values: labels of the detail block, entities ----------------------
LABELS = ["Start", "Von", "Auslastung", "Eingestellt", "Ansprechpartner:", "Projekt-ID:",
          "Branche", "Vertragsart", "Einsatzart", "Laufzeit", "Ort", "Sprachen"]
TWO_TOKEN_LABEL = "Ansprechpartner"
FILLERS = ["", ":", "•"]
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'",
            "&apos;": "'", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä",
            "&Ouml;": "Ö", "&Uuml;": "Ü", "&szlig;": "ß", "&euro;": "€", "&amp;": "&"}
# --- Fixed values: class names of page frames; words of generic second headings ---
FRAME_CLASSES = ["nav", "footer", "sidebar", "menu", "header", "login", "register"]
GENERIC_HEADING = r"(?i)weitere|projekte|solcom|portal|angebote|projekt|details"
_NONE = "cast(array() as array<string>)"


def entities(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def without_code(html: Column) -> Column:
    """Scripts, styles and comments out."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")


def plain(fragment: Column) -> Column:
    """All text of a fragment, tags removed, white space collapsed."""
    text = entities(F.regexp_replace(fragment, r"<[^>]*>", " "))
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def inner_text(fragment: Column) -> Column:
    """Text pieces trimmed and joined without a blank, as for a single element."""
    return strip(entities(F.regexp_replace(fragment, r"(?U)\s*<[^>]*>\s*", "")))


def to_markdown(fragment: Column) -> Column:
    """Block and inline tags to marked text."""
    text = F.regexp_replace(fragment, r"(?U)\s+", " ")
    for pattern, new in [
        (r"(?i)\s*<br\b[^>]*>\s*", "\n"),
        (r"(?i)<(?:strong|b)\b[^>]*>\s*|\s*</(?:strong|b)\s*>", "**"),
        (r"(?i)<(?:em|i)\b[^>]*>\s*|\s*</(?:em|i)\s*>", "*"),
        (r"(?i)<li\b[^>]*>\s*</li\s*>", ""),
        (r"(?i)\s*<li\b[^>]*>\s*", "\n- "), (r"(?i)\s*</li\s*>", "\n"),
        (r"(?i)\s*</?(?:p|ul|ol|div|section|article|table|tr)\b[^>]*>\s*", "\n"),
        (r"<[^>]*>", ""), (r"[ \t]*\n[ \t]*", "\n"), (r"\n{3,}", "\n\n"),
    ]:
        text = F.regexp_replace(text, pattern, new)
    return strip(entities(text))


def sections(html: Column) -> Column:
    """Array of struct(heading, text), one per h1-h4, text up to the next heading."""
    pieces = rest(F.split(without_code(html), r"(?i)<h[1-4]\b[^>]*>"))
    halves = F.transform(pieces, lambda p: F.split(p, r"(?i)</h[1-4]\s*>", 2))
    return F.transform(halves, lambda p: F.struct(
        inner_text(F.get(p, F.lit(0))).alias("heading"),
        to_markdown(F.coalesce(F.get(p, F.lit(1)), F.lit(""))).alias("text")))


def section_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """P37 as rows: (page columns, section_ord, heading, text)."""
    keep = [c for c in pages.columns if c != html]
    return pages.select(*keep, F.posexplode(sections(F.col(html))).alias("section_ord", "s")) \
        .select(*keep, "section_ord", "s.heading", "s.text")


def section(html: Column, heading: str) -> Column:
    """Text of the first section whose heading starts with ``heading``; null if empty."""
    found = F.get(F.filter(sections(html), lambda s: F.lower(s["heading"]).startswith(heading.lower())), F.lit(0))
    return blank_to_null(found["text"])


def text_stream(html: Column) -> Column:
    """The visible text pieces in page order."""
    body = F.regexp_replace(without_code(html), r"(?is)<head\b.*?</head\s*>", "")
    return F.filter(F.transform(F.split(body, r"<[^>]*>"), lambda t: strip(entities(t))), lambda t: t != "")


def label_values(stream: Column, labels: list[str] | None = None) -> Column:
    """Map label -> value; the last hit of a label wins.

    The value is the next piece (a filler is skipped); the contact label takes a second one.
    """
    names = sorted({lab.rstrip(":") for lab in (LABELS if labels is None else labels)})
    return let(stream, lambda pieces: let(_label_pairs(pieces, names), _last_of_key))


def _last_of_key(pairs: Column) -> Column:
    """The keys are few (labels), so one look from behind for each is linear in the page."""
    def last(behind: Column) -> Column:
        return let(F.transform(behind, lambda p: p["key"]), lambda keys: let(F.reverse(F.array_distinct(keys)), lambda each: F.map_from_arrays(
            each, F.transform(each, lambda k: F.get(behind, (F.array_position(keys, k) - 1).cast("int"))["value"]))))
    return let(F.reverse(pairs), last)


def _label_pairs(stream: Column, names: list[str]) -> Column:
    known = names + [n + ":" for n in names]
    pieces = F.transform(stream, lambda t, i: F.struct(
        F.rtrim(t, F.lit(":")).alias("key"), F.get(stream, i + 1).alias("next"),
        F.get(stream, i + 2).alias("after")))
    hits = F.filter(pieces, lambda p: p["key"].isin(names) & p["next"].isNotNull())

    def value(p: Column) -> Column:
        first = F.when(p["next"].isin(FILLERS) & p["after"].isNotNull(), p["after"]).otherwise(p["next"])
        second = (p["key"] == TWO_TOKEN_LABEL) & p["after"].isNotNull() \
            & ~p["after"].isin(FILLERS) & ~p["after"].isin(known)
        return F.when(second, F.concat(first, F.lit(" "), p["after"])).otherwise(first)

    return F.filter(F.transform(hits, lambda p: F.struct(p["key"].alias("key"), value(p).alias("value"))),
                    lambda p: p["value"] != "")


def label_rows(pages: DataFrame, labels: list[str] | None = None, html: str = "html") -> DataFrame:
    """P38/X2 as rows: (page columns, label, value)."""
    keep = [c for c in pages.columns if c != html]
    df = pages.select(*keep, text_stream(F.col(html)).alias("_stream"))
    return df.select(*keep, F.explode(label_values(F.col("_stream"), labels)).alias("label", "value"))


def element_texts(html: Column, tag: str, class_pattern: str | None = None) -> Column:
    """Texts of all ``tag`` elements, optionally with a matching class."""
    attrs = r"[^>]*" if class_pattern is None else rf"[^>]*\bclass\s*=\s*[\"'][^\"']*{class_pattern}[^\"']*[\"'][^>]*"
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b{attrs}>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(found, inner_text)


def meta(html: Column, attribute: str, name: str) -> Column:
    tag = F.regexp_extract(html, rf"(?is)<meta\b[^>]*\b{attribute}\s*=\s*[\"']{name}[\"'][^>]*>", 0)
    return blank_to_null(strip(entities(F.regexp_extract(tag, r"(?is)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1))))


def keywords(html: Column, class_pattern: str = r"\b(?:keyword|tag|skill)\b", min_chars: int = 2) -> Column:
    """Keyword elements and meta keywords; distinct, no short texts, no bare numbers."""
    marked = F.filter(element_texts(html, "span", class_pattern),
                      lambda t: (F.length(t) >= min_chars) & ~t.rlike(r"^\d+$"))
    listed = F.transform(F.split(F.coalesce(meta(html, "name", "keywords"), F.lit("")), ","), strip)
    return F.array_distinct(F.concat(marked, F.filter(listed, lambda t: t != "")))


def running_sum(values: Column) -> Column:
    """Running sums of an array of ints, in as many passes as its size has binary digits: each adds the sum
    that ends twice as far before, so no pass carries a growing array from element to element."""
    shifts = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(shifts, values, lambda acc, shift: F.transform(
        acc, lambda x, i: x + F.coalesce(F.get(acc, i - shift), F.lit(0))))


def container_index(markup: Column, tag: str = "div") -> Column:
    """struct(pieces, found): the page cut before each opening and closing ``tag``, and for every well-nested
    element, in page order and however deep, struct(start, stop, attrs) by pieces.

    On one level of nesting opening and closing tags alternate, so after sorting by (level, place) each
    opening tag stands before its closing one.  Tags without a partner are no elements, wherever they stand.
    """
    pieces = F.split(markup, rf"(?i)(?=</?{tag}\b)")
    steps = F.transform(pieces, lambda p: F.when(p.rlike(rf"(?i)^<{tag}\b"), 1).when(p.rlike(rf"(?i)^</{tag}\b"), -1).otherwise(0))

    def placed(steps: Column) -> Column:
        def own(depth: Column, i: Column) -> Column:
            step = F.get(steps, i)
            return F.struct(F.when(step < 0, depth + 1).otherwise(depth).alias("level"), i.alias("place"), step.alias("step"))
        return F.array_sort(F.filter(F.transform(running_sum(steps), own), lambda t: t["step"] != 0))

    def pairs(tags: Column) -> Column:
        return F.filter(F.transform(tags, lambda t, i: F.struct(
            t["place"].alias("start"), F.get(tags, i + 1)["place"].alias("stop"),
            ((t["step"] == 1) & (F.get(tags, i + 1)["step"] == -1) & (F.get(tags, i + 1)["level"] == t["level"])).alias("whole"))), lambda p: F.coalesce(p["whole"], F.lit(False)))

    def named(ps: Column, found: Column) -> Column:
        def attrs(p: Column) -> Column:
            head = F.get(ps, p["start"])  # a whole tag, unless an attribute holds another
            return F.regexp_extract(F.when(head.contains(">"), head).otherwise(_whole(ps, p)), r"^<[^\s>]*([^>]*)>", 1)
        return F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), attrs(p).alias("attrs")))

    return let(pieces, lambda ps: F.struct(ps.alias("pieces"), let(let(steps, placed), lambda tags: named(ps, F.array_sort(pairs(tags)))).alias("found")))


def _whole(pieces: Column, p: Column) -> Column:
    return F.array_join(F.slice(pieces, p["start"] + 1, p["stop"] - p["start"]), "")


def indexed(index: Column, wanted=None) -> Column:
    """Array of struct(attrs, inner) of an index's elements.  ``wanted`` (attrs -> condition) picks elements before
    their markup is put together, which alone can grow faster than the page (by its depth)."""
    found = index["found"] if wanted is None else F.filter(index["found"], lambda p: wanted(p["attrs"]))
    return F.transform(found, lambda p: F.struct(
        p["attrs"].alias("attrs"), F.regexp_replace(_whole(index["pieces"], p), r"^<[^>]*>", "").alias("inner")))


def containers(markup: Column, tag: str = "div", wanted=None) -> Column:
    """Array of struct(attrs, inner): the (wanted) elements of :func:`container_index`."""
    return let(container_index(markup, tag), lambda index: indexed(index, wanted))


def classes(attrs: Column) -> Column:
    return F.regexp_extract(attrs, r"(?is)\bclass\s*=\s*[\"']([^\"']*)[\"']", 1)


def lines_of(fragment: Column) -> Column:
    """The text pieces of a fragment, one a line."""
    text = F.array_join(text_stream(fragment), "\n")
    return F.regexp_replace(text, r" {2,}", " ")


def longest_block(html: Column, low: int = 200, high: int = 10_000, cut: int = 2500) -> Column:
    """The text of the longest container within bounds, cut.

    Whole ``div`` elements compete; those whose class names say that they frame the page are out.
    """
    free = containers(without_code(html), wanted=lambda attrs: ~F.lower(classes(attrs)).rlike("|".join(FRAME_CLASSES)))
    texts = F.filter(F.transform(free, lambda c: lines_of(c["inner"])), lambda t: (F.length(t) > low) & (F.length(t) < high))
    ranked = F.transform(texts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
    return F.substring(F.array_max(ranked)["t"], 1, cut)


# ---------------------------------------------------------------------------------------
# Rule-driven extraction
# ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class ExtractRule:
    """One candidate for a field.  ``kind`` says where to look:

    ``meta`` (attribute=name), ``tag`` (tag or tag.class), ``class`` (first element of that class),
    ``testid`` (first element with that data-testid, ``group`` 0; else a regex on the texts of all of
    them, after ``|``), ``heading`` (first h2 that is no generic one), ``box`` (text lines of the whole
    container of that class, if longer than ``group``), ``json`` (JSON-LD path), ``text`` (regex on the
    visible text), ``url`` (regex on the URL), ``slug`` (words of the URL's last part) or ``const``.
    ``pick`` keeps group 1 of a pattern on the value; without a match there is none.
    """

    provider: str
    field: str
    priority: int
    kind: str
    pattern: str
    group: int = 1
    cleanup: str | None = None
    pick: str | None = None


# The last provider is the fallback for every unknown one.
DEFAULT_PROVIDER_RULES = "default"
COMMON_RULES = [
    ExtractRule("default", "title", 1, "meta", "property=og:title"),
    ExtractRule("default", "title", 2, "tag", "h1"),
    ExtractRule("default", "title", 3, "tag", "title"),
    ExtractRule("default", "company", 1, "tag", "div.company"),
    ExtractRule("default", "company", 2, "json", "$.name"),
    ExtractRule("default", "company", 3, "text", r"(?i)(?:Firma|Company|Client|Kunde):\s*([^\n\r]+)"),
    ExtractRule("default", "location", 1, "tag", "div.location"),
    ExtractRule("default", "location", 2, "text", r"(?i)(?:Ort|Location|Standort|Einsatzort):\s*([^\n\r]+)"),
    ExtractRule("default", "reference_id", 1, "url", r"/projekt-(\d+)"),
    ExtractRule("default", "reference_id", 2, "url", r"([0-9]+)(?:\.html)?/?(?:[?#].*)?\z"),
    ExtractRule("default", "published", 1, "text", r"(\d{1,2}\.\d{1,2}\.\d{4})"),
]


# --- Fixed values: where the pages of the known sites keep their fields ------
_SUFFIX = r"(?i)\s*-\s*freelance\.de\s*$"
_PREFIX = r"(?i)^(?:Projekt|Ausschreibung|Job):\s*"
SITE_RULES = [
    ExtractRule("solcom", "title", 1, "meta", "property=og:title", cleanup=_PREFIX),
    ExtractRule("solcom", "title", 2, "heading", "h2", cleanup=_PREFIX),
    ExtractRule("solcom", "title", 3, "tag", "title", pick=r"(?i)^(.*?)\s*–\s*Freiberufler Projekt SOLCOM\s*$", cleanup=_PREFIX),
    ExtractRule("solcom", "title", 4, "slug", "", cleanup=_PREFIX),
    ExtractRule("solcom", "company", 1, "const", "Solcom GmbH"),
    ExtractRule("solcom", "reference_id", 1, "text", r"Projekt-Nr\.:?\s*(\S+)"),
    ExtractRule("solcom", "reference_id", 2, "url", r"-([^-/?#]+)(?:[?#].*)?\z"),
    ExtractRule("solcom", "description", 1, "box", "projekt-desc", 0),
    ExtractRule("solcom", "description", 2, "box", r"neos-nodetypes-text\S*", 0),
    ExtractRule("freelance", "title", 1, "meta", "property=og:title", cleanup=_SUFFIX),
    ExtractRule("freelance", "title", 2, "tag", "h1.project-title"),
    ExtractRule("freelance", "title", 3, "tag", "h1"),
    ExtractRule("freelance", "title", 4, "tag", "title", cleanup=_SUFFIX),
    *[ExtractRule("freelance", "company", k, "class", c) for k, c in enumerate(
        ["company-name", "client-name", "kunde", "project-company", "company"])],
    ExtractRule("freelance", "company", 9, "text", r"(?i)(?:Firma|Company|Client|Kunde):\s*([^\n\r]+)"),
    *[ExtractRule("freelance", "location", k, "class", c) for k, c in enumerate(
        ["location", "ort", "place", "project-location", "standort"])],
    ExtractRule("freelance", "location", 9, "text", r"(?i)(?:Ort|Location|Standort|Einsatzort):\s*([^\n\r]+)"),
    ExtractRule("freelance", "reference_id", 1, "url", r"/projekt-(\d+)"),
    *[ExtractRule("freelance", "description", k, "box", c, 100) for k, c in enumerate(
        ["project-description", "job-description", "projekt-beschreibung", "content-description", r"\S*description\S*", "main-content"])],
    ExtractRule("gulp", "title", 1, "testid", "projectTitle"),
    ExtractRule("gulp", "title", 2, "tag", "h1.gp-title"),
    ExtractRule("gulp", "company", 1, "testid", "contactPersonFullName"),
    ExtractRule("gulp", "location", 1, "testid", r"infoListItem|(?i)^(?:location|einsatzort)\s*(.+)"),
    *[ExtractRule("gulp", "location", 2 + k, "class", c) for k, c in enumerate(["location", "project-location", "einsatzort"])],
    ExtractRule("gulp", "published", 1, "testid", r"infoListItem|(\d{1,2}\.\d{1,2}\.\d{4})"),
    *[ExtractRule("gulp", "description", k, "box", c, 100) for k, c in enumerate(["gp-project-description", "project-description"])],
]
#: site -> (classes of keyword containers, classes of single keywords, least length)
SITE_KEYWORDS = {
    "solcom": ([], r"(?:tag|keyword|skill)", 2),
    "freelance": (["keywords", "tags", "skills", "schlagworte", "project-tags"], None, 2),
    "gulp": ([], r"(?:^|\s)(?:tag|label)(?:\s|$)", 6),
}


def site_of(url: Column) -> Column:
    """The known site of a page, else its host."""
    host = urls.host(url)
    return reduce(lambda acc, s: F.when(host.rlike(rf"(?:^|\.){s}\."), F.lit(s)).otherwise(acc), SITE_KEYWORDS, host)


def site_keywords(html: Column, site: str, index: Column | None = None) -> Column:
    """P39 by the rules of a site; freelance also reads the meta keywords.  ``index`` is the page's, if there is one."""
    boxes, single, least = SITE_KEYWORDS[site]
    found = F.expr(_NONE)
    for box in boxes:
        def wanted(attrs: Column, box: str = box) -> Column:
            return classes(attrs).rlike(rf"(?:^|\s){box}(?:\s|$)")
        hits = containers(html, wanted=wanted) if index is None else indexed(index, wanted)
        inner = F.get(hits, F.lit(0))["inner"]
        texts = F.regexp_extract_all(F.coalesce(inner, F.lit("")), F.lit(r"(?is)<(span|a|li|div)\b[^>]*>([^<]*)"), F.lit(2))
        found = F.concat(found, F.filter(F.transform(texts, inner_text), lambda t: ~t.rlike(r"^\d+$")))
    if single:
        marked = F.regexp_extract_all(html, F.lit(rf"(?is)<(?:span|div)\b[^>]*\bclass\s*=\s*[\"']([^\"']*)[\"'][^>]*>[^<]*"), F.lit(0))
        marked = F.filter(marked, lambda m: classes(m).rlike(single))
        found = F.concat(found, F.transform(marked, lambda m: inner_text(F.regexp_replace(m, r"^<[^>]*>", ""))))
    found = F.filter(found, lambda t: F.length(t) >= least)
    if boxes:
        listed = F.transform(F.split(F.coalesce(meta(html, "name", "keywords"), F.lit("")), ","), strip)
        found = F.array_distinct(F.concat(found, F.filter(listed, lambda t: t != "")))
    return found


def candidate(rule: ExtractRule, url: Column, html: Column, markup: Column, text: Column, boxes: Column) -> Column:
    """``markup`` is the page without scripts and comments, ``text`` its visible text, ``boxes`` the index of its containers."""
    if rule.kind == "meta":
        attribute, name = rule.pattern.split("=", 1)
        value = meta(markup, attribute, name)
    elif rule.kind == "tag":
        tag, _, cls = rule.pattern.partition(".")
        attrs = rf"[^>]*\bclass\s*=\s*[\"'][^\"']*\b{cls}\b[^\"']*[\"'][^>]*" if cls else r"[^>]*"
        value = inner_text(F.regexp_extract(markup, rf"(?is)<{tag}\b{attrs}>(.*?)</{tag}\s*>", 1))
    elif rule.kind == "class":
        value = inner_text(F.get(_by_attribute(markup, "class", rule.pattern), F.lit(0)))
    elif rule.kind == "testid":
        name, _, pattern = rule.pattern.partition("|")
        texts = F.transform(_by_attribute(markup, "data-testid", name), plain)
        if pattern:
            texts = F.filter(F.transform(texts, lambda t: F.regexp_extract(t, pattern, rule.group)), lambda t: t != "")
        value = F.get(texts, F.lit(0))
    elif rule.kind == "heading":
        value = F.get(F.filter(element_texts(markup, "h2"), lambda t: (F.length(t) > 10) & ~t.rlike(GENERIC_HEADING)), F.lit(0))
    elif rule.kind == "box":
        hits = indexed(boxes, lambda attrs: classes(attrs).rlike(rf"(?:^|\s){rule.pattern}(?:\s|$)"))
        value = F.get(F.filter(F.transform(hits, lambda c: lines_of(c["inner"])), lambda t: F.length(t) > rule.group), F.lit(0))
    elif rule.kind == "slug":
        last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*\z", ""), "/"), -1)
        value = F.initcap(F.translate(F.regexp_replace(last, r"-[^-]*\z", ""), "-", " "))
    elif rule.kind == "json":
        script = F.regexp_extract(
            html, r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", 1)
        value = F.get_json_object(script, rule.pattern)
    elif rule.kind == "text":
        value = strip(F.regexp_extract(text, rule.pattern, rule.group))
    elif rule.kind == "url":
        value = F.regexp_extract(url, rule.pattern, rule.group)
    else:
        value = F.lit(rule.pattern)
    if rule.pick:
        value = F.regexp_extract(value, rule.pick, 1)
    if rule.cleanup:
        value = strip(F.regexp_replace(value, rule.cleanup, ""))
    return blank_to_null(strip(value))


def _by_attribute(markup: Column, attribute: str, word: str) -> Column:
    """Contents of the elements whose attribute holds the word, up to their first closing tag."""
    return F.regexp_extract_all(markup, F.lit(
        rf"(?is)<(\w+)\b[^>]*\b{attribute}\s*=\s*[\"'](?:[^\"']*\s)?{word}(?:\s[^\"']*)?[\"'][^>]*>(.*?)</\1\s*>"), F.lit(2))


def extract_fields(pages: DataFrame, rules: list[ExtractRule], provider: Column | None = None,
                   url: str = "url", html: str = "html") -> DataFrame:
    """For each field the first non-empty candidate of the page's provider.

    Rules are configuration, so they become one ``coalesce`` per provider and field:
    the first hit decides, later candidates are not evaluated, and nothing is shuffled.
    """
    h, u = F.col(html), F.col(url)
    df = pages.withColumn("_markup", without_code(h)) \
        .withColumn("_visible", F.array_join(text_stream(F.col("_markup")), "\n")) \
        .withColumn("_provider", provider if provider is not None else urls.host(u))
    providers = sorted({r.provider for r in rules} - {DEFAULT_PROVIDER_RULES})
    # One index of a page's containers serves all rules; pages whose rules need none are not indexed.
    boxed = sorted({r.provider for r in rules if r.kind == "box"})
    needs = F.lit(True) if DEFAULT_PROVIDER_RULES in boxed else F.col("_provider").isin(boxed)
    if boxed:
        df = df.withColumn("_boxes", F.when(needs, container_index(F.col("_markup"))))

    def first(provider_id: str, field: str) -> Column:
        ordered = sorted((r for r in rules if r.provider == provider_id and r.field == field),
                         key=lambda r: r.priority)
        found = [candidate(r, u, h, F.col("_markup"), F.col("_visible"), F.col("_boxes")) for r in ordered]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    for field in dict.fromkeys(r.field for r in rules):
        value = reduce(lambda acc, p: F.when(F.col("_provider") == p, first(p, field)).otherwise(acc),
                       providers, first(DEFAULT_PROVIDER_RULES, field))
        df = df.withColumn(field, value)
    return df.drop("_markup", "_visible", "_boxes", "_provider")


def parse_pages(pages: DataFrame, rules: list[ExtractRule] | None = None,
                description_heading: str = "Beschreibung") -> DataFrame:
    """Pages to the unified schema; details without a value are left out."""
    html = F.col("html")
    fallback = [ExtractRule(DEFAULT_PROVIDER_RULES, "description", 1, "const", "")]
    df = extract_fields(pages, rules or COMMON_RULES + SITE_RULES + fallback, site_of(F.col("url")))
    text = F.coalesce(F.col("description") if "description" in df.columns else F.lit(None).cast("string"),
                      section(html, description_heading), longest_block(html))
    site = site_of(F.col("url"))
    boxed = [s for s, (boxes, _, _) in SITE_KEYWORDS.items() if boxes]
    df = df.withColumn("_index", F.when(site.isin(boxed), container_index(html)))
    words = reduce(lambda acc, s: F.when(site == s, site_keywords(html, s, F.col("_index"))).otherwise(acc), SITE_KEYWORDS, keywords(html))
    return df.withColumns({
        "description": text,
        "schlagworte": words,
        "details": F.map_filter(label_values(text_stream(html)), lambda _, v: v.isNotNull()),
    }).drop("html", "_index")
