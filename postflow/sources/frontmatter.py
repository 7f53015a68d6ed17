"""Annotated documents: header/body split, header values, typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls
from ..functions.text import blank_to_null, let, rest, strip
from ..model import SCHEMA_VERSION, SOURCE, STATE_CHANGE
from .folders import read_files

# --- Fixed values: the header keys the record model knows --------------------
KNOWN_KEYS = [
    "schema_version", "project_id", "title", "state", "company", "location", "provider",
    "provider_url", "created_at", "updated_at", "pre_eval_score", "llm_score", "fit_score",
    "search_groups", "sources", "state_history",
]
SCALARS = ["company", "location", "provider", "provider_url", "created_at", "updated_at"]
SCORES = ["pre_eval_score", "llm_score", "fit_score"]

# Header up to the first later line that holds only "---".
_SPLIT = r"(?s)^---[^\n]*\n((?:.*?\n)??)[^\S\n]*---[^\S\n]*(?:\n(.*))?\z"
_EMPTY_STRINGS = "cast(array() as array<string>)"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, read as bytes; neither its name nor its text passes the driver."""
    return read_files(spark, path).select("path", F.col("content").cast("string").alias("content"))


def has_header(content: Column) -> Column:
    return content.rlike(_SPLIT)


def header_text(content: Column) -> Column:
    return F.regexp_extract(content, _SPLIT, 1)


def body_text(content: Column) -> Column:
    """Text without a (complete) header is body as a whole."""
    return F.when(has_header(content), F.regexp_extract(content, _SPLIT, 2)).otherwise(content)


def header_map(content: Column) -> Column:
    """Top-level keys to their raw text; a bad header gives an empty map.

    A key starts in column 0; indented lines and list items belong to the key above.
    """
    entries = F.split(F.concat(F.lit("\n"), header_text(content)), r"\n(?=[^\s#\-'\"\[{][^:\n]*:(?:\s|\z))")
    entries = F.filter(entries, lambda e: strip(e) != "")
    return let(entries, _entries_to_map)


def _entries_to_map(entries: Column) -> Column:
    well_formed = F.forall(entries, lambda e: e.rlike(r"(?s)^[^\s:][^:\n]*:(?:\s.*)?\z"))
    pairs = F.transform(entries, lambda e: F.struct(
        strip(F.regexp_extract(e, r"(?s)^([^:\n]*):", 1)).alias("key"),
        F.regexp_replace(F.regexp_extract(e, r"(?s)^[^:\n]*:(.*)\z", 1), r"\s+\z", "").alias("value")))

    def last_of_key(found: Column) -> Column:
        return F.filter(found, lambda p, i: ~F.exists(
            F.slice(found, i + 2, F.size(found)), lambda q: q["key"] == p["key"]))

    return F.when(well_formed, F.map_from_entries(let(pairs, last_of_key))).otherwise(
        F.expr("cast(map() as map<string,string>)"))


def scalar(raw: Column) -> Column:
    """A plain or quoted scalar; folded lines are joined, null words become null."""
    value = strip(F.regexp_replace(raw, r"\n\s+", " "))
    single = F.replace(F.regexp_extract(value, r"(?s)^'(.*)'\z", 1), F.lit("''"), F.lit("'"))
    double = F.replace(F.regexp_extract(value, r'(?s)^"(.*)"\z', 1), F.lit('\\"'), F.lit('"'))
    return F.when(value.rlike(r"(?s)^'.*'\z"), single).when(value.rlike(r'(?s)^".*"\z'), double) \
        .when(F.lower(value).isin("", "null", "~"), F.lit(None).cast("string")).otherwise(value)


def string_list(raw: Column) -> Column:
    """``- item`` lines, ``[a, b]`` or a single scalar as a list; nothing as an empty list."""
    value = strip(F.coalesce(raw, F.lit("")))
    items = F.when(value.rlike(r"^- "), rest(
        F.split(F.concat(F.lit("\n"), value), r"\n\s*-\s+"))) \
        .when(value.rlike(r"(?s)^\[.*\]\z"), F.split(
            F.regexp_extract(value, r"(?s)^\[(.*)\]\z", 1), r"\s*,\s*")) \
        .otherwise(F.array(value))
    return F.filter(F.transform(items, scalar), lambda v: v.isNotNull())


def record_list(raw: Column) -> Column:
    """``- key: value`` blocks as an array of string maps."""
    value = strip(F.coalesce(raw, F.lit("")))
    items = rest(F.split(F.concat(F.lit("\n"), value), r"\n\s*-\s+"))
    return F.transform(items, lambda item: F.map_from_entries(F.transform(
        F.filter(F.split(item, r"\n\s*(?=[A-Za-z_]+:)"), lambda v: v.contains(":")),
        lambda v: F.struct(strip(F.regexp_extract(v, r"^([^:]*):", 1)).alias("key"),
                           scalar(F.regexp_extract(v, r"(?s)^[^:]*:(.*)\z", 1)).alias("value")))))


def parse(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``header`` (raw string map) and ``body``."""
    c = F.col(content)
    return df.withColumns({"header": header_map(c), "body": body_text(c)})


def _typed(records: Column, schema) -> Column:
    def field(m: Column, f) -> Column:
        return m[f.name].try_cast(f.dataType).alias(f.name)
    return F.transform(records, lambda m: F.struct(*[field(m, f) for f in schema.fields]))


def to_records(df: DataFrame) -> DataFrame:
    """Header map to the typed posting of schema v2; v1 rows get derived fields."""
    raw = F.col("header")

    def text(key: str) -> Column:
        return scalar(raw[key])

    sources = _typed(record_list(raw["sources"]), SOURCE)
    derived = F.array(F.struct(
        text("provider").alias("provider"), text("provider_url").alias("url"),
        F.coalesce(text("created_at"), F.lit("")).alias("discovered_at"),
        F.lit(None).cast("string").alias("channel")))
    has_provider = (F.coalesce(text("provider"), F.lit("")) != "") & \
        (F.coalesce(text("provider_url"), F.lit("")) != "")
    row_hash = F.to_json(raw)
    return df.select(
        "*",
        F.coalesce(text("schema_version").try_cast("int"), F.lit(1)).alias("source_version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.coalesce(blank_to_null(text("project_id")), urls.project_id(
            text("provider_url"), text("title"), row_hash)).alias("project_id"),
        F.coalesce(text("title"), F.lit("")).alias("title"),
        F.coalesce(text("state"), F.lit("scraped")).alias("state"),
        *[text(k).alias(k) for k in SCALARS],
        *[text(k).try_cast("int").alias(k) for k in SCORES],
        string_list(raw["search_groups"]).alias("search_groups"),
        F.when(F.size(sources) > 0, sources).when(has_provider, derived)
        .otherwise(F.slice(derived, 1, 0)).alias("sources"),
        _typed(record_list(raw["state_history"]), STATE_CHANGE).alias("state_history"),
        F.transform_values(F.map_filter(raw, lambda k, _: ~k.isin(KNOWN_KEYS)),
                           lambda _, v: scalar(v)).alias("extra"),
    ).drop("header")


def _yaml(value: Column) -> Column:
    """A scalar as text; quoted when it would not read back as the same string."""
    risky = value.rlike(r"(?s)^\s|\s\z|: |:\z| #|^[\-?:,\[\]{}#&*!|>'\"%@`]|^(?i:null|true|false|yes|no|on|off|~)?\z"
                        r"|^[\d.+\-][\d.:eE_T+\-]*\z|\n")
    return F.when(risky, F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))) \
        .otherwise(value)


def _block(key: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{key}:\n"), F.array_join(items, "\n")))


def _struct_items(col: str, schema) -> Column:
    def item(s: Column) -> Column:
        lines = [F.concat(F.lit(f"{f.name}: "), _yaml(s[f.name].cast("string")))
                 for f in schema.fields]
        return F.concat(F.lit("- "), F.concat_ws("\n  ", *lines))
    return F.transform(F.col(col), item)


def to_front_matter(df: DataFrame, body: str = "body") -> DataFrame:
    """S4, text form: ``content`` of a v2 document; null scalars and empty lists are omitted."""
    def line(k: str) -> Column:
        return F.concat(F.lit(f"{k}: "), _yaml(F.col(k).cast("string")))

    extra = F.transform(F.map_entries("extra"), lambda e: F.concat(
        e["key"], F.lit(": "), _yaml(F.coalesce(e["value"], F.lit("null")))))
    numbers = [F.concat(F.lit(f"{k}: "), F.col(k).cast("string")) for k in SCORES]
    content = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("schema_version: "), F.col("schema_version").cast("string")),
        *[line(k) for k in ("project_id", "title", "state", *SCALARS)], *numbers,
        _block("search_groups", F.transform("search_groups", lambda g: F.concat(F.lit("- "), _yaml(g)))),
        _block("sources", _struct_items("sources", SOURCE)),
        _block("state_history", _struct_items("state_history", STATE_CHANGE)),
        F.when(F.size(extra) > 0, F.array_join(extra, "\n")),
        F.lit("---"), F.lit(""), F.col(body))
    return df.withColumn("content", content)


def write_postings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by state, so that a state filter prunes folders."""
    df.write.mode(mode).partitionBy("state").parquet(path)


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4, export: one text record per posting."""
    to_front_matter(df).select("content").write.mode(mode).option("lineSep", "\x00\n").text(path)
