"""Schemas and fixed domains of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 2
DEFAULT_PROVIDER = "freelancermap"

# --- Fixed values: state domain and transition matrix ------------------------
STATES = ["scraped", "evaluated", "rejected", "accepted", "applied", "sent", "open", "archived"]
TRANSITIONS = {
    "scraped": ["evaluated", "rejected", "accepted"],
    "evaluated": ["accepted", "rejected"],
    "rejected": ["accepted", "applied", "archived"],
    "accepted": ["applied", "rejected"],
    "applied": ["sent", "archived", "open"],
    "sent": ["open", "archived"],
    "open": ["archived", "applied"],
    "archived": ["scraped", "accepted", "rejected"],
}

# --- Fixed values: ledger decisions, entry classes, dispatch actions ---------
CAPTURED, FILTERED, EXISTING, ERROR = "captured", "filtered", "existing", "error"
CLASSES = ["new", "known", "filtered", "errors", "deferred"]
CREATED, MERGED, SKIPPED = "created", "merged", "skipped"

SOURCE = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("discovered_at", T.StringType()),
    T.StructField("channel", T.StringType()),
])
STATE_CHANGE = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("override", T.BooleanType()),
    T.StructField("ui_context", T.BooleanType()),
])
CHECK = T.StructType([
    T.StructField("criterion", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("value_found", T.StringType()),
    T.StructField("was_unknown", T.BooleanType()),
])
FEED_ENTRY = T.StructType([
    T.StructField("provider", T.StringType()),
    T.StructField("feed", T.StringType()),
    T.StructField("entry_ord", T.LongType()),
    T.StructField("link", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("published", T.TimestampType()),
])
LEDGER = T.StructType([
    T.StructField("url_key", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("provider", T.StringType()),
    T.StructField("feed", T.StringType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("basis", T.StringType()),
    T.StructField("errors", T.IntegerType()),
    T.StructField("last_error", T.StringType()),
])
LEDGER_DECISION = T.StructType([
    T.StructField("url_key", T.StringType()),
    T.StructField("group_id", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("terms", T.StringType()),
])
COST_ENTRY = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("reservation_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("cost_usd", T.DecimalType(18, 6)),
    T.StructField("input_tokens", T.IntegerType()),
    T.StructField("output_tokens", T.IntegerType()),
    T.StructField("cache_hit", T.BooleanType()),
])
RESPONSE = T.StructType([
    T.StructField("evaluations", T.ArrayType(T.StructType([
        T.StructField("profile_id", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("matched", T.StringType()),
        T.StructField("missing", T.StringType()),
        T.StructField("rationale", T.StringType()),
    ]))),
])
