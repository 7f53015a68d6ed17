"""Landed feeds and alert messages."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_feed_xml(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Landed RSS/Atom files.  Dates stay text until :func:`with_entry_date`."""
    schema = ("title string, link string, description string, summary string, guid string, "
              "pubDate string, updated string")
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).select(
        F.col("_metadata.file_path").alias("feed"),
        # One landed file is read in order, so the id grows with the position in the feed.
        F.monotonically_increasing_id().alias("entry_ord"),
        F.coalesce("title", F.lit("No Title")).alias("title"),
        F.coalesce("link", F.lit("")).alias("link"),
        F.coalesce("summary", "description", F.lit("")).alias("summary"),
        F.coalesce("guid", "link", F.lit("")).alias("id"),
        F.coalesce(
            rfc_timestamp(F.col("pubDate")), F.try_to_timestamp("pubDate"),
            F.try_to_timestamp("updated")).alias("published"))


def rfc_timestamp(text: Column) -> Column:
    """``Mon, 05 Oct 2026 10:00:00 +0000``; the weekday carries no information."""
    plain = F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(plain, r"\s+(?:GMT|UTC|UT|Z)\s*\z", " +0000")
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))


def first_entries(entries: DataFrame, default_limit: int = 5, limit: str | None = None,
                  max_limit: int | None = None, by: tuple[str, ...] = ("feed",)) -> DataFrame:
    """The first entries of each feed.

    ``limit`` may name a column with the feed's own limit; ``max_limit`` is then the
    largest of them.  The constant bound lets Spark cut each feed before the shuffle,
    so one huge feed never lands in one task.  Feeds with a null limit are not ranked:
    all their entries stay.
    """
    bound = max_limit if limit else default_limit
    w = Window.partitionBy(*by).orderBy("entry_ord")
    limited = entries.where(F.col(limit).isNotNull()) if limit else entries
    ranked = limited.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= bound)
    if not limit:
        return ranked.drop("_rank")
    return ranked.where(F.col("_rank") <= F.col(limit)).drop("_rank").unionByName(entries.where(F.col(limit).isNull()))


def recent(entries: DataFrame, now: dt.datetime, max_age_days: int | str) -> DataFrame:
    """Undated entries stay, 0 switches the rule off."""
    days = F.col(max_age_days) if isinstance(max_age_days, str) else F.lit(max_age_days)
    cutoff = F.lit(now) - F.make_dt_interval(days)
    return entries.where((days == 0) | F.col("published").isNull() | (F.col("published") >= cutoff))


def scan(entries: DataFrame, now: dt.datetime, limit: int = 5, max_age_days: int = 7) -> DataFrame:
    """The limit comes first, then the age rule."""
    return recent(first_entries(entries, limit), now, max_age_days)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """U2."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def latest_messages(messages: DataFrame, now: dt.datetime, max_age_days: int = 7,
                    max_emails: int = 50, order: tuple[str, ...] = ("ts", "message_id")) -> DataFrame:
    """Per mailbox the most recent messages of the last days."""
    day = F.lit((now - dt.timedelta(days=max_age_days)).date())
    w = Window.partitionBy("mailbox").orderBy(*[F.desc(c) for c in order])
    return messages.where(F.to_date("ts") >= day) \
        .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max_emails).drop("_rank")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """S10 landing step: RFC-822 files to one row per message.

    Decoding is the only part that needs Python; Spark spreads the files over tasks.
    """
    import email
    import email.policy
    from email.utils import parsedate_to_datetime

    import pandas as pd

    def decode(batches):
        for batch in batches:
            rows = []
            for path_, content in zip(batch["path"], batch["content"]):
                msg = email.message_from_bytes(content, policy=email.policy.default)
                text, html = [], []
                for part in msg.walk():
                    kind = part.get_content_type()
                    if kind in ("text/plain", "text/html"):
                        payload = part.get_payload(decode=True) or b""
                        (text if kind == "text/plain" else html).append(
                            payload.decode("utf-8", errors="ignore"))
                try:
                    when = parsedate_to_datetime(str(msg["Date"])).astimezone(dt.timezone.utc)
                    ts = when.replace(tzinfo=None).isoformat(sep=" ")
                except (TypeError, ValueError):
                    ts = None
                rows.append((path_.rsplit("/", 2)[-2], path_, ts, str(msg["From"] or ""),
                             str(msg["Subject"] or ""), "\n".join(text), "\n".join(html)))
            yield pd.DataFrame(rows, columns=["mailbox", "message_id", "ts", "sender", "subject",
                                              "text", "html"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = ("mailbox string, message_id string, ts string, sender string, subject string, "
              "text string, html string")
    return raw.mapInPandas(decode, schema).withColumn("ts", F.try_to_timestamp("ts"))
