"""Filename timestamps and relative date ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from .text import blank_to_null

# --- Fixed values: timestamp forms in file names, in order -------------------
FILE_STAMPS = [
    (r"\d{8}_\d{6}", "yyyyMMdd_HHmmss"),
    (r"\d{8}_\d{4}", "yyyyMMdd_HHmm"),
    (r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"\d{8}", "yyyyMMdd"),
]


def file_timestamp(name: Column) -> Column:
    """P25: the first form whose first hit is a valid date."""
    return F.coalesce(*[
        F.try_to_timestamp(blank_to_null(F.regexp_extract(name, pattern, 0)), F.lit(form))
        for pattern, form in FILE_STAMPS])


def server_range(label: Column, today: Column) -> Column:
    """struct(date_from, date_to); weeks start on Monday."""
    none = F.lit(None).cast("date")
    monday = F.date_trunc("week", today).cast("date")
    first = F.date_trunc("month", today).cast("date")

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("date_from"), b.alias("date_to"))

    return F.when(label == "today", span(today, none)) \
        .when(label == "last_7_days", span(F.date_sub(today, 7), none)) \
        .when(label == "current_week", span(monday, none)) \
        .when(label == "previous_week", span(F.date_sub(monday, 7), F.date_sub(monday, 1))) \
        .when(label == "current_month", span(first, none)) \
        .when(label == "previous_month", span(
            F.add_months(first, -1).cast("date"), F.date_sub(first, 1))) \
        .otherwise(span(F.try_to_date(label, "yyyy-MM-dd"), none))


def ui_range(label: Column, today: Column) -> Column:
    """struct(date_from, date_to); weeks start on Sunday."""
    sunday = F.date_sub(today, F.dayofweek(today) - 1)
    first = F.date_trunc("month", today).cast("date")

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.alias("date_from"), b.alias("date_to"))

    return F.when(label == "today", span(today, today)) \
        .when(label == "last_2_days", span(F.date_sub(today, 1), today)) \
        .when(label == "last_3_days", span(F.date_sub(today, 2), today)) \
        .when(label == "last_10_days", span(F.date_sub(today, 9), today)) \
        .when(label == "this_week", span(sunday, today)) \
        .when(label == "last_week", span(F.date_sub(sunday, 7), F.date_sub(sunday, 1))) \
        .when(label == "this_month", span(first, today)) \
        .when(label == "last_month", span(
            F.add_months(first, -1).cast("date"), F.date_sub(first, 1)))


def resolve_server_range(label: str | None, today: dt.date) -> tuple[str | None, str | None]:
    """P30 for a filter parameter: two ISO dates on the driver."""
    monday = today - dt.timedelta(days=today.weekday())
    first = today.replace(day=1)
    last_of_previous = first - dt.timedelta(days=1)
    ranges = {
        "today": (today, None),
        "last_7_days": (today - dt.timedelta(days=7), None),
        "current_week": (monday, None),
        "previous_week": (monday - dt.timedelta(days=7), monday - dt.timedelta(days=1)),
        "current_month": (first, None),
        "previous_month": (last_of_previous.replace(day=1), last_of_previous),
    }
    if label in ranges:
        return tuple(d.isoformat() if d else None for d in ranges[label])
    return label, None
