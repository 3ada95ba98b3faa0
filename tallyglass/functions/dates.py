"""Dates in the exchange's fixed offset (+05:30, no daylight saving).  The session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions.text import JS_BLANK_CHARS, strip_blank

IST = "+05:30"


def ist_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, IST))


def ist_date_of_seconds(seconds: Column) -> Column:
    return ist_date(F.timestamp_seconds(seconds))


def parse_published(text: Column) -> Column:
    """A feed's date text as an instant.  A bare ``yyyy-MM-dd HH:mm:ss`` is UTC; unreadable -> null."""
    text = strip_blank(text, JS_BLANK_CHARS)
    mail = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.when(mail.rlike(r"^\d{1,2} "), F.coalesce(
            F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss z")),
            F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss xx")),
        )),
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)),
    )


def add_days(date: Column, days: int) -> Column:
    return F.date_add(date, days)
