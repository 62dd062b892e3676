"""Calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("daily", "weekly", "monthly")


def bucket(ts: Column | str, grain: str) -> Column:
    """ISO date, ISO year and week (2027-01-01 is 2026-W53), or year and month, as text."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if grain == "daily":
        return F.date_format(ts, "yyyy-MM-dd")
    if grain == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
    if grain == "monthly":
        return F.date_format(ts, "yyyy-MM")
    raise ValueError(f"grain must be one of {GRAINS}")


ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
ZONED = r"[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$"


def iso_time(c: Column | str) -> Column:
    """ISO text as a timestamp, without zone as UTC; null for anything else, so also for a bare year."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike(ISO), F.replace(c, F.lit("T"), F.lit(" ")).try_cast("timestamp"))


def zoned_iso_time(c: Column | str) -> Column:
    """As iso_time, but a zone is required."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(c.rlike(ZONED), iso_time(c))


def time_or_clock(c: Column | str, clock: Column) -> Column:
    """Empty or null gives the clock; a text that is no ISO time is an error."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(c, F.lit("")) == "", clock).otherwise(F.coalesce(iso_time(c), F.raise_error(F.concat(F.lit("not an ISO time: "), c)).cast("timestamp")))


def observed_at(as_of: Column, fetched_at: Column, *fields: Column) -> Column:
    """The first of the payload's own times, else as_of, else when it was fetched; all as text."""
    return F.coalesce(*(F.when(f.cast("string") != "", f.cast("string")) for f in (*fields, as_of)), F.date_format(fetched_at, "yyyy-MM-dd'T'HH:mm:ss"))


def run_id(clock: Column, source: Column) -> Column:
    return F.concat(F.date_format(clock, "yyyyMMdd'T'HHmmssSSSSSS'Z'"), F.lit("-"), source)
