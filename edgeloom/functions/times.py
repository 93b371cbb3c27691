"""Times as integer milliseconds, cut after the third digit, never through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS = r"^([0-9]+)(?:\.([0-9]{0,3}).*)?$"


def timestamp_ms(text: Column) -> Column:
    """Decimal seconds as milliseconds; null for what isn't."""
    whole, part = F.regexp_extract(text, SECONDS, 1), F.regexp_extract(text, SECONDS, 2)
    return F.when(text.rlike(SECONDS), whole.try_cast("bigint") * 1000 + F.rpad(part, 3, "0").try_cast("bigint"))


def seconds_of_nanos(text: Column) -> Column:
    """Whole nanoseconds as text of decimal seconds with three digits; null for what isn't."""
    ms = F.try_divide(text.try_cast("decimal(38,0)"), F.lit(1_000_000).cast("decimal(38,0)"))
    ms = F.floor(ms).cast("bigint")
    return seconds_text(ms)


def seconds_text(ms: Column) -> Column:
    """Milliseconds as decimal seconds with three digits."""
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))


def epoch_ms(timestamp: str) -> Column:
    """A timestamp column as milliseconds."""
    return F.expr(f"unix_micros(cast({timestamp} as timestamp)) div 1000")
