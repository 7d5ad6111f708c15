"""Scalar functions on columns. Null in, null out; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of a valid mobile number and e-mail address.
PHONE_PATTERN = r"^(13[0-9]|14[01456879]|15[0-35-9]|16[2567]|17[0-8]|18[0-9]|19[0-35-9])\d{8}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9_-]+@[a-zA-Z0-9_-]+(\.[a-zA-Z0-9_-]+)+$"


def local_shift() -> Column:
    """Distance of the business time zone (+08:00) from UTC."""
    return F.expr("interval 8 hours")


def mask_name(name: Column) -> Column:
    """First character kept, every further one becomes a star."""
    return F.concat(F.left(name, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.length(name) - 1, F.lit(0))))


def _whole(text: Column, pattern: str) -> Column:
    # `$` also matches before a closing line break; a whole-string match must not.
    return text.rlike(pattern[:-1] + r"\z")


def is_phone(text: Column) -> Column:
    return _whole(text, PHONE_PATTERN)


def is_email(text: Column) -> Column:
    return _whole(text, EMAIL_PATTERN)


def md5_if(valid: Column, text: Column) -> Column:
    return F.when(valid, F.md5(text))


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def date_of_epoch_days(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def _zoned(text: Column, zone: str) -> Column:
    """An instant of a text by its own zone, else by `zone`; the session's zone has no say."""
    text = F.trim(text)
    day_only, has_zone = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.rlike(r"(?:[Zz]|[+-]\d{1,2}:?\d{2})$") & text.rlike(":")
    return F.try_to_timestamp(
        F.when(day_only, F.concat(text, F.lit(f" 00:00:00{zone}"))).when(has_zone, text).otherwise(F.concat(text, F.lit(zone))))


def _utc_clock(instant: Column) -> Column:
    """The UTC wall clock of an instant, as a value without a zone."""
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_micros(instant.cast("timestamp")).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since


def instant_of_iso(text: Column) -> Column:
    """`2024-01-01T08:00:00Z`, or the same with a blank and no zone, as a UTC instant."""
    return _zoned(text, "Z")


def instant_of_wall_millis(millis: Column) -> Column:
    """Epoch milliseconds of a local (+08:00) wall clock written as if it were UTC."""
    return F.timestamp_millis(millis.try_cast("long")) - local_shift()


def instant_of_local_text(text: Column) -> Column:
    """Local (+08:00) date or date-time text as an instant."""
    return _zoned(text, "+08:00")


def millis(instant: Column) -> Column:
    return F.unix_millis(instant)


def local_day(instant: Column) -> Column:
    """Business day (UTC+8) of an instant."""
    return F.date_from_unix_date(F.floor((F.unix_millis(instant.cast("timestamp")) + 28_800_000) / 86_400_000).cast("int"))


def text_day(instant: Column) -> Column:
    return F.date_format(_utc_clock(instant), "yyyy-MM-dd")


def text_time(instant: Column) -> Column:
    return F.date_format(_utc_clock(instant), "yyyy-MM-dd HH:mm:ss")


def compact_day(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def day_of_report_date(text: str) -> str:
    """Report dates come as `yyyyMMdd` or `yyyy-MM-dd`; both name the same day."""
    digits = text.replace("-", "")
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}"


def csv_items(text: Column) -> Column:
    """Items of a comma separated list; an empty list for null or empty text."""
    return F.when(non_empty(text).isNull(), F.array().cast("array<string>")).otherwise(F.split(text, ","))


def utf8(payload: Column) -> Column:
    """Text of a binary payload; null and empty payloads give null."""
    return non_empty(F.decode(payload, "UTF-8"))
