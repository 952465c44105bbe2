"""Instants and wall clocks of ISO-8601 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def instant(raw: Column) -> Column:
    """TIMESTAMP of ISO text, null if it is none; text without a zone is UTC."""
    raw = F.trim(raw)
    return F.when(raw.rlike(_ISO), F.try_to_timestamp(raw))


def iso(ts: Column) -> Column:
    """ISO text in UTC; six digits of fraction where there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(whole, F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def wall_date(raw: Column) -> Column:
    """The date that the text itself shows, whatever its zone."""
    return F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd")


def wall_hour(raw: Column) -> Column:
    """The hour that the text itself shows."""
    hour = F.regexp_extract(raw, r"^\d{4}-\d{2}-\d{2}[T ](\d{2})", 1)
    return F.when(hour != "", hour.cast("int"))


def wall_weekday(raw: Column) -> Column:
    return F.date_format(wall_date(raw), "EEEE")


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)

