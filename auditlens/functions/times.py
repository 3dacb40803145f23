"""Time expressions on epoch microseconds; the session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BUCKET_US, DAY_US, MICROS

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2}(:\d{2})?)?)?$"
_BASIC = r"^\d{8}T\d{6}$"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def iso_us(text: Column) -> Column:
    """Microseconds of an ISO-8601 text, null if it is none; without a zone it is UTC."""
    t = F.trim(text)
    # hour-only and comma fractions are spelt out for the cast
    plain = F.regexp_replace(F.regexp_replace(t, ",", "."), r"([T ]\d{2})(Z|[+-].*)?$", "$1:00$2")
    zoned = F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2")
    usual = F.when(t.rlike(_ISO), F.unix_micros(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(zoned).try_cast("timestamp")))
    basic = F.when(t.rlike(_BASIC), F.unix_micros(F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss"))))
    return F.coalesce(usual, basic)


def epoch_us(text: Column) -> Column:
    """Microseconds of a decimal number of seconds, null if it is none."""
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), F.round(t.try_cast("double") * MICROS).try_cast("bigint"))


def bucket(t_us: Column) -> Column:
    """Number of the half hour since the epoch (floor, also before it)."""
    return F.floor(t_us / BUCKET_US).cast("long")


def hour_of_day(t_us: Column) -> Column:
    return F.pmod(t_us, F.lit(DAY_US)) / 3.6e9


def iso_text(t_us: Column) -> Column:
    """UTC ISO text; the fraction appears only when there is one."""
    t = F.timestamp_micros(t_us)
    whole = F.pmod(t_us, F.lit(MICROS)) == 0
    return F.when(whole, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def iso_range(start: Column, end: Column) -> Column:
    return F.concat(iso_text(start), F.lit(" — "), iso_text(end))
