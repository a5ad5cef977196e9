"""Tolerant casts of log text: timestamps and status codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

_WEB_TIME = r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2} [+-]\d{2}(:?\d{2})?$"
_SYSLOG_TIME = r"^[A-Za-z]{3} \d"
_DASHED_DATE = r"^\d{4,}-\d{1,2}-\d{1,2}"
_DETACHED_OFFSET = r":\d{2}(\.\d+)? +[+-]\d"
_SLASHED_DATE = r"^(\d{4})/(\d{1,2})/(\d{1,2})"
# Whole seconds that still fit a microsecond timestamp.
_MAX_EPOCH_SECONDS = 9_000_000_000_000


def _plain_double(text: Column) -> Column:
    """Text as a double; a cast alone would also take the type suffixes d and f."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def _epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(F.when(F.abs(seconds) <= F.lit(_MAX_EPOCH_SECONDS), seconds))


def _ntz(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def event_time(col: Column, dtype: T.DataType) -> Column:
    """Any log timestamp as naive UTC; unparseable input is NULL.

    The shapes exclude each other, so a row is parsed by at most two formats
    instead of running down a list of failing attempts. A timestamp without a year
    is placed in 1900. Needs a UTC session (see ``configure``).
    """
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return _ntz(col)
    if isinstance(dtype, T.IntegralType):
        return _ntz(_epoch(col.cast("bigint")))
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return _ntz(_epoch(F.bround(col.cast("double"), 0).try_cast("bigint")))
    if not isinstance(dtype, T.StringType):
        return F.lit(None).cast("timestamp_ntz")

    trimmed = F.trim(col, F.lit(" \t\r\n"))
    blanks = trimmed.contains("  ") | trimmed.contains("\t")
    text = F.when(blanks, F.regexp_replace(trimmed, r"[ \t]+", " ")).otherwise(trimmed)
    iso = F.when(trimmed.contains("/"), F.regexp_replace(trimmed, _SLASHED_DATE, r"$1-$2-$3")).otherwise(trimmed)

    def parse(value: Column, pattern: str) -> Column:
        return F.try_to_timestamp(value, F.lit(pattern))

    number = F.coalesce(trimmed.try_cast("bigint"), F.round(_plain_double(trimmed), 0).try_cast("bigint"))
    return (
        F.when(
            text.rlike(_WEB_TIME),
            _ntz(F.coalesce(
                parse(text, "d/MMM/yyyy:H:m:s XX"),
                parse(text, "d/MMM/yyyy:H:m:s XXX"),
                parse(text, "d/MMM/yyyy:H:m:s X"),
            )),
        )
        .when(text.rlike(_SYSLOG_TIME), _ntz(parse(F.concat(F.lit("1900 "), text), "yyyy MMM d H:m:s")))
        .when(
            iso.rlike(_DASHED_DATE) & ~iso.rlike(_DETACHED_OFFSET),
            _ntz(F.coalesce(iso.try_cast("timestamp"), parse(iso, "yyyy-M-d H:m:s"))),
        )
        .otherwise(_ntz(_epoch(number)))
    )


def status_number(col: Column, dtype: T.DataType, target: str) -> Column:
    """Status code as ``target`` (int or bigint); text that is no number is NULL."""
    if isinstance(dtype, T.StringType):
        text = F.nullif(F.trim(col), F.lit(""))
        return F.coalesce(text.try_cast(target), F.round(_plain_double(text), 0).try_cast(target))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.bround(col, 0).try_cast(target)
    return col.try_cast(target)
