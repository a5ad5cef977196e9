"""Small text and display expressions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, functions as F

from logsift.constants import LARGE_FILE_BYTES, MESSAGE_CHARS

_IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
_KB = 1024
_MB = 1024 * 1024


def sanitize_identifier(name: str) -> str:
    """A table name from any text: other characters become ``_``, no leading digit, never empty."""
    safe = re.sub(r"[^a-zA-Z0-9_]", "_", name)
    return f"_{safe}" if not safe or safe[0].isdigit() else safe


def sanitized(col: Column) -> Column:
    """Column form of :func:`sanitize_identifier`."""
    safe = F.regexp_replace(col, "[^a-zA-Z0-9_]", "_")
    return F.when(safe.rlike(r"^([0-9]|$)"), F.concat(F.lit("_"), safe)).otherwise(safe)


def check_identifier(name: str) -> str:
    """The name itself, or ValueError if it is not a plain identifier."""
    if not _IDENTIFIER.match(name):
        raise ValueError(f"Invalid SQL identifier: {name!r}")
    return name


def raw_table_name(path: str, file_format: str, table: str | None = None) -> str:
    """Table name of a raw source; the suffix is a hash of the path, so re-runs agree."""
    if table:
        return sanitize_identifier(table)
    stem = path.rstrip("/").rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem.lstrip(".") else stem
    return f"raw_{file_format}_{sanitize_identifier(stem)}_{hashlib.sha256(path.encode()).hexdigest()[:8]}"


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def or_none(col: Column) -> Column:
    """Text of a value with NULL written as ``None``."""
    return F.coalesce(col.cast("string"), F.lit("None"))


def duration_text(first: Column, last: Column) -> Column:
    """Whole seconds between two times as ``1d 2h 5m 3s`` without zero parts; ``0s`` if none."""
    micros = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    seconds = F.floor(micros / 1_000_000).cast("bigint")
    days = F.floor(seconds / 86400).cast("bigint")
    hours = F.floor(seconds % 86400 / 3600).cast("bigint")
    minutes = F.floor(seconds % 3600 / 60).cast("bigint")
    rest = seconds % 60

    def part(value: Column, unit: str) -> Column:
        return F.when(value > 0, F.concat(value.cast("string"), F.lit(unit)))

    text = F.concat_ws(" ", part(days, "d"), part(hours, "h"), part(minutes, "m"), part(rest, "s"))
    return F.when(seconds <= 0, F.lit("0s")).when(seconds > 0, text)


def status_class(col: Column) -> Column:
    return (
        F.when(col.isNull(), "unknown")
        .when(col < 300, "success")
        .when(col < 400, "redirect")
        .when(col < 500, "client_error")
        .otherwise("server_error")
    )


def truncate_message(col: Column, limit: int = MESSAGE_CHARS) -> Column:
    """The first ``limit`` characters plus ``...`` if more follow."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit), F.lit("..."))).otherwise(col)


def truncate_within(col: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis if the text was cut."""
    return F.when(F.length(col) > limit, F.concat(F.substring(col, 1, limit - 1), F.lit("…"))).otherwise(col)


def size_text(col: Column) -> Column:
    """Bytes as ``B``, ``KB`` or ``MB`` with one decimal, ties to even."""

    def scaled(unit: int, name: str) -> Column:
        return F.concat(F.format_string("%.1f", F.bround(col / F.lit(float(unit)), 1)), F.lit(name))

    return (
        F.when(col >= _MB, scaled(_MB, " MB"))
        .when(col >= _KB, scaled(_KB, " KB"))
        .otherwise(F.concat(col.cast("string"), F.lit(" B")))
    )


def is_large(col: Column) -> Column:
    return col > LARGE_FILE_BYTES


def date_label(col: Column) -> Column:
    """First ten characters of a creation time, ``unknown`` if there is none."""
    return F.coalesce(F.nullif(F.substring(col.cast("string"), 1, 10), F.lit("")), F.lit("unknown"))


def severity_checked(col: Column, allowed: tuple[str, ...]) -> Column:
    """The severity itself; any other value fails the job."""
    return F.when(col.isin(*allowed), col).otherwise(
        F.raise_error(F.concat(F.lit("Severity must be Low, Medium or High; got "), or_none(col))).cast("string")
    )
