"""Text format detection and field extraction with native regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logsift import constants as C
from logsift.plans.shapes import join_keyed
from logsift.session import materialize
from logsift.sources.lines import first_split_head, head_lines, numbered_head, unfinished

FIELDS = ("event_timestamp", "source_ip", "status_code", "event_type")
TEXT_FORMATS = ("web", "syslog", "jsonline")


def _pattern_fields(patterns: dict[str, str], line: Column) -> dict[str, Column]:
    missing = F.lit(None).cast("string")
    return {f: F.regexp_extract(line, patterns[f], 1) if f in patterns else missing for f in FIELDS}


def web_fields(line: Column) -> dict[str, Column]:
    return _pattern_fields(C.WEB_FIELDS, line)


def syslog_fields(line: Column) -> dict[str, Column]:
    return _pattern_fields(C.SYSLOG_FIELDS, line)


def json_fields(line: Column) -> dict[str, Column]:
    quoted = F.regexp_extract(line, C.JSON_TIME_TEXT, 1)
    return {
        "event_timestamp": F.coalesce(F.nullif(quoted, F.lit("")), F.regexp_extract(line, C.JSON_TIME_EPOCH, 1)),
        "source_ip": F.regexp_extract(line, C.JSON_ADDRESS, 1),
        "status_code": F.regexp_extract(line, C.JSON_STATUS, 1),
        "event_type": F.regexp_extract(F.regexp_extract(line, C.JSON_EVENT, 1), C.JSON_EVENT_WORD, 1),
    }


EXTRACTORS = {"web": web_fields, "syslog": syslog_fields, "jsonline": json_fields}


def extract(lines: DataFrame, text_format: str) -> DataFrame:
    """The four text fields of lines known to have ``text_format``, plus the line itself.

    A pattern that misses gives an empty string; a NULL line gives NULL fields.
    """
    fields = EXTRACTORS[text_format](F.col("line"))
    kept = [c for c in lines.columns if c != "line"]
    return lines.select(*kept, *[fields[f].alias(f) for f in FIELDS], F.col("line").alias("raw_message"))


def _hit(fields: dict[str, Column]) -> Column:
    hit = F.lit(False)
    for name in ("event_timestamp", "source_ip", "event_type"):
        hit = hit | (F.coalesce(fields[name], F.lit("")) != "")
    return hit


def hit_counts(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with any non-empty timestamp, address or type, per key."""
    hit = _hit({f: F.col(f) for f in FIELDS})
    return extracted.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n_lines"))


def _head_flags(head: DataFrame, max_lines: int) -> DataFrame:
    """Per file, which patterns its head meets and how many of its lines were seen."""
    line = F.col("line")
    counted = F.col("line_no") <= max_lines if max_lines > 0 else F.lit(True)
    more = [F.bool_or("more").alias("more")] if "more" in head.columns else []
    return head.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_seen"),
        *more,
        F.bool_or(line.rlike(C.DETECT_WEB_ADDRESS)).alias("web_address"),
        F.bool_or(line.rlike(C.DETECT_WEB_REQUEST)).alias("web_request"),
        F.bool_or(line.rlike(C.DETECT_SYSLOG)).alias("syslog"),
        F.bool_or(line.rlike(C.DETECT_JSON)).alias("jsonline"),
        *[F.bool_or(counted & _hit(fn(line))).alias(f"hit_{name}") for name, fn in EXTRACTORS.items()],
    )


def detect_formats(lines: DataFrame, max_lines: int = 0) -> DataFrame:
    """``(file, format, head_hit)`` from the first 20 lines of every file.

    ``head_hit`` tells whether those lines (up to ``max_lines``) already hold a value
    for the detected format. One pass over the first splits settles almost every file;
    only files whose first split is shorter than that and that go on are read further.
    """
    flags = materialize(_head_flags(first_split_head(lines, C.DETECT_LINES), max_lines), "flags")
    short = flags.filter(unfinished(flags, C.DETECT_LINES)).select("file")
    if not short.isEmpty():
        again = numbered_head(join_keyed(lines, short, ["file"], "left_semi"), C.DETECT_LINES)
        flags = join_keyed(flags, short, ["file"], "left_anti").unionByName(_head_flags(again, max_lines))
    detected = (
        F.when(F.col("web_address") & F.col("web_request"), "web")
        .when(F.col("syslog"), "syslog")
        .when(F.col("jsonline"), "jsonline")
        .otherwise("ambiguous")
    )
    head_hit = F.lit(False)
    for name in TEXT_FORMATS:
        head_hit = F.when(F.col("format") == name, F.coalesce(f"hit_{name}", F.lit(False))).otherwise(head_hit)
    return flags.withColumn("format", detected).select("file", "format", head_hit.alias("head_hit"))


def _by_format(line: Column) -> dict[str, Column]:
    """Each field by the ``format`` column; NULL for raw lines."""
    by_format = {name: fn(line) for name, fn in EXTRACTORS.items()}
    result = {}
    for field in FIELDS:
        value = F.lit(None).cast("string")
        for name, fields in by_format.items():
            value = F.when(F.col("format") == name, fields[field]).otherwise(value)
        result[field] = value
    return result


def settled_formats(lines: DataFrame, max_lines: int = 0) -> DataFrame:
    """``(file, format)``: the detected format of every file, ``raw`` where it is unknown or no line yields a field.

    Whether a file yields anything is almost always settled by its head; only files where it is not are scanned.
    """
    formats = materialize(detect_formats(lines, max_lines), "formats")
    open_files = formats.filter((F.col("format") != "ambiguous") & ~F.col("head_hit")).drop("head_hit")
    if not open_files.isEmpty():
        fields = _by_format(F.col("line"))
        found = (
            join_keyed(head_lines(lines, max_lines), open_files, ["file"], "inner")
            .filter(_hit(fields))
            .groupBy("file")
            .agg(F.lit(True).alias("later_hit"))
        )
        formats = formats.join(found, "file", "left").withColumn(
            "head_hit", F.col("head_hit") | F.coalesce("later_hit", F.lit(False))
        )
    return formats.select("file", F.when(F.col("head_hit"), F.col("format")).otherwise("raw").alias("format"))


def by_format(lines: DataFrame, formats: DataFrame, stored: bool = False) -> DataFrame:
    """``file, format, structured, fields…, raw_message`` of lines whose files have these formats."""
    fields = _by_format(F.col("line"))
    return join_keyed(lines, formats, ["file"], "left", stored=stored).select(
        "file",
        "format",
        (F.col("format") != "raw").alias("structured"),
        *[fields[f].alias(f) for f in FIELDS],
        F.col("line").alias("raw_message"),
    )


def structured_lines(lines: DataFrame, max_lines: int = 0, structured: bool = True) -> DataFrame:
    """Mixed text files as one table: ``file, format, structured, fields…, raw_message``.

    A file of unknown format, or one in which no line yields a field, stays raw:
    ``structured`` is false and its fields are NULL.
    """
    capped = head_lines(lines, max_lines)
    if not structured:
        nothing = [F.lit(None).cast("string").alias(f) for f in FIELDS]
        return capped.select(
            "file", F.lit("raw").alias("format"), F.lit(False).alias("structured"), *nothing,
            F.col("line").alias("raw_message"),
        )
    return by_format(capped, settled_formats(lines, max_lines))


def field_profile(lines: DataFrame, profile: str) -> DataFrame:
    """How many lines each loose pattern of ``profile`` finds a value in: one row."""
    patterns = C.PROFILE_FIELDS[profile]
    names = ("timestamp", "source_ip", "status_code", "event_type")
    return lines.agg(
        F.count(F.lit(1)).alias("n_lines"),
        *[
            F.count_if(F.regexp_extract("line", patterns[n], 1) != "").alias(n) if n in patterns
            else F.lit(0).cast("bigint").alias(n)
            for n in names
        ],
    )
