"""File catalog: format, validity, duplicates and status of input files."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsift import constants as C
from logsift.functions.text import is_large, size_text
from logsift.plans.shapes import join_keyed
from logsift.session import materialize
from logsift.sources import listing
from logsift.sources.lines import file_heads, plain_path

# Lines are weighted by powers of a primitive root of this prime.
PRIME = (1 << 31) - 1
ROOT = 48271
_DIGIT_BITS, _DIGITS = 6, 6
_PARTS = 4
_IN_TASK = (1 << 33) - 1
# What the first non-blank line of a file says about its format.
_KINDS = (None, "json", "csv", "log")
_LENGTH_BITS = 13


def _names(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The files of a scan by the listing that Spark's readers keep on the driver; empty ones are in no scan."""
    return spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(name)),) for name in df.inputFiles()], "path string")


def _line_scan(spark: SparkSession, path: str, listed: DataFrame | None) -> DataFrame:
    """``(path, length, modified, block, block_length, value)``: the lines of the listed files.

    Without a list, in a store that only Spark's readers open, those of all files below ``path``; the driver lists them then.
    """
    if listed is not None:
        return listing.read_lines(listed)
    size, modified = F.col("_metadata.file_size"), F.col("_metadata.file_modification_time")
    return spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path).select(
        plain_path().alias("path"), size.alias("length"), modified.alias("modified"),
        F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_block_length").alias("block_length"), "value")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, modified)`` of every file below ``path``; no content is read, and empty files have no time."""
    listed = listing.files_below(spark, path)
    if listed is not None:
        return listed.withColumn("modified", F.when(F.col("length") > 0, F.col("modified")))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    filled = found.select(plain_path().alias("path"), "length", F.col("modificationTime").alias("modified"))
    return _names(spark, found).join(filled, "path", "left").withColumn("length", F.coalesce("length", F.lit(0)))


def suffix_of(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    # No pattern: it would be matched from every place in a path, for every line of a file.
    name = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    last = F.substring_index(name, ".", -1)
    return F.when((last != "") & (F.length(name) > F.length(last) + 1), F.lower(F.concat(F.lit("."), last))).when(path.isNotNull(), "")


def _by_suffix(path: Column) -> Column:
    known = F.create_map(*[F.lit(text) for pair in C.FORMAT_BY_SUFFIX.items() for text in pair])
    return F.try_element_at(known, suffix_of(path))


def _first_text(head: Column) -> Column:
    """The first line with anything in it."""
    return F.regexp_extract(head, r"^\s*([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1)


def _looks_json(first: Column) -> Column:
    return first.rlike(r"^[\{\[]")


def _looks_csv(first: Column) -> Column:
    return first.contains(",") & first.rlike(r"^[\p{L}\p{N}]")


def sniffed_format(head: Column) -> Column:
    """Format by the first 4 KiB of a file: JSON, CSV or log; NULL if blank or not text."""
    first = _first_text(head)
    return (
        F.when(head.isNull() | (first == "") | ~F.is_valid_utf8(head), F.lit(None).cast("string"))
        .when(_looks_json(first), "json").when(_looks_csv(first), "csv").otherwise("log")
    )


def detect_format(path: Column, head: Column) -> Column:
    """Format by suffix, else by the head; NULL if neither text nor known."""
    return F.coalesce(_by_suffix(path), sniffed_format(head))


def classify_files(files: DataFrame, override: str | None = None) -> DataFrame:
    """Add ``format, needs_conversion, status, validation_error, size_text, is_large``.

    ``files`` has ``path, length`` and ``head`` or, from a catalog scan, ``sniffed``; it is only looked at
    where the suffix does not decide. A given ``override`` replaces the format of valid files.
    """
    if override is not None and override.lower() not in C.SUPPORTED_FORMATS:
        raise ValueError(f"Unsupported type '{override}'. Supported: {', '.join(sorted(C.SUPPORTED_FORMATS))}")
    sniffed = F.col("sniffed") if "sniffed" in files.columns else sniffed_format(F.col("head"))
    detected = F.coalesce(_by_suffix(F.col("path")), sniffed)
    error = (
        F.when(F.col("length").isNull(), F.concat(F.lit(C.FILE_NOT_FOUND), F.col("path")))
        .when(F.col("length") == 0, F.concat(F.lit(C.FILE_EMPTY), F.col("path")))
        .when(F.col("detected").isNull(), F.concat(F.lit(C.FILE_BINARY), F.col("path")))
    )
    chosen = F.col("detected") if override is None else F.lit(override.lower())
    return (
        files.withColumn("detected", detected)
        .withColumn("validation_error", error)
        .withColumn("format", F.when(F.col("validation_error").isNull(), chosen))
        .withColumn("needs_conversion", F.col("format") == "evtx")
        .withColumn("status", F.when(F.col("validation_error").isNull(), "ready").otherwise("invalid"))
        .withColumn("size_text", size_text(F.col("length")))
        .withColumn("is_large", is_large(F.col("length")))
        .drop("detected", "head", "sniffed")
    )


def _power(exponent: Column, root: int) -> Column:
    """``root`` to the power of ``exponent`` modulo PRIME, by looking up the digits of the exponent."""
    out = F.lit(1).cast("long")
    for i in range(_DIGITS):
        table = F.expr("array(" + ", ".join(f"{pow(root, d << _DIGIT_BITS * i, PRIME)}L" for d in range(1 << _DIGIT_BITS)) + ")")
        digit = F.shiftrightunsigned(exponent, _DIGIT_BITS * i).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1))
        out = out * F.get(table, digit.cast("int")) % PRIME
    return out


def split_digests(scan: DataFrame) -> DataFrame:
    """Of a scan of lines, one row per file and split: line count, digest, and what its first lines say about the format.

    The digest is a sum over the lines, each weighted by a power that grows with its number in the task, so it needs neither
    a window nor a sort, and its parts add up on the map side; all aggregates are longs. What the first non-blank and
    the first invalid line look like is the minimum of a number that starts with the line's place.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))
    # Only heads of files whose name does not tell are looked at.
    asked = (F.col("block") == 0) & _by_suffix(F.col("path")).isNull()
    lines = scan.select(
        "path", "length", "modified", "block", "block_length", place.alias("place"), F.col("value").alias("line"),
        F.when(asked, F.substring("value", 1, C.SNIFF_BYTES)).alias("head"),
    ).withColumn("text", _first_text(F.col("head"))).withColumn("empty", F.col("head").rlike(r"^\s*$"))
    head, first, blank = F.col("head"), F.col("text"), F.col("empty")
    kind = F.when(first == "", 0).when(_looks_json(first), 1).when(_looks_csv(first), 2).otherwise(3)
    most = (1 << _LENGTH_BITS) - 1
    told = F.shiftleft(F.shiftleft(F.col("place"), 2) + kind, _LENGTH_BITS) + F.least(F.octet_length("line"), F.lit(most))
    digest = F.sha2("line", 256)
    weight = _power(F.col("place"), ROOT)
    parts = [F.conv(F.substring("digest", 1 + 7 * i, 7), 16, 10).cast("long") for i in range(_PARTS)]
    rows = lines.select(
        "path", "length", "modified", "block", "block_length", "place", digest.alias("digest"), weight.alias("weight"),
        F.when(~blank, told).alias("told"),
        F.when(blank, F.octet_length("line") + 1).alias("blank"),
        F.when(~F.is_valid_utf8(head), F.col("place")).alias("broken"),
    )
    return rows.groupBy("path", "length", "modified", "block", "block_length").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"),
        *[F.sum(p * F.col("weight") % PRIME).alias(f"h{i}") for i, p in enumerate(parts)],
        F.min("told").alias("told"), F.sum("blank").alias("blank"), F.min("broken").alias("broken"),
    )


def file_digests(spark: SparkSession, path: str, scan: DataFrame | None = None) -> DataFrame:
    """``(path, length, modified, content_key, sniffed, unsettled)`` of every file that is not empty, from one scan.

    Digests of splits combine in the order of the splits like the concatenation of their lines, so the key does not depend on where
    a file is split; files with equal content have equal keys in any run and folder. ``unsettled`` marks
    files whose format hangs on where exactly the first 4 KiB end.
    """
    splits = split_digests(_line_scan(spark, path, listing.files_below(spark, path)) if scan is None else scan)
    back = pow(ROOT, PRIME - 2, PRIME)
    local = [(F.col(f"h{i}") % PRIME * _power(F.col("first"), back) % PRIME).alias(f"h{i}") for i in range(_PARTS)]
    # Splits of a file: its length by the split size.
    per_file = splits.select("path", "length", "modified", F.struct(
        "block", "n", *local, "block_length", "first", "told", "blank", "broken").alias("split")).groupBy("path", "length", "modified").agg(
        F.array_sort(F.collect_list("split")).alias("splits"))
    start = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0).cast("long").alias(f"h{i}") for i in range(_PARTS)])

    def combine(have: Column, split: Column) -> Column:
        weight = _power(have["n"], ROOT)
        return F.struct((have["n"] + split["n"]).alias("n"), *[((have[f"h{i}"] + split[f"h{i}"] * weight) % PRIME).alias(f"h{i}") for i in range(_PARTS)])

    whole = F.aggregate("splits", start, combine)
    top = F.col("splits")[0]
    told = top["told"]
    kind = F.shiftrightunsigned(told, _LENGTH_BITS).bitwiseAND(F.lit(3))
    first_length = told.bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1))
    blank = F.coalesce(top["blank"], F.lit(0))
    sniffed = F.lit(None).cast("string")
    for i, name in enumerate(_KINDS):
        if name:
            sniffed = F.when(kind == i, name).otherwise(sniffed)
    # A first line that is no text settles it; one further down may lie behind the head.
    broken_first = F.coalesce(top["broken"] == top["first"], F.lit(False))
    edge = (
        F.when(broken_first, F.lit(False)).when(top["broken"].isNotNull(), F.lit(True))
        .when(told.isNull(), (blank < C.SNIFF_BYTES) & (top["block_length"] < F.col("length")))
        .otherwise((blank > 0) & (blank + first_length > C.SNIFF_BYTES))
    )
    return per_file.withColumn("whole", whole).select(
        "path", "length", "modified",
        F.concat_ws(":", "length", "whole.n", *[F.hex(F.col(f"whole.h{i}")) for i in range(_PARTS)]).alias("content_key"),
        F.when(~broken_first, sniffed).alias("sniffed"),
        (_by_suffix(F.col("path")).isNull() & edge).alias("unsettled"),
    )


def _all_names(spark: SparkSession, scan: DataFrame, listed: DataFrame | None) -> DataFrame:
    """Every file, empty ones included, by the list or else by the scan."""
    return _names(spark, scan) if listed is None else listed.select("path")


def content_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content_key)`` of every file, empty ones included."""
    listed = listing.files_below(spark, path)
    scan = _line_scan(spark, path, listed)
    return _all_names(spark, scan, listed).join(file_digests(spark, path, scan).select("path", "content_key"), "path", "left").withColumn(
        "content_key", F.coalesce("content_key", F.lit("0")))


def _lines_of(spark: SparkSession, path: str, listed: DataFrame | None, wanted: DataFrame) -> DataFrame:
    """The lines of the wanted files, as ``file_heads`` takes them; without a list, all files are read for them."""
    scan = _line_scan(spark, path, listed if listed is None else materialize(listed.join(wanted, "path", "left_semi"), "wanted"))
    lines = scan.select(
        F.col("path").alias("file"), "block", F.nullif(F.col("value"), F.lit("")).alias("line"),
        (F.col("block") + F.col("block_length") < F.col("length")).alias("more"), F.monotonically_increasing_id().alias("pos"))
    return lines if listed is not None else join_keyed(lines, wanted.withColumnRenamed("path", "file"), ["file"], "left_semi")


def catalog(spark: SparkSession, path: str, override: str | None = None) -> DataFrame:
    """Every file below ``path`` with format, size, status, error and whether an earlier one has the same content.

    The files are listed and read by tasks, once; only those whose format hangs on the exact end of their head are looked at again.
    """
    listed = listing.files_below(spark, path)
    scan = _line_scan(spark, path, listed)
    found = materialize(file_digests(spark, path, scan), "digests")
    unsettled = found.filter("unsettled").select("path")
    if not unsettled.isEmpty():
        heads = file_heads(_lines_of(spark, path, listed, unsettled))
        again = heads.select(F.col("file").alias("path"), sniffed_format(F.col("head")).alias("looked"))
        found = found.join(again, "path", "left").withColumn("sniffed", F.when(F.col("unsettled"), F.col("looked")).otherwise(F.col("sniffed"))).drop("looked")
    named = _all_names(spark, scan, listed).join(found.drop("unsettled"), "path", "left").withColumn("length", F.coalesce("length", F.lit(0))).withColumn(
        "content_key", F.coalesce("content_key", F.lit("0")))
    return mark_duplicates(materialize(classify_files(named, override), "catalog"))


def mark_duplicates(files: DataFrame) -> DataFrame:
    """Files with equal ``content_key``: the first path keeps its status, the rest are duplicates.

    The winners come from a minimum per key and are joined back on the unique path,
    so a content copied very often never meets in one task.
    """
    winners = files.groupBy("content_key").agg(F.min("path").alias("path")).select("path", F.lit(True).alias("_first"))
    return (
        files.join(winners, "path", "left")
        .withColumn("status", F.when(F.col("_first"), F.col("status")).otherwise("duplicate"))
        .select(*files.columns)
    )


def status_counts(files: DataFrame) -> DataFrame:
    """Number of files per ingest status, zero included."""
    spark = files.sparkSession
    known = spark.createDataFrame([(s,) for s in C.INGEST_STATUSES], "status string")
    counted = files.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n_files"))
