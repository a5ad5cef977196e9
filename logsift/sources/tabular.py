"""CSV and JSON readers, table previews and profiles."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logsift.constants import PREVIEW_ROWS
from logsift.session import materialize
from logsift.sources.lines import plain_path, read_lines

_DELIMITERS = (",", ";", "\t", "|")


def _first_lines(spark: SparkSession, path: str, skip: DataFrame | None = None, recursive: bool = False) -> dict[str, list[str]]:
    """The first non-blank lines of the files below ``path``, and which files begin with each; without the files in ``skip``.

    File names reach the driver, as they do whenever a folder is listed.
    """
    lines = read_lines(spark, path, recursive).filter(F.trim("line") != "")
    if skip is not None:
        lines = lines.join(skip.select(F.col("source").alias("file")), "file", "left_anti")
    firsts = lines.groupBy("file").agg(F.min_by("line", F.struct("block", "pos")).alias("line"))
    found: dict[str, list[str]] = {}
    for row in firsts.sort("file").collect():
        # Readers take names as patterns.
        found.setdefault(row["line"], []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", row["file"]))
    return found


def _stacked(parts: list[DataFrame]) -> DataFrame:
    """Rows of unlike tables by column name; a column whose types differ becomes text, absent ones are NULL."""
    types: dict[str, set[str]] = {}
    for df in parts:
        for f in df.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {name for name, kinds in types.items() if len(kinds) > 1 and not kinds <= {"int", "bigint", "double"}}

    def text(df: DataFrame, name: str) -> Column:
        nested = isinstance(df.schema[name].dataType, (T.StructType, T.ArrayType, T.MapType))
        return F.to_json(F.col(f"`{name}`")) if nested else F.col(f"`{name}`").cast("string")

    alike = [df.withColumns({c: text(df, c) for c in df.columns if c in mixed}) for df in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)


def sniff_delimiter(header: str) -> str:
    counts = Counter({d: header.count(d) for d in _DELIMITERS})
    best, n = counts.most_common(1)[0]
    return best if n else ","


def _naive_times(df: DataFrame) -> DataFrame:
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(f"`{c}`").cast("timestamp_ntz") for c in zoned})


def has_multi_line_fields(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether any line below ``path`` opens a quoted field it does not close."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


_UNFIT = "_unfit_record"
_END = "\x01end"


def _whole_rows(spark: SparkSession, files: str | list[str], schema: T.StructType, named: bool = False, **options) -> DataFrame:
    """The rows of CSV files with this schema, ``named`` with their file in ``source``; one with more fields than the schema fails the job."""
    # Without pruning the reader sees all fields of a row, and keeps the text of those that do not fit.
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField(_UNFIT, T.StringType())])).option("columnPruning", False).csv(
        files, **options, mode="PERMISSIVE", columnNameOfCorruptRecord=_UNFIT
    )
    if named:
        read = read.select("*", plain_path().alias("source"))
    # A row with too few fields has room for one more; its missing ones stay NULL.
    line = F.concat(F.regexp_replace(_UNFIT, "[\r\n]+$", ""), F.lit(options["sep"] + _END))
    names = [f"f{i}" for i in range(len(schema))]
    fields = F.from_csv(line, ", ".join(f"{n} string" for n in names), {"sep": options["sep"], "escape": '"', "multiLine": "true"})
    short = F.exists(F.array(*[fields[n] for n in names]), lambda f: F.coalesce(f == _END, F.lit(False)))
    # The reader refuses queries of the kept text alone, so the first field is named too.
    first = F.coalesce(F.col("`" + schema[0].name.replace("`", "``") + "`").cast("string"), F.lit(""))
    failure = F.raise_error(F.concat(F.lit("CSV row with more fields than its header, "), first, F.lit(": "), _UNFIT)).cast("boolean")
    return read.filter(F.when(F.col(_UNFIT).isNotNull() & ~short, failure).otherwise(True)).drop(_UNFIT)


def read_csv(
    spark: SparkSession, path: str, sep: str | None = ",", infer: bool = False, multi_line: bool | None = None
) -> DataFrame:
    """CSV with a header; all columns text unless types are inferred.

    ``sep=None`` picks comma, semicolon, tab or bar from the header. Inferred times
    are naive UTC. Files with line breaks inside fields cannot be split over tasks;
    ``multi_line=None`` looks whether there are any, at the cost of a scan of the
    text, ``False`` says there are none. Files of one folder may have unlike headers and
    delimiters: files with the same header line are read together, and columns meet by name. A row
    with more fields than its header fails the job.
    """
    headers = _first_lines(spark, path)
    groups = headers.items() if len(headers) > 1 else [(next(iter(headers), ""), path)]
    parts = [_read_alike(spark, files, header, sep, infer, multi_line) for header, files in groups]
    return parts[0] if len(parts) == 1 else _stacked(parts)


def csv_layouts(spark: SparkSession, path: str, skip: DataFrame | None = None) -> list[tuple[list[str], DataFrame]]:
    """The CSV files below ``path`` by layout: for each header line the files, and one table of all their rows with the file in ``source``.

    Files named in ``skip`` (column ``source``) are left out. The plan has one branch per layout, however many files there are.
    """
    out = []
    for header, files in _first_lines(spark, path, skip, recursive=True).items():
        rows = _read_alike(spark, files, header, None, False, None, named=True)
        out.append((files, rows))
    return out


def _read_alike(
    spark: SparkSession, files: str | list[str], header: str, sep: str | None, infer: bool, multi_line: bool | None, named: bool = False
) -> DataFrame:
    """Files with one header line."""
    many = has_multi_line_fields(spark, files) if multi_line is None else multi_line
    options = dict(header=True, sep=sep or sniff_delimiter(header), escape='"', multiLine=many)
    df = spark.read.csv(files, **options, inferSchema=infer)
    if df.columns:
        df = _whole_rows(spark, files, df.schema, named, **options)
    return _naive_times(df) if infer else df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, or files holding one array of objects, with an inferred nested schema.

    Lines are split over tasks; an array file is one task each, so large exports
    should be lines. Keys that differ only by case get a numeric suffix; such a source
    is stored under its new names, since they cannot be told apart in a later query. Each
    file's first character tells which kind it is, so a folder may hold both.
    """
    firsts = _first_lines(spark, path)
    arrays = [f for line, files in firsts.items() if line.lstrip().startswith("[") for f in files]
    lines = [f for line, files in firsts.items() if not line.lstrip().startswith("[") for f in files]
    reader = spark.read if schema is None else spark.read.schema(schema)
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        if arrays and lines:
            df = _stacked([reader.json(lines, multiLine=False), reader.json(arrays, multiLine=True)])
        else:
            df = reader.json(path, multiLine=bool(arrays))
        names = _distinct_names(df.columns)
        return df if names == df.columns else materialize(df.toDF(*names), "json")
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def _distinct_names(names: list[str]) -> list[str]:
    taken: Counter[str] = Counter()
    result = []
    for name in names:
        n = taken[name.lower()]
        taken[name.lower()] += 1
        result.append(f"{name}_{n}" if n else name)
    return result


def profile(df: DataFrame, table: str) -> DataFrame:
    """Row count and schema of a table: one row per column."""
    spark = df.sparkSession
    columns = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    described = spark.createDataFrame(columns, "ordinal int, column_name string, dtype string")
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return described.select(
        F.lit(table).alias("table_name"), counted.scalar().alias("row_count"), "ordinal", "column_name", "dtype"
    )


def preview_rows(df: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows with nested values as JSON text and bytes as text (hex if not UTF-8)."""
    shown = []
    for f in df.schema.fields:
        col = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            col = F.to_json(col)
        elif isinstance(f.dataType, T.BinaryType):
            col = F.when(F.is_valid_utf8(col.cast("string")), col.cast("string")).otherwise(F.hex(col))
        shown.append(col.alias(f.name))
    return df.limit(n).select(*shown)
