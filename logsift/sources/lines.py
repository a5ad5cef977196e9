"""Text lines and the head of each text file.

A *lines* DataFrame has the columns ``file, block, pos, line``: the file, the start
of the input split the line came from, and a number that grows with the line order
inside the split. (block, pos) is therefore the line order of a file although no
task ever sees a whole file. ``more`` tells whether the file goes on behind the split; a
table of lines without that column is taken to go on.

Heads are read in two steps, without a copy of the lines: the first splits of all files, ranked each on its own, and only
then further splits of those few files whose first split holds fewer lines than the head.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from logsift.constants import PREVIEW_BYTES, PREVIEW_LINES, SNIFF_BYTES
from logsift.plans.shapes import join_keyed
from logsift.session import materialize

_SPLIT = ["file", "block"]


def plain_path() -> Column:
    """The file a row was read from; the metadata column encodes blanks, ``%`` and non-ASCII letters."""
    path = F.col("_metadata.file_path")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.contains("%"), decoded).otherwise(path)


def line_columns() -> list[Column]:
    """The columns of a text scan but for ``pos``; a blank line is NULL."""
    block, length = F.col("_metadata.file_block_start"), F.col("_metadata.file_block_length")
    return [
        plain_path().alias("file"),
        block.alias("block"),
        F.nullif(F.col("value"), F.lit("")).alias("line"),
        (block + length < F.col("_metadata.file_size")).alias("more"),
    ]


def read_lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, line_end: str | None = None) -> DataFrame:
    """Every physical line, verbatim; a blank line is NULL."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if line_end:
        reader = reader.option("lineSep", line_end)
    return reader.text(paths).select(*line_columns(), F.monotonically_increasing_id().alias("pos"))


def _goes_on(lines: DataFrame) -> Column:
    return F.col("more") if "more" in lines.columns else F.lit(True)


def _ranked(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of every split with their number in it; Spark's window group limit cuts before the shuffle."""
    in_split = Window.partitionBy(*_SPLIT).orderBy("pos")
    return lines.withColumn("rn", F.row_number().over(in_split)).filter(F.col("rn") <= n)


def first_split_head(lines: DataFrame, n: int) -> DataFrame:
    """What the first split of every file holds of its first ``n`` lines, numbered in ``line_no``."""
    return _ranked(lines.filter(F.col("block") == 0), n).withColumnRenamed("rn", "line_no")


def unfinished(heads: DataFrame, n: int, seen: str = "n_seen") -> Column:
    """Of ``(seen, more)`` per file: whether its head of ``n`` lines reaches behind the first split."""
    return (F.col(seen) < n) & _goes_on(heads)


def later_head(lines: DataFrame, n: int) -> DataFrame | None:
    """The lines of the heads that lie behind the first splits, numbered; None if there are none.

    Lines are counted per split, only of files with several splits and without reading a column; a running total says
    which splits a head reaches, and only the lines of those are ranked, each split on its own.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.filter((F.col("block") > 0) | _goes_on(lines)).groupBy(*_SPLIT).agg(F.count(F.lit(1)).alias("n_lines"))
    reached = materialize(
        counts.withColumn("before", F.coalesce(F.sum("n_lines").over(earlier), F.lit(0)))
        .filter((F.col("block") > 0) & (F.col("before") < n))
        .select(*_SPLIT, "before"),
        "reached",
    )
    last = reached.agg(F.max("block")).head()[0]
    if last is None:
        return None
    behind = lines.filter((F.col("block") > 0) & (F.col("block") <= F.lit(last)))
    return (
        _ranked(join_keyed(behind, reached, _SPLIT, "inner", stored=True), n)
        .withColumn("line_no", (F.col("before") + F.col("rn")).cast("int"))
        .filter(F.col("line_no") <= n)
        .select(*lines.columns, "line_no")
    )


def numbered_head(lines: DataFrame, n: int) -> DataFrame:
    """First ``n`` lines of every file with their number in ``line_no``; no file is ranked as a whole, and none is written."""
    first, rest = first_split_head(lines, n), later_head(lines, n)
    return first if rest is None else first.unionByName(rest)


def head_lines(lines: DataFrame, n: int) -> DataFrame:
    """First ``n`` lines of every file (all of them for ``n <= 0``)."""
    return lines if n <= 0 else numbered_head(lines, n).drop("line_no")


def _bytes_before(size: Column) -> Column:
    earlier = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size + 1).over(earlier), F.lit(0))


def preview(lines: DataFrame, max_lines: int = PREVIEW_LINES, max_bytes: int = PREVIEW_BYTES) -> DataFrame:
    """Head of each file for display: at most ``max_lines`` lines and ``max_bytes`` bytes.

    Line breaks count as a byte; the line that crosses the limit is cut there.
    """
    kept = F.substring("raw", F.lit(1), (F.lit(max_bytes) - F.col("before")).cast("int"))
    return (
        numbered_head(lines, max_lines)
        .withColumn("raw", F.encode(F.coalesce("line", F.lit("")), "UTF-8"))
        .withColumn("before", _bytes_before(F.length("raw")))
        .filter(F.col("before") < max_bytes)
        .select("file", F.col("line_no").cast("int").alias("line_no"), F.make_valid_utf8(kept.cast("string")).alias("line"))
    )


def file_heads(lines: DataFrame, max_bytes: int = SNIFF_BYTES) -> DataFrame:
    """``(file, head)``: the first bytes of each file.

    Every line takes at least a byte, so ``max_bytes`` lines always suffice; the
    lines of a head are joined in order, at most ``max_bytes`` of them per file.
    """
    text = F.coalesce("line", F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct("line_no", text.alias("text"))))
    joined = F.concat_ws("\n", F.transform("rows", lambda r: r["text"]))
    return (
        numbered_head(lines, max_bytes)
        .withColumn("before", _bytes_before(F.octet_length(text)))
        .filter(F.col("before") < max_bytes)
        .groupBy("file")
        .agg(rows.alias("rows"))
        .select("file", F.substring(joined, 1, max_bytes).alias("head"))
    )
