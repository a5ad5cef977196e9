"""Files that queries read back: log files of mixed formats, and every document as a file of its own."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsift.session import discard, scratch_path
from workload import relations as R

# Lines that one task sorts.
PIECE_ROWS = 500_000
# Documents that one task writes as files.
FILE_ROWS = 100_000
_WRITTEN: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf: str, label: str, write: Callable[[str], None]) -> str:
    """The folder that ``write`` filled, once per application and input."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _WRITTEN:
        folder = scratch_path(spark, label)
        write(folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


def _joiner(folder: str):
    target = re.sub("^file:/+", "/", folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import shutil

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            for name, pieces in zip(batch["name"], batch["pieces"]):
                system.create_dir(f"{root}/{name}", recursive=True)
                with system.open_output_stream(f"{root}/{name}/part-00000.txt") as stream:
                    for piece in pieces:
                        at, path = fs.FileSystem.from_uri(re.sub("^file:/+", "/", piece))
                        with at.open_input_stream(path) as source:
                            shutil.copyfileobj(source, stream, 1 << 20)
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def write_log_files(rows: DataFrame, folder: str) -> None:
    """Lines as text files, one folder and file per name, in the order of (block, pos).

    A file is sorted in pieces of some ``PIECE_ROWS`` lines and its pieces are strung together as bytes, so no task sorts a whole file
    and the tables' size does not tell what a task holds.
    """
    spark, order = rows.sparkSession, ("file", "block", "pos")
    path = scratch_path(spark, "pieces")
    n = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PIECE_ROWS))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("file", "line").write.partitionBy("file").text(path)
    written = spark.read.text(path)
    written._scratch_path = path
    # Names of pieces; there are as many as sorting tasks and files.
    of_name: dict[str, list[tuple[int, str]]] = {}
    for piece in map(unquote, written.inputFiles()):
        name, part = re.search(r"/([^/]*)/part-(\d+)[^/]*$", piece).groups()
        of_name.setdefault(name, []).append((int(part), piece))
    listed = spark.createDataFrame([(name, [piece for _, piece in sorted(pieces)]) for name, pieces in of_name.items()], "name string, pieces array<string>")
    listed.repartition(max(len(of_name), 1)).mapInPandas(_joiner(folder), "n long").agg(F.sum("n")).collect()
    discard(written)


def log_files(spark: SparkSession, sf: str) -> str:
    """The mixed lines as text files, one folder and file per name."""
    return _once(spark, sf, "logs", lambda folder: write_log_files(R.mixed_lines(spark, sf), folder))


def log_name(path: Column) -> Column:
    return F.regexp_extract(path, "/file=([^/]*)/[^/]*$", 1)


def _file_writer(folder: str):
    target = re.sub("^file:/+", "/", folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(target)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                parent = f"{root}/{name}".rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(f"{root}/{name}") as stream:
                    stream.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return run


def document_files(spark: SparkSession, sf: str) -> str:
    """Every document as a file: names with blanks, ``%`` and other letters, empty and binary ones, and exact copies."""

    def write(folder: str) -> None:
        # Texts are shuffled only where few splits hold them.
        docs = R.wide_table(spark, sf, "documents", FILE_ROWS).selectExpr(f"{R.DOCUMENT_PATH} as path", (
            "case when doc_id % 37 = 0 then x'' when doc_id % 41 = 0 then concat(x'FFFE00', cast(coalesce(text, '') as binary)) "
            "else cast(coalesce(text, '') as binary) end as content"))
        docs.mapInPandas(_file_writer(folder), "n long").agg(F.sum("n")).collect()

    return _once(spark, sf, "documents", write)


def relative(folder: str, files: DataFrame) -> DataFrame:
    """Paths, alone and in messages, without the folder."""
    inside = rf"[^ ]*/{folder.rsplit('/', 1)[-1]}/"
    texts = [c for c in ("path", "validation_error") if c in files.columns]
    return files.withColumns({c: F.regexp_replace(c, inside, "") for c in texts})


def source_files(spark: SparkSession, sf: str, tables: dict[str, DataFrame], address: dict[str, str]) -> str:
    """Raw tables as CSV files, one per table and last part of the address: some hundred sources of a few layouts."""

    def write(folder: str) -> None:
        for name, df in tables.items():
            named = df.withColumn("file", F.concat(F.lit(f"{name}-"), F.substring_index(address[name], ".", -1)))
            named.repartition("file").write.partitionBy("file").csv(f"{folder}/{name}", header=True, escape='"')

    return _once(spark, sf, "sources", write)
