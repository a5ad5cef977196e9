"""Folders of very many files: listed and read by tasks, so that the driver holds no name.

Spark's own readers keep every file of a folder on the driver, first as a listing and then as a plan. Here tasks list one level
of folders after the other into text files, an entry a line, and the files of that list are dealt to tasks that read them.
Python reaches local files and whatever pyarrow opens; ``reach`` tells the rest apart, which is left to Spark's readers.
What runs in tasks names nothing of this package, so workers need not have it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from logsift.session import scratch_path

# Files, or parts of files, that one task reads, and folders that one task lists.
TASK_FILES = 5_000
TASK_FOLDERS = 500
# Bytes read at once, and names listed at once.
CHUNK = 1 << 20
NAMES = 10_000
_ENTRY = "path string, length long, modified long, folder boolean"
# Files that are read from their start, as Spark reads them.
_CODECS = r"\.(gz|bz2|deflate|zst|snappy|lz4)$"
_MARK = b"\xef\xbb\xbf"

Batches = Iterator[pa.RecordBatch]


def reach(spark: SparkSession, path: str) -> str | None:
    """The full name of a path that Python can open, None if only Spark's readers can."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toUri()
    name = f"{uri.getScheme()}:{'//' + uri.getAuthority() if uri.getAuthority() else ''}{uri.getPath()}"
    try:
        opener()(name)
    except (OSError, ValueError, ImportError, pa.ArrowException):
        return None
    return name


def opener() -> Callable[[str], tuple]:
    """A function that gives the file system of a full name and the name inside it; systems are opened once."""
    systems: dict[str, tuple] = {}

    def find(name: str) -> tuple:
        import re

        from pyarrow import fs

        base, rest = re.match(r"([^:/]+:(?://[^/]*)?)/*(.*)$", name, re.DOTALL).groups()
        if base not in systems:
            systems[base] = (fs.LocalFileSystem(), "/") if base.rstrip("/") == "file:" else fs.FileSystem.from_uri(f"{base}/")
        system, root = systems[base]
        return system, f"{root.rstrip('/')}/{rest}"

    return find


def _lister(names: int, local: bool = True) -> Callable[[Batches], Batches]:
    """What folders hold, but for hidden names, as JSON; a file stands for itself. ``local`` folders are gone through name by name."""
    find = opener()

    def run(batches: Batches) -> Batches:
        import json
        import os
        import stat

        import pyarrow as pa
        from pyarrow import fs

        def shown(name: str) -> bool:
            return not (name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_"))

        def entries(path: str) -> Iterator[tuple]:
            system, inside = find(path)
            if local and isinstance(system, fs.LocalFileSystem):
                if not os.path.isdir(inside):
                    info = os.stat(inside)
                    yield path, info.st_size, info.st_mtime_ns // 1_000_000, False
                    return
                with os.scandir(inside) as found:
                    for entry in found:
                        if shown(entry.name):
                            try:
                                info = entry.stat()
                            except FileNotFoundError:
                                continue  # a link to nowhere
                            yield f"{path.rstrip('/')}/{entry.name}", info.st_size, info.st_mtime_ns // 1_000_000, stat.S_ISDIR(info.st_mode)
                return
            top = system.get_file_info(inside)
            for info in [top] if top.is_file else system.get_file_info(fs.FileSelector(inside)):
                if info is top or shown(info.base_name):
                    name = path if info is top else f"{path.rstrip('/')}/{info.base_name}"
                    yield name, info.size or 0, (info.mtime_ns or 0) // 1_000_000, info.type == fs.FileType.Directory

        for batch in batches:
            out: list[str] = []
            for path in batch.column(0).to_pylist():
                for name, length, modified, folder in entries(path):
                    out.append(json.dumps({"path": name, "length": 0 if folder else length, "modified": modified, "folder": folder}, ensure_ascii=False))
                    if len(out) == names:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                        out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return run


def _entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(F.from_json("value", _ENTRY).alias("e")).select("e.*")


def files_below(spark: SparkSession, path: str) -> DataFrame | None:
    """``(path, length, modified)`` of every file below ``path``, a folder, a file or a pattern; None if Python cannot open it.

    There is one job per level of folders, and a folder is listed by one task, name by name.
    """
    if reach(spark, path) is None:
        return None
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path)
    if not found:
        raise AnalysisException(f"[PATH_NOT_FOUND] Path does not exist: {path}")
    folders = spark.createDataFrame([(reach(spark, f.getPath().toString()),) for f in found], "path string")
    n, listing, levels = len(found), scratch_path(spark, "listing"), []
    while n:
        levels.append(f"{listing}/{len(levels)}")
        tasks = min(n, max(4 * spark.sparkContext.defaultParallelism, -(-n // TASK_FOLDERS)))
        folders.repartition(tasks).mapInArrow(_lister(NAMES), "value string").write.text(levels[-1])
        folders = _entries(spark, levels[-1:]).filter("folder").select("path")
        n = folders.count()
    return _entries(spark, levels).filter("not folder").select("path", "length", F.timestamp_millis("modified").alias("modified"))


def _dealt(parts: DataFrame, task_bytes: int) -> DataFrame:
    """Parts of files dealt evenly to tasks, by their number and bytes."""
    n, size = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("block_length"), F.lit(0))).first()
    return parts.repartition(max(parts.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-size // task_bytes)))


def _decoder() -> Callable:
    """A function that gives the content of a packed file as Spark's text reader sees it: by the suffix, of any codec Hadoop brings."""

    def decoded(name: str, stream):
        suffix = name.rsplit(".", 1)[-1]
        if suffix == "gz":
            import gzip

            return gzip.GzipFile(fileobj=stream)
        if suffix == "bz2":
            import bz2

            return bz2.BZ2File(stream)
        import io

        import pyarrow as pa

        if suffix == "zst":
            return pa.CompressedInputStream(pa.PythonFile(stream, mode="r"), "zstd")

        def deflated():
            import zlib

            inflate = zlib.decompressobj()
            while block := stream.read(1 << 16):
                yield inflate.decompress(block)
            yield inflate.flush()

        def blocks():
            """Hadoop's blocks: their length, then pieces with a length each."""
            codec = pa.Codec("lz4_raw" if suffix == "lz4" else "snappy")
            buffered = io.BufferedReader(stream) if isinstance(stream, io.RawIOBase) else stream
            while head := buffered.read(4):
                left = int.from_bytes(head, "big")
                while left:
                    piece = bytes(buffered.read(int.from_bytes(buffered.read(4), "big")))
                    if suffix == "lz4":
                        out = codec.decompress(piece, decompressed_size=left, asbytes=True) if len(piece) else b""
                    else:
                        size, shift = 0, 0
                        for byte in piece:  # snappy names the length first
                            size, shift = size | (byte & 127) << shift, shift + 7
                            if byte < 128:
                                break
                        out = codec.decompress(piece, decompressed_size=size, asbytes=True)
                    left -= len(out)
                    yield out

        class Parts(io.RawIOBase):
            def __init__(self, parts) -> None:
                self.parts, self.rest = parts, b""

            def readable(self) -> bool:
                return True

            def readinto(self, target) -> int:
                while not self.rest:
                    part = next(self.parts, None)
                    if part is None:
                        return 0
                    self.rest = part
                n = min(len(target), len(self.rest))
                target[:n], self.rest = self.rest[:n], self.rest[n:]
                return n

        return io.BufferedReader(Parts(deflated() if suffix == "deflate" else blocks()))

    return decoded


def _line_reader(chunk: int) -> Callable[[Batches], Batches]:
    """Lists of the lines of parts of files. A line belongs to the part in which the byte before it lies, as for Spark's text reader."""
    find, unpack, codecs, mark = opener(), _decoder(), _CODECS, _MARK

    def run(batches: Batches) -> Batches:
        import re

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs

        def boundary(stream, at: int, length: int) -> int:
            """The first line behind a place in the file."""
            if at in (0, length):
                return at
            stream.seek(at)
            while block := stream.read(1 << 16):
                found = block.find(b"\n")
                if found >= 0:
                    return at + found + 1
                at += len(block)
            return at

        def whole_lines(stream, left: int | None) -> Iterator[bytes]:
            held: list[bytes] = []
            while block := stream.read(chunk if left is None else min(chunk, left)):
                left = None if left is None else left - len(block)
                at = block.rfind(b"\n") + 1
                if at:
                    yield b"".join([*held, block[:at]])
                    held, block = [], block[at:]
                if block:
                    held.append(block)
            if held:
                yield b"".join(held)

        def texts(path: str, length: int, block: int, block_length: int) -> Iterator[bytes]:
            system, inside = find(path)
            with open(inside, "rb", buffering=0) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inside) as stream:
                if re.search(codecs, path):
                    yield from whole_lines(unpack(path, stream), None)
                    return
                start, stop = boundary(stream, block, length), boundary(stream, block + block_length, length)
                stream.seek(start)
                yield from whole_lines(stream, stop - start)

        schema = None

        def lists(rows: list[tuple], found: list[bytes]) -> pa.RecordBatch:
            columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
            split = pc.split_pattern(pa.array(found, pa.binary()), pattern="\n")
            return pa.RecordBatch.from_arrays([*columns, split], [*schema.names, "lines"])

        for batch in batches:
            schema = batch.schema
            rows, found, size = [], [], 0
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                path, length, _, block, block_length = row
                first = block == 0
                for text in texts(path, length, block, block_length):
                    if first and text.startswith(mark):
                        text = text[len(mark):]
                    first = False
                    rows.append(row)
                    found.append(text[:-1] if text.endswith(b"\n") else text)
                    size += len(text)
                    if size >= chunk:
                        yield lists(rows, found)
                        rows, found, size = [], [], 0
            if rows:
                yield lists(rows, found)

    return run


def read_lines(files: DataFrame) -> DataFrame:
    """``(path, length, modified, block, block_length, value)``: every line of listed files, in order within a part of a file.

    Parts are as long as Spark's splits; packed files are read from their start.
    """
    most = files.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    packed = F.col("path").rlike(_CODECS)
    starts = F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(most).cast("long")))
    parts = files.filter("length > 0").select("path", "length", F.unix_millis("modified").alias("modified"), F.explode(starts).alias("block")).withColumn(
        "block_length", F.when(packed, F.col("length")).otherwise(F.least(F.lit(most), F.col("length") - F.col("block"))))
    read = _dealt(parts, most).mapInArrow(
        _line_reader(CHUNK), "path string, length long, modified long, block long, block_length long, lines array<binary>")
    return read.select(
        "path", "length", F.timestamp_millis("modified").alias("modified"), "block", "block_length", F.explode("lines").alias("line")
    ).withColumn("value", F.col("line").cast("string")).drop("line")


def _text_reader(chunk: int) -> Callable[[Batches], Batches]:
    find = opener()

    def run(batches: Batches) -> Batches:
        import pyarrow as pa

        for batch in batches:
            rows, size = [], 0
            for path in batch.column(0).to_pylist():
                system, inside = find(path)
                with system.open_input_file(inside) as stream:
                    rows.append((path, stream.read()))
                size += len(rows[-1][1])
                if size >= chunk:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], ["path", "content"])
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.binary()))], ["path", "content"])

    return run


def read_texts(files: DataFrame, task_bytes: int = 128 << 20) -> DataFrame:
    """``(path, value)``: every listed file that is not empty, as one text."""
    parts = files.filter("length > 0").select("path", F.col("length").alias("block_length"))
    return _dealt(parts, task_bytes).mapInArrow(_text_reader(CHUNK), "path string, content binary").select("path", F.col("content").cast("string").alias("value"))
