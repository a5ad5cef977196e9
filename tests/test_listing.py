"""Folders listed and read by tasks, next to what Spark's own readers say of them."""

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from logsift.sources import files, listing

CONTENTS = {
    "a b.log": b"x\r\ny\n", "50%20 +.log": b"no end", "deep/er/e f": b"a,b\n1,2\n", "k=1/\xc3\xa9.txt".encode("latin-1").decode(): b"\n\n", "mark": b"\xef\xbb\xbf{}\n",
    "only mark": b"\xef\xbb\xbf", "no text": b"\xff\xfe\x00\n\xffx", "empty.log": b"", "long": b"z" * 9000 + b"\n" + b"y" * 4096 + b"\nend", "exact": (b"q" * 4095 + b"\n") * 3,
    "rows.csv": b"".join(b"row %d,\xc3\xa9\n" % i for i in range(4000)), "copy.csv": b"".join(b"row %d,\xc3\xa9\n" % i for i in range(4000)),
    "_hidden.log": b"x\n", ".hidden/a.log": b"x\n", "late._COPYING_": b"x\n", "_k=2/kept.log": b"kept\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, content in CONTENTS.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    return str(tmp_path / "in")


@pytest.fixture
def small_parts(spark, monkeypatch):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    monkeypatch.setattr(listing, "CHUNK", 1000)
    monkeypatch.setattr(listing, "NAMES", 2)
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def by_file(scan):
    found = {}
    rows = scan.withColumn("place", F.monotonically_increasing_id()).withColumn("value", F.col("value").cast("binary")).orderBy("path", "block", "place")
    for r in rows.collect():
        found.setdefault((r.path, r.length, r.modified), []).append((r.block, r.block_length, bytes(r.value)))
    return found


def test_lines_are_those_of_the_text_reader(spark, folder, small_parts):
    listed = listing.files_below(spark, folder)
    got, want = by_file(files._line_scan(spark, folder, listed)), by_file(files._line_scan(spark, folder, None))
    # Spark's reader gives no line for a file of nothing but a mark, and so no length.
    alone = [key for key in got if key[0].endswith("/only mark")]
    assert [got.pop(key) for key in alone] == [[(0, 3, b"")]] and len(want) == 11 and got == want
    assert {r.path for r in listed.collect()} == {r.path for r in files._names(spark, files._line_scan(spark, folder, None)).collect()}
    one, some = f"{folder}/a b.log", f"{folder}/*.csv"
    assert [r.path for r in listing.files_below(spark, one).collect()] == [f"file:{one}"] and listing.files_below(spark, some).count() == 2
    with pytest.raises(AnalysisException):
        listing.files_below(spark, f"{folder}/gone")


@pytest.mark.parametrize("codec", ["gzip", "bzip2", "deflate", "snappy", "lz4"])
def test_packed_files_are_unpacked(spark, tmp_path, codec):
    path = str(tmp_path / codec)
    spark.range(60_000).selectExpr("concat('line ', id * 7919 % 60000, ' of ', uuid())").coalesce(2).write.option("compression", codec).text(path)
    got, want = (by_file(files._line_scan(spark, path, listed)) for listed in (listing.files_below(spark, path), None))
    assert {k: [line for *_, line in v] for k, v in got.items()} == {k: [line for *_, line in v] for k, v in want.items()}
    assert sum(map(len, got.values())) == 60_000


def without_mark(rows):
    return [r for r in rows if not r[0].endswith("/only mark")]


def test_catalog_keeps_no_name_on_the_driver(spark, folder, monkeypatch):
    with monkeypatch.context() as patch:
        patch.setattr(listing, "reach", lambda *_: None)
        want = without_mark(map(tuple, files.catalog(spark, folder, "json").collect()))
        digests = set(without_mark(map(tuple, files.content_digests(spark, folder).collect())))
        listed = set(map(tuple, files.list_files(spark, folder).collect()))

    def refused(*_):
        raise AssertionError("the driver asked for all names")

    monkeypatch.setattr(type(spark.range(0)), "inputFiles", refused)
    with monkeypatch.context() as patch, pytest.raises(AssertionError, match="all names"):
        patch.setattr(listing, "reach", lambda *_: None)
        files.catalog(spark, folder, "json")
    got = files.catalog(spark, folder, "json").collect()
    mark = {r.path.rsplit("/", 1)[-1]: r.length for r in got}["only mark"]
    assert len(got) == 13 and mark == 3
    assert set(without_mark(map(tuple, got))) == set(want)
    assert set(without_mark(map(tuple, files.content_digests(spark, folder).collect()))) == digests
    assert set(map(tuple, files.list_files(spark, folder).collect())) == listed


def test_folders_of_other_file_systems(folder):
    batch = pa.RecordBatch.from_arrays([pa.array([f"file:{folder}", f"file:{folder}/deep/er", f"file:{folder}/exact"])], ["path"])
    found = [sorted(v for out in listing._lister(3, local)(iter([batch])) for v in out.column(0).to_pylist()) for local in (True, False)]
    assert found[0] == found[1] and len(found[0]) == 15
    assert listing.opener()("file:/a b/%20")[1] == "/a b/%20"


def test_suffixes(spark):
    names = {"/a/b.csv": ".csv", "/a.d/b": "", "/a/.csv": "", "/a/..csv": ".csv", "/a/b.": "", "/a/b..": "", "/a/b.C.Sv//": ".sv", "x.Log": ".log", "": "", "/": "", None: None}
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert dict(map(tuple, df.select("p", files.suffix_of(F.col("p"))).collect())) == names
