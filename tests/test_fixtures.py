from pathlib import Path

from pyspark.sql import functions as F

from logsift.sources import files
from workload import fixtures


def test_log_files_are_strung_together_from_small_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "PIECE_ROWS", 20)
    rows = spark.range(400).selectExpr("if(id % 4 = 0, 'b', 'a') as file", "(399 - id) div 50 as block", "399 - id as pos", "if(id = 7, null, concat('line ', id, ' é')) as line")
    joined = []
    joiner = fixtures._joiner

    def watched(folder):
        joined.append(folder)
        return joiner(folder)

    monkeypatch.setattr(fixtures, "_joiner", watched)
    fixtures.write_log_files(rows, str(tmp_path / "logs"))
    assert joined == [str(tmp_path / "logs")]
    for name in "ab":
        (only,) = Path(tmp_path / "logs" / f"file={name}").iterdir()
        want = [r.line or "" for r in rows.filter(F.col("file") == name).orderBy("block", "pos").collect()]
        assert only.read_text().split("\n") == [*want, ""]


def test_catalog_lists_its_folder_once(spark, tmp_path, monkeypatch):
    for i in range(3):
        (tmp_path / f"a{i}.log").write_text("x\n" * i)
    scan, made = files._line_scan, []
    monkeypatch.setattr(files, "_line_scan", lambda *args: made.append(args) or scan(*args))
    assert files.catalog(spark, str(tmp_path)).count() == 3 and len(made) == 1


def test_documents_of_many_splits_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))

    def refused(*_):
        raise AssertionError("texts are shuffled")

    monkeypatch.setattr(type(docs), "repartition", refused)
    folder = fixtures.document_files(spark, str(tmp_path))
    written = [f for f in Path(folder.removeprefix("file:")).rglob("*") if f.is_file() and not f.name.startswith(".")]
    assert len(written) == docs.count() and sum(f.stat().st_size == 0 for f in written) >= docs.filter("doc_id % 37 = 0").count()
