"""Registered queries and pipeline stages against plain Python."""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logsift.llm import packing, queries
from logsift.llm.shipping import ship

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def folder_with(spark, path, documents=None, labels=None) -> str:
    for name, df in (("documents", documents), ("labels", labels)):
        (df if df is not None else spark.read.parquet(f"{SF}/{name}.parquet")).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_language_contract(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    odd = spark.createDataFrame([(9_000_001, None, "en", "s", 0), (9_000_002, "123 -- 4!", "en", "s", 0), (9_000_003, "", None, "s", 0)], SCHEMA)
    first = docs.unionByName(odd)
    # Neither the labels of held-out rows nor any source may change a prediction.
    second = first.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    found = [
        {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in queries.op3_language_id(spark, folder_with(spark, tmp_path / name, df)).collect()}
        for name, df in (("one", first), ("two", second))]
    assert found[0] == found[1]
    assert all(v[0] == (remainder(i, 3) == 1) and 0 <= v[2] <= 1 for i, v in found[0].items())
    learned = {r.lang for r in docs.where(~held & F.col("lang").isNotNull()).select("lang").distinct().collect()}
    assert {v[1] for v in found[0].values()} <= learned | {"und"}
    texts = {r.doc_id: (r.text, r.lang) for r in first.collect()}
    assert all((v[1] == "und") == (not any(c.isalpha() for c in texts[i][0] or "")) for i, v in found[0].items())
    judged = [texts[i][1] == v[1] for i, v in found[0].items() if v[0] and texts[i][1] and v[1] != "und"]
    assert sum(judged) / len(judged) > 0.97


def test_toxicity_contract(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    changed = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("other"))
    found = [
        {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op10_toxicity(spark, folder_with(spark, tmp_path / name, d, la)).collect()}
        for name, d, la in (("one", docs, labels), ("two", changed, flipped))]
    assert found[0] == found[1] and len(found[0]) == docs.count()
    assert all(v[0] == (remainder(i, 5) == 0) and 0 <= v[1] <= 1 and v[2] == int(v[1] >= 0.5) for i, v in found[0].items())


ROWS = [
    (0, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 0), (1, "The  quick brown\tfox jumps over the lazy dog again and again", "en", "a", 0),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b", 0), (3, None, "en", None, 0), (4, "", "en", "b", 0), (5, " \n", None, "b", 0),
    (6, "un petit texte qui ne ressemble à rien du tout ici", "fr", "b", 0), (6, "a second text under the same id, quite another one", "en", "b", 0),
    (7, "word " * 5000, "en", "c", 0), (None, "a row without an id but with words", "en", "c", 0), (8, "x", "en", "", 0),
]


@pytest.fixture(scope="module")
def rows(spark):
    ship(spark)
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("__id", F.lit(1)).withColumn("kept", F.lit("clash")).repartition(3)


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact_stage(spark, rows):
    kept = corpus_pipeline.exact_duplicates(spark, rows.drop("__id", "kept"), "")
    groups: dict[str, list] = {}
    for i, t, *_ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i, t))
    # One row of every group of equal texts, that with the smallest id.
    assert sorted(i for i, _ in plain(kept) if i is not None) == sorted(min(g)[1] for g in groups.values() if not min(g)[0])
    assert kept.count() == len(groups) and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_stage(spark, rows):
    kept = corpus_pipeline.near_duplicates(spark, rows, "")
    # Rows 0, 1 and 2 have one set of shingles; nothing else is linked.
    assert plain(kept) == sorted([(i, t) for i, t, *_ in ROWS if i not in (1, 2)], key=repr) and kept.columns == rows.columns


def test_mixing_stage(spark, rows):
    docs = rows.drop("__id", "kept")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns
    taken = {}
    for row in plain(mixed):
        taken[row] = taken.get(row, 0) + 1
    assert set(taken) <= set(plain(docs)) and max(taken.values()) <= 4
    assert all(taken[(i, t)] == 1 for i, t, *_ in ROWS if not (t or "").split())


def test_packing_stage(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    got = packing.pack(rows, path).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = coder.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4"))) for k in range(0, len(ids), 2048)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    places: dict[int, list] = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048


def test_stages_of_an_empty_table(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    ship(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
