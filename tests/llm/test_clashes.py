"""Words that a weak hash confuses, and rows that share an id."""

from __future__ import annotations

import math
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logsift.llm import bytestext, hyperminhash, language, packing, ppm, suffix_levels, tokens, toxicity, wavelet
from logsift.llm.shipping import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n: int, flip: bool) -> str:
    """Letters by the parity of the ones in their place: equal to any polynomial hash modulo 2**64 with the letters swapped."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


TWINS = [(thue_morse(n, False), thue_morse(n, True)) for n in (1024, 2048)]


@pytest.fixture(scope="module")
def twins(spark):
    ship(spark)
    texts = [w for pair in TWINS for w in pair] + [f"{w} and more" for pair in TWINS for w in pair]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).coalesce(1)


def test_hashes_of_regular_words():
    for a, b in TWINS:
        buf = np.frombuffer(f"{a} {b}".encode(), np.uint8)
        starts, ends = bytestext.word_limits(buf)
        x, y = bytestext.part_hashes(buf, starts, ends)
        assert x != y


def test_part_hashes_equal_plain_polynomials(monkeypatch):
    rng = np.random.default_rng(6)
    buf = rng.integers(0, 256, 3000).astype(np.uint8)
    cuts = np.unique(rng.integers(0, 3001, 200))
    p = (1 << 61) - 1

    def plain(part: bytes) -> int:
        value = sum((c + 1) * pow(bytestext.PART_BASE, i, p) for i, c in enumerate(part)) % p
        return int(bytestext.mix(np.array([(value + len(part) * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0])

    want = [plain(buf[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    for chunk in (1, 50, 1 << 20):
        monkeypatch.setattr(bytestext, "CHUNK", chunk)
        assert bytestext.part_hashes(buf, cuts[:-1], cuts[1:]).tolist() == want
    monkeypatch.setattr(bytestext, "_LONG_PART", 5)
    assert len(set(bytestext.part_hashes(buf, cuts[:-1], cuts[1:]).tolist())) == len({buf[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])})


def test_tokens_of_regular_words(spark, twins):
    texts = [r.text for r in twins.orderBy("doc_id").collect()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        assert [x.tolist() for x in tokens.encode_all(path, texts)] == [e.ids for e in want]
    path = public_tokenizers.path("byte_bpe_50k.json")
    read = {r.doc_id: r.ids_crc32 for r in wavelet.read_documents(wavelet.write_shards(twins, path, 2, wavelet.shard_path(spark))).collect()}
    coder = Tokenizer.from_file(path)
    assert read == {i: zlib.crc32(np.array(coder.encode(t, add_special_tokens=False).ids + [2], "<u4")) for i, t in enumerate(texts)}


def test_parts_with_equal_hashes(monkeypatch):
    # Every part collides with every other: the ids still come from the bytes.
    monkeypatch.setattr(tokens, "part_hashes", lambda buf, starts, ends: np.full(len(starts), 7, np.uint64))
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["some words here, and more.", "other words\nhere", "some words", ""]
    coder = tokens.PartEncoder(path)
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        assert [x.tolist() for x in coder.encode_group(texts)] == [e.ids for e in want]


def test_packing_of_regular_words(spark, twins):
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pack(twins, path).collect()}
    want = {}
    for r in twins.collect():
        ids = coder.encode(r.text, add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            want[r.doc_id, k // 2048] = (k, len(part), zlib.crc32(part))
    assert got == want


def test_near_duplicates_of_regular_words(twins):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in hyperminhash.near_duplicates(twins, 2).collect()}
    assert got == {i: (1 if i < 4 else 2, i) for i in range(8)}


def test_partial_matching_knows_regular_words_apart(twins):
    rows = {r.doc_id: r for r in ppm.score(twins.where("doc_id < 4"), F.col("doc_id") % 2 == 0).collect()}
    assert {i: r.n_known for i, r in rows.items()} == {0: 2, 1: 1, 2: 2, 3: 1}
    smooth = math.log10(4 + 0.1 * 4)
    assert rows[1].base_score == pytest.approx(math.log10(0.1) + math.log10(2.1) - 2 * smooth)


LONG = " ".join(f"w{i}" for i in range(300))
OTHER = " ".join(f"u{i}" for i in range(300))


@pytest.fixture(scope="module")
def clashing(spark):
    ship(spark)
    rows = [(0, LONG), (1, LONG + " tail"), (1, OTHER), (2, OTHER + " tail"), (3, None), (3, "alone"), (None, LONG), (5, LONG + " end"), (5, LONG + " end"), (0, "0 " + LONG)]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)


def test_near_duplicates_with_clashing_ids(clashing):
    got = sorted(((r.doc_id, r.text, r.component_id, r.kept) for r in hyperminhash.near_duplicates(clashing).join(
        clashing.selectExpr("xxhash64(text) as text_hash", "text", "doc_id as id"), "text_hash").where("doc_id <=> id").distinct().collect()), key=repr)
    assert got == sorted([
        (0, LONG, 0, True), (0, "0 " + LONG, 0, True), (1, LONG + " tail", 0, False), (1, OTHER, 1, True), (2, OTHER + " tail", 1, False), (3, None, 3, True),
        (3, "alone", 3, True), (None, LONG, None, True), (5, LONG + " end", 0, False)], key=repr)


def test_pipeline_keeps_one_row_of_each_group(spark, clashing):
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, clashing, "").collect()), key=repr)
    first = min([(0, LONG), (0, "0 " + LONG)], key=lambda r: clashing.where(F.col("text") == r[1]).selectExpr("xxhash64(text)").first()[0])
    assert kept == sorted([first, (1, OTHER), (3, None), (3, "alone"), (None, LONG)], key=repr)
    assert corpus_pipeline.near_duplicates(spark, clashing.limit(0), "").count() == 0


def test_training_is_bounded_where_an_id_repeats(spark, monkeypatch):
    rows = [(7, f"the same id {i}", "en", "s", 0) for i in range(4000)] + [(i, f"le petit texte {i}", "fr", "s", 0) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seen = []
    monkeypatch.setattr(language, "fit", lambda rows, languages: seen.append(len(rows)) or language.LanguageModel(languages, None, None, 1.0, 0.0))
    language.train(docs, F.lit(True), rows_per_language=100)
    monkeypatch.setattr(toxicity, "fit", lambda terms, fired, *rest: seen.append(len(fired)))
    labels = spark.createDataFrame([(7, 1), (7, 1), *[(i, 0) for i in range(100, 160)]], "doc_id long, toxic int")
    toxicity.train(docs, labels, F.lit(True), rows_per_label=100)
    assert seen == [160, 160]


def test_short_and_long_parts_with_equal_hashes(monkeypatch):
    # Numbers of a part collide as well; zero bytes and parts that share their first 16 bytes are told apart.
    monkeypatch.setattr(tokens, "part_hashes", lambda buf, starts, ends: np.full(len(starts), 7, np.uint64))
    monkeypatch.setattr(tokens, "_number_hashes", lambda first, second, size: np.full(len(size), 7, np.uint64))
    stems = ["a" * n for n in (7, 8, 9, 15, 16, 17, 33)] + ["abcdefghijklmnop" + x for x in ("", "q", "r", "qr", "rq")] + ["x\0", "x", "x\0\0"]
    texts = [" ".join(stems), "\n".join(reversed(stems)), *stems, "".join(stems)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        coder = tokens.PartEncoder(path)
        want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        for _ in range(2):
            assert [x.tolist() for x in coder.encode_group(texts)] == [e.ids for e in want]


def test_hashes_of_most_parts_look_at_no_single_byte(monkeypatch):
    looked = []
    monkeypatch.setattr(tokens, "part_hashes", lambda buf, starts, ends: looked.append(int((ends - starts).sum())) or bytestext.part_hashes(buf, starts, ends))
    text = " ".join(f"word{i}" for i in range(3000)) + " " + "long" * 10
    coder = tokens.PartEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(next(coder.encode_group([text]))) and sum(looked) < 50
    tables = [x for x in vars(coder).values() if isinstance(x, np.ndarray)]
    assert sum(x.nbytes for x in tables) < 40 << 20


def test_planes_of_many_and_few_ids():
    rng = np.random.default_rng(4)
    for most in (1, 2, 300, 1 << 16, 1 << 18):
        ids = np.concatenate([np.arange(most), rng.integers(0, most, 1000)]).astype(np.uint32)
        shard = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build(ids, np.array([1]), np.array([True]), np.array([len(ids)])).to_bytes())
        assert (shard.all_ids() == ids).all() and [shard.access(i) for i in range(0, len(ids), 1 + len(ids) // 50)] == ids[:: 1 + len(ids) // 50].tolist()


def test_workers_take_little_memory():
    # Executors run several workers, and each keeps what it once took.
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 123, 3000, np.uint8)).replace(b"e", b" ").decode() for _ in range(1400)]
    batch = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    bytestext._powers.clear()
    for work in (lambda: suffix_levels._entries(100, 32)(iter([batch])), lambda: (hyperminhash.shingle_sets(part, 5) for part in bytestext.groups(bytestext.utf8(texts)))):
        tracemalloc.start()
        for _ in work():
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 40 << 20


def test_tasks_give_free_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(bytestext.ctypes, "CDLL", lambda name: type("C", (), {"malloc_trim": staticmethod(given.append)}))
    assert list(bytestext.lean(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and given == [0]
