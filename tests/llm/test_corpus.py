"""The corpus operators on a small table of odd rows, against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logsift.llm import exact_dedup, hyperminhash, language, mixing, packing, ppm, suffix_levels, tokens, topk, toxicity, wavelet
from logsift.llm.bytestext import U
from logsift.llm.shipping import ship
from logsift.llm.tokens import encode_all
from logsift.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `rank` int, bucket string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows() -> list[tuple]:
    rng = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta,", "épée", "naïve", "x1", "!!", "the", "of", "and", "omega."]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 40, 80, 200, 900)]
    near = base[4].replace("alpha", "ALPHA", 1) + " tail"
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " ", "\n\t", *base, base[4], near, base[5].replace(" ", "  ", 3), passage + " " + base[3], base[3] + " " + passage,
             passage, passage + passage, "aaaa" * 90, "a" * 30_000, "1 2 3 --", "<|endoftext|> x", "a\xa0b  c"]
    return [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2", "S3", "")[i % 5], 0, -1, 9, "b") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def with_repeats(spark, docs):
    return docs.unionByName(docs.where("doc_id in (5, 8)")).unionByName(docs.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, with_repeats):
    texts = {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in odd_rows()}
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    for share in (0.0, 0.5, 1.0):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(docs, share).collect()}
        assert got == {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    rows = exact_dedup.dedup(with_repeats).collect()
    assert len(rows) == with_repeats.count() and sum(r.kept for r in rows) == len(groups)
    assert exact_dedup.unique_documents(with_repeats).count() == len(groups)
    assert exact_dedup.dedup(empty(spark)).count() == 0


def test_perfect_hash_is_minimal():
    words = np.random.default_rng(1).integers(0, 2**63, (5000, 4), dtype=np.uint64)
    index = exact_dedup.PerfectHash.from_bytes(exact_dedup.PerfectHash.build(words).to_bytes())
    assert sorted(index.slots(words).tolist()) == list(range(5000))


def shingles(text: str | None, n: int) -> frozenset:
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rng = random.Random(n)
    rows = odd_rows()
    for g in range(6):  # groups of near copies at many similarities
        base = [f"g{g}x{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(12):
            copy = base[:]
            for _ in range(rng.randrange(0, max(2, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(999)}"
            rows.append((len(rows), " ".join(copy), "en", "s", 0, 0, 0, ""))
    sets = {r[0]: shingles(r[1], n) for r in rows}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), n).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def test_texts_beside_a_large_group_are_not_paired_with_all_of_it(spark, monkeypatch):
    """Some are a little below the limit to all of the group, some linked to one member or to each other only."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(150)]

    def changed(words: list[str], n: int, deleted: int = 0) -> list[str]:
        words = words[:]
        for at in rng.sample(range(1, len(words) - 1), n):
            words[at] = f"z{rng.randrange(10 ** 9)}"
        for at in sorted(rng.sample(range(len(words)), deleted), reverse=True):
            del words[at]
        return words

    members = [base] + [changed(base, rng.randrange(1, 5), rng.randrange(3)) for _ in range(150)]
    beside = [changed(base, 9, rng.randrange(3)) for _ in range(60)]
    linked = [changed(m, 7) for m in members[1:40]] + [changed(b, 5) for b in beside[:20]] + [changed(base, 0, 28) for _ in range(5)]
    texts = [" ".join(words) for words in members + beside + linked]
    rng.shuffle(texts)
    sets = [shingles(t, 2) for t in texts]
    root = list(range(len(texts)))
    links = [(a, b) for a in root for b in root[:a] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while (now := [min([root[i], *[root[b if a == i else a] for a, b in links if i in (a, b)]]) for i in range(len(root))]) != root:
        root = now
    tables = collections.defaultdict(list)

    def stored(df, label="table"):
        tables[label].append((out := materialize(df, label)).count())
        return out

    monkeypatch.setattr(hyperminhash, "materialize", stored)
    if late := getattr(hyperminhash, "_candidates", None):
        monkeypatch.setattr(hyperminhash, "_candidates", lambda *args: stored(late(*args), "near"))
    rows = [(i, t, "en", "s", 0, 0, 0, "") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) > 20
    # Fewer than the pairs of texts beside the group with its members.
    assert sum(tables["near"]) < 4000


def test_near_duplicates_of_nothing(spark, with_repeats):
    assert hyperminhash.near_duplicates(empty(spark)).count() == 0
    assert hyperminhash.near_duplicates(with_repeats).count() == with_repeats.count()


def test_token_table_leaves_room_for_other_workers():
    coder = tokens.PartEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert sum(getattr(coder, name).nbytes for name in ("keys", "slot", "start", "byte_at", "flat", "bytes")) < 50 << 20


def test_tokens_equal_whole_encoding():
    rng = random.Random(5)
    bits = ["a", "B", " ", "  ", "\n", " \n", "é", "\xa0", "　", "<|endoftext|>", "'s", "1", "!!", "\x1f", "\t", " z", "ñ", "́", "Σ", "的", "'ll", "\r\n", ".", "word", "🙂"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [None, "", " "]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [x.tolist() for x in encode_all(path, texts)] == [e.ids for e in want]


def test_tokens_of_a_text_with_more_parts_than_the_table(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_PARTS", 64)
    monkeypatch.setattr(tokens, "_SLOTS", 128)
    rng = random.Random(3)
    long = " ".join(f"{rng.getrandbits(48):x}" for _ in range(500)) + ".\nThe end, " + " ".join(str(i) for i in range(300))
    texts = ["a short text", long, None, "a short text", long[:2000]]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        coder = tokens.PartEncoder(path)
        want = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert [x.tolist() for x in coder.encode_group(texts)] == [e.ids for e in want]
        assert coder.n <= 64


def test_wavelet_round_trip(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = wavelet.write_shards(docs, path, 2, wavelet.shard_path(spark), shard_tokens=500)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_documents(shards).collect()}
    start, want, coder = 0, {}, Tokenizer.from_file(path)
    for r in odd_rows():
        ids = np.array(coder.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want[r[0]] = (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert got == want
    assert wavelet.read_documents(wavelet.write_shards(empty(spark), path, 2, wavelet.shard_path(spark))).count() == 0


def test_wavelet_rank_and_select():
    ids = np.random.default_rng(2).integers(0, 300, 3000).astype(np.uint32) * 7
    shard = wavelet.WaveletShard.from_bytes(wavelet.WaveletShard.build(ids, np.array([1]), np.array([True]), np.array([3000])).to_bytes())
    assert (shard.all_ids() == ids).all()
    for i in range(0, 3000, 97):
        token = int(ids[i])
        places = np.flatnonzero(ids == token)
        assert shard.access(i) == token and shard.rank(token, i) == int((places < i).sum()) and shard.count(token) == len(places)
        assert [shard.locate(token, k) for k in range(len(places) + 1)] == [*places.tolist(), -1]
    assert shard.count(5) == 0 and shard.locate(5, 0) == -1


def test_stored_shards_are_read_in_place(spark, docs, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = wavelet.write_shards(docs, path, 2, wavelet.shard_path(spark), shard_tokens=500)
    coder = Tokenizer.from_file(path)
    want = np.concatenate([np.array(coder.encode(r[1] or "", add_special_tokens=False).ids + [2], np.uint32) for r in odd_rows()])
    stored = sorted(shards.collect(), key=lambda r: (r["part"], r["shard"]))
    at = 0

    def refuse(*_, **__):
        raise AssertionError("unpacked or counted")

    # Access, counts and places come from the stored planes and counts alone.
    monkeypatch.setattr(wavelet.zstandard, "ZstdDecompressor", refuse)
    monkeypatch.setattr(wavelet.np, "bitwise_count", refuse)
    monkeypatch.setattr(wavelet.WaveletShard, "all_ids", refuse)
    for row in stored:
        shard = wavelet.WaveletShard.from_bytes(bytes(row["data"]))
        ids = want[at : at + row["n_tokens"]]
        at += row["n_tokens"]
        for i in range(0, len(ids), 37):
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert shard.access(i) == token and shard.rank(token, i) == int((places < i).sum())
            assert shard.locate(token, len(places) - 1) == places[-1] and shard.count(token) == len(places)
    assert at == len(want) and len(stored) > 3


def test_mixing(spark, with_repeats):
    rows = mixing.mix(with_repeats, keep=("doc_id", "source", "size"), range_rows=5).collect()
    assert len(rows) == with_repeats.count()
    size = collections.Counter()
    taken = collections.Counter()
    target = {}
    for r in rows:
        m = r["__mix"]
        size[r.source] += m["size"]
        taken[r.source] += m["taken"]
        target[r.source] = m["target"]
        assert 0 <= m["taken"] <= 3 * m["size"] and m["source_size"] >= m["size"]
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in full)
        want = {s: 3 * size[s] if s in full else rest * weight[s] / sum(weight[x] for x in sources if x not in full) for s in sources}
        new = {s for s in sources if want[s] > 3 * size[s]}
        if not new:
            break
        full |= new
    assert target == pytest.approx(want) and all(abs(taken[s] - want[s]) < 1 for s in sources)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_documents(with_repeats).columns == with_repeats.columns


def test_packing(spark, with_repeats):
    got = packing.pack(with_repeats, public_tokenizers.path("word_bpe_49k.json"), 256).toPandas()
    per = got.sort_values("offset").groupby("sequence_id")
    for _, x in per:
        assert x["offset"].tolist() == np.concatenate([[0], np.cumsum(x["length"])[:-1]]).tolist() and x["length"].sum() <= 256
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = sum(len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in with_repeats.collect())
    assert got["length"].sum() == whole and packing.pack(empty(spark), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_plan_is_tight():
    rng = random.Random(3)
    for capacity in (10, 64, 2048):
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(3000))
        load, used = collections.Counter(), collections.Counter()
        for length, _, pieces, per, _, first in packing.plan(counts, capacity):
            used[length] += pieces
            for i in range(pieces):
                load[first + i // per] += length
        assert used == counts and max(load.values()) <= capacity
        assert len(load) <= 1.06 * max(sum(n * c for n, c in counts.items()) / capacity, sum(c for n, c in counts.items() if 2 * n > capacity)) + 1


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 64]) for i in range(150)] + [(400, None), (420, [float("nan")] * 5), (440, [None] * 5), (None, [1.0] * 5)]
    rows += [(500 + i, [0.03125] * 5) for i in range(60)]
    good = {i: np.floor(np.float32(v).astype(float) * 64) for i, v in rows if i is not None and v is not None and all(x is not None and x == x for x in v)}
    want = {q: sorted(((-int(good[q] @ good[c]), c) for c in good if c != q))[:20] for q in good if q % 20 == 0}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(topk.top_k(table, F.col("vec_id") % 20 == 0, cell_candidates=40, cell_queries=5).collect()):
        got[r.query_id].append((-r.score, r.vec_id))
    assert got == want
    assert topk.top_k(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk.top_k(table.where("vec_id in (0, 3)"), F.col("vec_id") == 0).count() == 1


def test_top_k_of_few_and_of_many_large_vectors(spark):
    rng = np.random.default_rng(4)
    for n in (2, 12, 20, 300):
        vectors = rng.normal(size=(n, 64))
        whole = np.floor(64.0 * vectors).astype(np.int64)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        want = set()
        for q in range(0, n, 5):
            best = sorted((-int(whole[q] @ whole[i]), i) for i in range(n) if i != q)[:20]
            want |= {(q, rank, i, -score) for rank, (score, i) in enumerate(best, 1)}
        got = topk.top_k(table, F.col("vec_id") % 5 == 0, cell_candidates=100).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_language(spark, with_repeats):
    rng = random.Random(1)
    words = {"en": ["the", "house", "which", "with"], "de": ["der", "und", "nicht", "schön"]}
    rows = [(i, " ".join(rng.choice(words[l]) for _ in range(30)), l, "s", 0, 0, 0, "") for i, l in enumerate(["en", "de"] * 60)]
    model = language.train(spark.createDataFrame(rows, SCHEMA), F.col("doc_id") >= 20)
    got = language.predict(spark.createDataFrame(rows, SCHEMA), model).where("doc_id < 20").collect()
    assert all(r["__lang"]["lang"] == r.lang and not r["__lang"]["rejected"] for r in got)
    odd = {r.doc_id: r["__lang"] for r in language.predict(with_repeats, model).collect()}
    assert all(odd[i]["lang"] == "und" and odd[i]["rejected"] for i in (0, 1, 2, 3)) and len(odd) > 10
    nothing = language.train(empty(spark), F.lit(True))
    assert {r["__lang"]["lang"] for r in language.predict(with_repeats, nothing).collect()} == {"und"}


def test_toxicity(spark, with_repeats):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice("stone river cloud maple window paper".split()) for _ in range(40)]
        if i % 5 == 0:
            words[3:6] = [rng.choice(["badword", "nastyone", "foulthing"]) for _ in range(3)]
        rows.append((i, " ".join(words), "en", "s", 0, 0, 0, ""))
        labels.append((i, int(i % 5 == 0)))
    table, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r["__toxicity"] for r in toxicity.score(table, toxicity.train(table, marks, F.col("doc_id") >= 100)).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in got)
    blank = toxicity.train(table, marks.limit(0), F.lit(True))
    assert all(0 <= r["__toxicity"] <= 1 for r in toxicity.score(with_repeats, blank).collect())


def test_repeats(spark, docs, with_repeats):
    seen, want = set(), {}
    for r in odd_rows():
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(x for x, g in zip(data, gone) if not g)
        want[r[0]] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    for batches in (1, 4):
        got = {r.doc_id: tuple(r)[1:] for r in suffix_levels.remove_repeats(docs, batches=batches).collect()}
        assert got == want
    repeated = suffix_levels.remove_repeats(with_repeats).collect()
    assert len(repeated) == with_repeats.count() and all(tuple(r)[1:] == want[r.doc_id] for r in repeated if r.doc_id is not None)
    assert suffix_levels.remove_repeats(empty(spark)).count() == 0


def test_levels_merge_at_any_size(spark, monkeypatch):
    assert suffix_levels.batch_units(0) == [1, 1, 1, 5] and suffix_levels.batch_units(1 << 18) == [1, 1, 1, 4, 8, 17]
    assert len(suffix_levels.batch_units(1 << 30)) == 9
    seen, add = [], suffix_levels.SuffixLevels.add

    def watched(self, entries, *args, **options):
        seen.append(sorted(rank for rank, _ in self.levels))
        return add(self, entries, *args, **options)

    rng = random.Random(88)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150))
    noise = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200))
    table = spark.createDataFrame([(i, noise() + line + noise()) for i in range(64)], "doc_id long, text string")
    want = [tuple(r) for r in suffix_levels.remove_repeats(table, batches=1).orderBy("doc_id").collect()]
    monkeypatch.setattr(suffix_levels.SuffixLevels, "add", watched)
    monkeypatch.setattr(suffix_levels, "UNIT_ROWS", 4, raising=False)
    assert [tuple(r) for r in suffix_levels.remove_repeats(table).orderBy("doc_id").collect()] == want
    assert want[0][2] == 0 and all(r[2] >= 150 for r in want[1:])
    # The second batch merges with the first, the third stays beside it, the fourth has a rank of its own.
    assert seen == [[], [0], [1], [0, 1], [0, 1, 2]]


def test_repeats_of_long_runs(spark, monkeypatch):
    monkeypatch.setattr(suffix_levels, "RUN", 20, raising=False)
    compare = suffix_levels._compare

    def watched(length, k):
        inner = compare(length, k)

        def run(batches):
            def seen():
                count = {}
                for batch in batches:
                    for kh in batch["kh"]:
                        count[kh] = count.get(kh, 0) + 1
                    assert max(count.values(), default=0) <= 20, "a task compares a whole long run"
                    yield batch

            return inner(seen())

        return run

    monkeypatch.setattr(suffix_levels, "_compare", watched)
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(n))
    phrase, line = noise(60), noise(130)
    left, right = [noise(60) for _ in range(3)], [noise(60) for _ in range(3)]
    rows = [(i, noise(150) + rng.choice([*left, ""]) + (phrase if i % 3 else line) + rng.choice([*right, ""]) + noise(150)) for i in range(150)]
    seen, want = set(), {}
    for i, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        want[i] = (sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest())
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: tuple(r)[2:] for r in suffix_levels.remove_repeats(table).collect()} == want


def test_partial_matching(spark, docs):
    got = {r.doc_id: r for r in ppm.score(docs, F.col("doc_id") % 2 == 0, block_bytes=4000).collect()}
    rows, order = odd_rows(), ppm.ORDER
    context: dict = collections.defaultdict(collections.Counter)
    count: collections.Counter = collections.Counter()

    def symbols(t):
        return [255] * order + list((t or "").encode()) + [254]

    def tokens(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None]

    for r in rows:
        if r[0] % 2 == 0:
            q = symbols(r[1])
            count.update(tokens(r[1]))
            for p in range(order, len(q)):
                for m in range(order + 1):
                    context[tuple(q[p - m : p])][q[p]] += 1
    n, v = sum(count.values()), len(count)
    for r in rows:
        q, total = symbols(r[1]), 0.0
        for p in range(order, len(q)):
            out: set = set()
            for m in range(order, -1, -1):
                seen = context.get(tuple(q[p - m : p]), {})
                t, d = sum(c for s, c in seen.items() if s not in out), sum(s not in out for s in seen)
                if not t:
                    continue
                if q[p] in seen:
                    total += math.log10(seen[q[p]] / (t + d))
                    break
                total += math.log10(d / (t + d))
                out |= set(seen)
            else:
                total += math.log10(1 / (255 - len(out)))
        g = got[r[0]]
        assert g.score == pytest.approx(total) and g.train_tokens == n and g.n_tokens == len(tokens(r[1]))
        assert g.n_known == sum(count[w] > 0 for w in tokens(r[1]))
        assert g.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(r[1])))
    assert ppm.score(empty(spark), F.lit(True)).count() == 0


def test_pipeline_stages(spark, with_repeats):
    rows = with_repeats
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, "")
        assert rows.columns == with_repeats.columns
    assert U is np.uint64 and corpus_pipeline.STAGES[-1][1](spark, rows, "").count() > 0
