"""SimHash, fill-in-the-middle and the prefix trie on odd rows, against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logsift.llm import fim, prefix_trie, simhash
from logsift.llm.shipping import ship

DOCS = "doc_id long, text string, lang string, fim string, `row` int, node string, component_id long"


@pytest.fixture(scope="module")
def odd(spark):
    ship(spark)
    rng = random.Random(11)
    words = ["Alpha", "beta", "gamma\n", "épée", "<P", ">", "\n\n", "the", "of", "x1", "的", "\x0b", "\xa0", "S>"]
    texts = [None, "", " ", "\n", "\n\n\n", "no line end", "end\n", "a\r\nb", "<M> inside", "x<S>", "<P", "ÀÉ\nö\n的", "A b", "a B", "one two three", "ONE  two\tthree"]
    texts += ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    for i in range(12):  # near copies
        copy = base[:]
        copy[rng.randrange(300)] = f"z{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(base), " ".join(base), "line \n" * 30_000, "y" * 200_000]
    rows = [(i, t, "en", "f", 1, "n", -1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[-1], (7, "another text under one id", None, None, None, None, None), (None, "no id\nat all", "en", "", 0, "", 0), (None, None, None, "", 0, "", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, DOCS).repartition(3)


def expected_fim(doc_id, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, s, m = marks
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return len(units), "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


@pytest.mark.parametrize("options", [{}, {"seed": 3, "rate": 60, "spm": 20, "marks": ("[pre]", "[suf]", "|")}])
def test_fill_in_middle(docs, odd, options, monkeypatch):
    made = fim.transform(docs, **options)
    back = fim.restored(F.col("fim.output"), F.col("fim.form"), options.get("marks", fim.MARKS))
    got = made.select("row.doc_id", "row.text", "row.fim", "fim.*", back.alias("back")).collect()
    key = lambda t: tuple(map(repr, t))
    assert sorted([(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode()) for r in got], key=key) == sorted(
        [(r[0], r[1], *expected_fim(r[0], r[1], **options)) for r in odd], key=key)
    assert all(bytes(r.back).decode() == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_in_short_stretches(odd, monkeypatch):
    monkeypatch.setattr(fim, "CHUNK", 37)
    texts = [(r[1] or "").encode() for r in odd][:80]
    draws = np.random.default_rng(2).integers(0, 1 << 32, (len(texts), 4))
    marks = tuple(m.encode() for m in fim.MARKS)
    _, form, _, outputs, _ = fim.build(texts, draws, 100, 50, marks)
    assert fim.restore_group(outputs, form, marks) == texts
    assert sum(map(len, outputs)) == sum(map(len, texts)) + 9 * int((form != fim.PLAIN).sum())


def plain_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(prints: list[tuple], radius: int) -> list:
    """Per (doc_id, fingerprint): the smallest id over links of fingerprints."""
    nodes = sorted({f for _, f in prints})
    root = {f: f for f in nodes}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = collections.defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[find(f)].append(i)
    return [min(least[find(f)], default=None) for _, f in prints]


def test_simhash(spark, docs, odd):
    prints = [(r[0], plain_fingerprint(r[1])) for r in odd]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(prints, smallest_reachable(prints, 3))), key=repr)
    for tile in (2, simhash.TILE):
        got = sorted(map(tuple, simhash.near_duplicates(docs, tile=tile).collect()), key=repr)
        assert got == want
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    nameless = simhash.near_duplicates(spark.createDataFrame([(None, "only text", None, "", 0, "", 0)], DOCS)).collect()
    assert [(r.doc_id, r.component_id) for r in nameless] == [(None, None)]


def test_simhash_in_short_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join("x" * rng.choice([1, 3, 90]) + str(rng.randrange(50)) for _ in range(n)) + "\n"
        assert simhash.fingerprint(text.encode(), 3) % (1 << 64) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_simhash_links_near_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    nodes = set(rng.integers(0, 1 << 63, 300).tolist())
    for base in list(nodes)[:40]:  # neighbours at every distance around the radius, in chains
        at = base
        for _ in range(6):
            for bit in rng.choice(63, rng.integers(0, radius + 3), replace=False):
                at ^= 1 << int(bit)
            nodes.add(at)
    nodes |= {0, 1, 7, -1, -2}
    frame = spark.createDataFrame([(x,) for x in nodes], "node long")
    links = simhash.links(frame, radius, tile=16).collect()
    place = {x: i for i, x in enumerate(sorted(nodes))}
    label = np.arange(len(place))
    simhash.union(label, np.array([place[r.a] for r in links], int), np.array([place[r.b] for r in links], int))
    unsigned = [x % (1 << 64) for x in sorted(nodes)]
    least = smallest_reachable([(i, f) for i, f in enumerate(unsigned)], radius)
    assert label.tolist() == least


def test_tile_links_equal_all_pairs():
    rng = np.random.default_rng(8)
    values = np.unique(np.concatenate([rng.integers(0, 1 << 62, 700).astype(np.uint64), (1 << 40) + rng.integers(0, 600, 400).astype(np.uint64)]))
    x, y = simhash.tile_links(values, values, True, 3)
    assert len(x) < len(values) and (np.bitwise_count(x ^ y) <= 64).all()
    place = {v: i for i, v in enumerate(values.tolist())}
    label, full = np.arange(len(values)), np.arange(len(values))
    simhash.union(label, np.array([place[v] for v in x.tolist()]), np.array([place[v] for v in y.tolist()]))
    simhash.union(full, *np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= 3))
    assert (label == full).all()


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, p1 int, weight string"


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv_id].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = int(np.fix(c / 5)) * 5
        whole[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for node, convs in members.items():
        below = [v for v in members if v[: len(node)] == node]
        kids = [v for v in members if len(v) == len(node) + 1 and v[:-1] == node]
        leaves = [v for v in below if not any(len(w) == len(v) + 1 and w[:-1] == v for w in members)]
        ends = ",".join(map(str, sorted(c for c in convs if whole[c] == node)))
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_conversations():
    rng = random.Random(13)
    rows = []
    for c in range(60):
        for t in range(rng.choice([0, 1, 1, 2, 4, 7, 12])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "ok", "Füße", ""]), "d", 1, "w"))
    rows += [(c, t, "user", "the same", "", 0, "") for c in range(100, 140) for t in range(10)]
    rows += [(200, None, None, None, "", 0, ""), (200, 3, "b", "x", "", 0, ""), (200, 3, "a", "x", "", 0, ""), (200, 3, "a", "x", "", 0, ""), (200, 3, None, "x", "", 0, "")]
    rows += [(None, 1, "user", "nobody", "", 0, ""), (-7, 1, "user", "negative", "", 0, ""), (-5, 1, "user", "negative", "", 0, "")]
    rows += [(301, t, "user", f"turn {t % 7}", "", 0, "") for t in range(900)]  # one conversation over several ranges
    return rows


def test_prefix_trie(spark, monkeypatch):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, CONVERSATIONS).repartition(4)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    got = sorted(map(tuple, prefix_trie.trie(frame).collect()), key=repr)
    small = [r for r in rows if r[0] != 301]
    long = [r for r in got if r[0] == 301 and r[1] > 9]
    head = zlib.crc32(b"301") % 9  # its base does not exist, so its first turns are nobody's
    assert len(long) == 900 - head - 9 and all(r[3] == 1 and r[6] == 0 for r in long)
    without = sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(small, CONVERSATIONS)).collect()), key=repr)
    assert without == brute_trie(small)
    assert prefix_trie.trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_running_sums_over_ranges(spark, monkeypatch):
    # One key over many ranges, sums beyond 64 bits, other keys before and behind it.
    rng = np.random.default_rng(3)
    rows = [(k, i, int(v)) for k, n in ((-1, 3), (5, 4000), (6, 1), (9, 40)) for i, v in enumerate(rng.integers(-(2**63), 2**63 - 1, n))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        summed = prefix_trie.running_sums(spark.createDataFrame(rows, "k long, o long, v long").repartition(3), "k", ["o"], ["v"], "test").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    at = collections.defaultdict(int)
    want = {}
    for k, o, v in rows:
        want[k, o] = (at[k] + 2**63) % 2**64 - 2**63
        at[k] += v
    assert {(r.k, r.o): r.before_v for r in summed} == want


def test_end_list_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    rows = [(1, 7, 7, c) for c in range(-20, 2000)] + [(1, 7, 8, 5), (2, 0, 0, 3), (2, 0, 0, -3)]
    got = {tuple(r)[:3]: r.ends_sha256 for r in prefix_trie.end_lists(spark.createDataFrame(rows, "depth long, p1 long, p2 long, conv_id long").repartition(5)).collect()}
    lists = collections.defaultdict(list)
    for *key, c in rows:
        lists[tuple(key)].append(c)
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in lists.items()}
