"""Near duplicates by SimHash fingerprints, compared exactly in tiles (operator 11).

Fingerprints at most ``radius`` bits apart differ by no more than that in the sum of the differences of their four
16-bit words' population counts. These four counts name a cell (at most 17**4 of them, whatever the input); the distinct fingerprints of
a cell are cut into tiles of bounded size, and only tiles of cells within the radius meet. A task compares two tiles in small
squares by exclusive-or and bit counts and leaves out squares whose byte-wise population counts lie further
apart. No bound is put on what is compared beyond that, so every link is found. Of the links of two tiles only as many
as it takes to join their fingerprints leave the task, never all pairs of a large group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bytestext import CHUNK, IS_SPACE
from .components import components

SEED = 42
# Fingerprints per tile, about; only the size of tasks depends on it.
TILE = 16_384
_SQUARE = 256
# Pairs of tiles with fewer comparisons than that are worked on together.
_SMALL = 1024
_WORDS, _WORD_BITS = 4, 16


def pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of about a megabyte; a longer word stays whole."""
    at = 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while cut < len(text) and not IS_SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included; with fewer words, of the whole sequence."""
    held: list[bytes] = []  # the last words of the piece before
    found = False
    for piece in pieces(text):
        # bytes.lower() and bytes.split() know ASCII letters and ASCII white space only.
        sequence = held + piece.lower().split()
        if len(sequence) >= words:
            joined = b" ".join(sequence)
            ends = np.cumsum([len(w) + 1 for w in sequence]) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            spans = zip(starts[: len(ends) - words + 1].tolist(), ends[words - 1 :].tolist())
            yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], ">u8")
            found = True
        held = sequence[max(0, len(sequence) - words + 1) :]
    if held and not found:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], ">u8")


def fingerprint(text: bytes, words: int) -> int:
    """Bits set in over half the shingle hashes, as a signed 64-bit number; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        for i in range(0, len(hashes), CHUNK >> 4):
            some = hashes[i : i + (CHUNK >> 4)]
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprint_of(text: Column, words: int) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t or b"", words) for t in batch], dtype="int64")

    return F.pandas_udf(run, "long")(text.cast("binary"))


def union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the groups of ``x[i]`` and ``y[i]``; every place then carries the smallest place of its group."""
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def _boxes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest byte-wise population counts of each square's side."""
    counts = np.bitwise_count(values.view(np.uint8).reshape(-1, 8)).astype(np.int8)
    at = np.arange(0, len(values), _SQUARE)
    return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def _by_counts(values: np.ndarray) -> np.ndarray:
    """Fingerprints of like byte-wise counts next to each other, if there is more than one square of them."""
    if len(values) <= _SQUARE:
        return values
    counts = np.bitwise_count(values.view(np.uint8).reshape(-1, 8))
    return values[np.lexsort(counts.T)]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints that join whatever two tiles (``same``: one tile with itself) link."""
    a = _by_counts(np.ascontiguousarray(a))
    b = a if same else _by_counts(np.ascontiguousarray(b))
    nodes = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(nodes))
    low_a, high_a = _boxes(a)
    low_b, high_b = _boxes(b)
    for i in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_a[i] - high_b, low_b - high_a[i])).sum(axis=1)
        rows = a[i * _SQUARE : (i + 1) * _SQUARE, None]
        for j in np.flatnonzero(gap <= radius).tolist():
            if same and j < i:
                continue
            x, y = np.nonzero(np.bitwise_count(rows ^ b[None, j * _SQUARE : (j + 1) * _SQUARE]) <= radius)
            union(label, x + i * _SQUARE, y + j * _SQUARE + shift)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved], nodes[label[moved]]


def small_links(a: list[np.ndarray], b: list[np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (as values) of many pairs of small tiles, compared in one numpy pass."""
    n_a, n_b = (np.array([len(t) for t in side], np.int64) for side in (a, b))
    at_a, at_b = (np.cumsum(n) - n for n in (n_a, n_b))
    of = np.repeat(np.arange(len(a)), n_a)  # one row of comparisons per fingerprint of the first side
    first = np.concatenate(a)
    length = n_b[of]
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(len(of)), length)
    second = np.concatenate(b)[np.arange(len(row)) - np.repeat(start - at_b[of], length)]
    hit = np.flatnonzero(np.bitwise_count(first[row] ^ second) <= radius)
    return first[row[hit]], second[hit]


def spanning(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same values as the given ones, fewer than there are values."""
    nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    label = np.arange(len(nodes))
    union(label, place[: len(x)], place[len(x) :])
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = ([np.asarray(t, np.int64).view(np.uint64) for t in batch[c]] for c in ("tile", "other"))
            found, small, waiting = [], [], 0
            for i, same in enumerate(batch["same"].tolist()):
                size = len(a[i]) * len(b[i])
                if size > _SMALL:
                    found.append(tile_links(a[i], b[i], same, radius))
                    continue
                small.append(i)
                waiting += size
                if waiting > CHUNK:
                    found.append(small_links([a[k] for k in small], [b[k] for k in small], radius))
                    small, waiting = [], 0
            if small:
                found.append(small_links([a[k] for k in small], [b[k] for k in small], radius))
            if found:
                x, y = spanning(*(np.concatenate(side) for side in zip(*found)))
                yield pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})

    return run


def steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of cell counts within the radius, one of each pair of opposites: 65 at radius 3."""
    span = range(-radius, radius + 1)
    return [s for s in itertools.product(span, repeat=_WORDS) if sum(map(abs, s)) <= radius and s >= (0,) * _WORDS]


def links(nodes: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join all fingerprints (column ``node``, distinct longs) at most ``radius`` bits apart."""
    base = _WORD_BITS + 1
    counts = [F.bit_count(F.shiftrightunsigned("node", _WORD_BITS * i).bitwiseAND(F.lit((1 << _WORD_BITS) - 1))).cast("int") for i in range(_WORDS)]
    celled = nodes.select("node", F.array(*counts).alias("counts"))

    def cell(of: Column) -> Column:
        code = F.lit(0)
        for i in range(_WORDS):
            code = code * base + of[i]
        return code

    celled = celled.withColumn("cell", cell(F.col("counts")))
    # At most 17**4 rows, whatever the input.
    cells = materialize(celled.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells")
    tiled = celled.join(F.broadcast(cells), "cell").withColumn("no", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiles = materialize(tiled.groupBy("cell", "no").agg(F.any_value("counts").alias("counts"), F.collect_list("node").alias("tile")), "tiles")
    step = F.array(*[F.array(*[F.lit(x) for x in s]) for s in steps(radius)])
    visits = tiles.select("cell", "no", "counts", "tile", F.explode(step).alias("step"))
    near = F.transform("counts", lambda c, i: c + F.get(F.col("step"), i))
    visits = visits.withColumn("near", near).where(F.forall("near", lambda c: (c >= 0) & (c <= _WORD_BITS)))
    visits = visits.select(F.col("cell").alias("from"), F.col("no").alias("from_no"), "tile", cell(F.col("near")).alias("cell"))
    visits = visits.join(F.broadcast(cells), "cell").withColumn("no", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # Two tiles of one cell meet once.
    visits = visits.where((F.col("cell") != F.col("from")) | (F.col("no") >= F.col("from_no")))
    others = tiles.select("cell", "no", F.col("tile").alias("other"))
    same = (F.col("cell") == F.col("from")) & (F.col("no") == F.col("from_no"))
    pairs = visits.join(others, ["cell", "no"]).select("tile", "other", same.alias("same"))
    return pairs.mapInPandas(_compare(radius), "a long, b long")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, node): every row's fingerprint as a signed long."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_of(F.col(text_col), words).alias("node"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row.

    A row's fingerprint (16 lowercase hex digits) has the bits that over half of its ``words``-word shingles' hashes have
    set; null texts and texts without words have fingerprint zero, which is linked like any other. Rows whose fingerprints
    differ in at most ``radius`` bits are linked, and component_id is the smallest doc_id reachable. Fingerprints are the nodes, so repeated ids are
    judged each by its own text; a null id is linked but names no component, which is null where no row has an id. An empty table gives an
    empty result; other columns are not read.
    """
    rows = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
    joined = components(links(nodes.select("node"), radius, tile))
    classed = nodes.join(joined, "node", "left").withColumn("class", F.coalesce("component", "node"))
    named = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    of = materialize(classed.select("node", "class").join(named, "class").select("node", "component_id"), "classes")
    # Very many copies of one fingerprint are split by the skew handling of the join.
    return rows.join(of, "node").select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
