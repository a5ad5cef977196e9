"""Best-fit packing of documents into sequences (operator 7).

Packing depends on lengths alone, so it is planned on the number of pieces of each length, which
is at most as many numbers as a sequence has tokens: pieces above a third of the capacity are matched
greedily, at most two to a sequence, and smaller ones fill the tightest gaps, longest first. The
plan hands out ranks within a length; every piece gets its rank by distributed counting and finds its place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tokens import encode_all

RANGE_PIECES = 20_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, pieces, per sequence, offset, first sequence).

    A step takes ``pieces`` consecutive ranks of a length and puts ``per sequence`` of them, one after the
    other, at ``offset`` into consecutive sequences. Equal sequences are handled as one, so the
    work and the plan depend on the capacity, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    made = 0  # sequences so far
    gaps: list[int] = []  # sorted sizes of open gaps
    open_: dict[int, list[list[int]]] = {}  # gap -> [first sequence, number] with that gap

    def put(length: int, pieces: int, per: int, offset: int, first: int) -> None:
        steps.append((length, rank[length], pieces, per, offset, first))
        rank[length] += pieces
        left[length] -= pieces

    def add(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append([first, number])

    def fill(length: int, first: int, number: int, gap: int) -> None:
        """Put pieces of one length into equal sequences until either runs out."""
        per = min(gap // length, left[length])
        full = min(number, left[length] // per)
        offset = capacity - gap
        put(length, full * per, per, offset, first)
        add(gap - full_length(per, length), first, full)
        if full < number and left[length]:  # fewer than ``per`` are left: one sequence takes them
            rest = left[length]
            put(length, rest, rest, offset, first + full)
            add(gap - full_length(rest, length), first + full, 1)
            full += 1
        add(gap, first + full, number - full)

    def full_length(number: int, length: int) -> int:
        return number * length

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    smaller = sorted(large)  # partners, by length
    for length in large:
        while left[length]:
            # The longest partner that fits beside it.
            at = bisect_left(smaller, capacity - length + 1) - 1
            while at >= 0 and not left[smaller[at]]:
                smaller.pop(at)
                at -= 1
            partner = smaller[at] if at >= 0 else 0
            if partner == length:
                pairs = left[length] // 2
                if pairs:
                    put(length, 2 * pairs, 2, 0, made)
                    add(capacity - 2 * length, made, pairs)
                    made += pairs
                if left[length]:
                    below = [n for n in smaller[:at] if left[n]]
                    if below:
                        put(length, 1, 1, 0, made)
                        put(below[-1], 1, 1, length, made)
                        add(capacity - length - below[-1], made, 1)
                    else:
                        put(length, 1, 1, 0, made)
                        add(capacity - length, made, 1)
                    made += 1
            elif partner:
                pairs = min(left[length], left[partner])
                put(length, pairs, 1, 0, made)
                put(partner, pairs, 1, length, made)
                add(capacity - length - partner, made, pairs)
                made += pairs
            else:
                alone = left[length]
                put(length, alone, 1, 0, made)
                add(capacity - length, made, alone)
                made += alone
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
                fill(length, first, number, gap)
            else:
                number = -(-left[length] // (capacity // length))
                made += number
                fill(length, made - number, number, capacity)
    return steps


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, piece, start, length, ids_crc32) per piece of at most ``capacity`` tokens."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            end = np.array([end_id], np.uint32)
            for doc_id, ids in zip(batch["doc_id"].tolist(), encode_all(tokenizer, batch["text"].tolist())):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64") if batch["doc_id"].isna().any() else out["doc_id"].astype("int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int, range_pieces: int = RANGE_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``capacity``; the rows must be stored."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    steps = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    n_ranges = max(1, -(-sum(counts.values()) // range_pieces))
    rows = pieces.withColumn("__range", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32"), F.lit(n_ranges)))
    sums = rows.groupBy("length", "__range").agg(F.count("*").alias("__n"))
    upto = sums.select("length", "__range", (F.sum("__n").over(Window.partitionBy("length").orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("length", "__range").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("__inside", inside).join(upto, ["length", "__range"]).withColumn("__rank", (F.col("__before") + F.col("__inside")).cast("long"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = steps[:, 0] * (1 << 44) + steps[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["__rank"].to_numpy(np.int64)
            step = steps[np.searchsorted(wide, length * (1 << 44) + rank, side="right") - 1]
            at = rank - step[:, 1]
            batch = batch.drop(columns=["__rank"])
            batch["sequence_id"] = step[:, 5] + at // step[:, 3]
            batch["offset"] = step[:, 4] + at % step[:, 3] * length
            yield batch

    slim = ranked.select(*pieces.columns, "__rank")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return slim.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents: one row per piece with its place.

    A document is its ids and ``end_id``; null text is empty, so a document always has a piece. Longer ones are cut at
    ``capacity``. Repeated rows are packed as often as they occur. An empty table gives an empty result.
    """
    return pack_pieces(materialize(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces"), capacity)
