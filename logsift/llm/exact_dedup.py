"""Exact duplicates against an index of what was seen before (operator 4).

The distinct digests of the past are dealt to shards; each shard gets a minimal perfect
hash, whose slots hold the full digest, the locator of the row that stays and the number
of rows. A new batch is reduced to its distinct digests before it is shuffled, looked up in the
shards and compared byte by byte. Members are repeats; the others form groups of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .bytestext import U, mix

SHARD_DIGESTS = 200_000
_GAMMA = 2.0
_LEVELS = 48


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests: bit levels without collisions, ranked."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels = levels
        self.rest = rest  # digests that no level could place, in byte order; practically none
        self.ranks = np.concatenate([[0], np.cumsum([int(x.sum()) for x in levels])])

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = U((level * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
        return (mix(mix(words[:, 0] ^ salt) + words[:, 1]) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """``digests``: uint64 matrix with four columns, rows distinct."""
        levels: list[np.ndarray] = []
        left = digests
        while len(left) and len(levels) < _LEVELS:
            size = max(64, int(_GAMMA * len(left)))
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, left[np.lexsort(left.T[::-1])] if len(left) else left)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; digests that are no members get any slot, or -1."""
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            at = self._place(digests[left], level, len(bits))
            hit = bits[at]
            order = np.cumsum(bits) - 1
            out[left[hit]] = self.ranks[level] + order[at[hit]]
            left = left[~hit]
        for i, row in enumerate(self.rest):
            out[left[(digests[left] == row).all(axis=1)]] = self.ranks[-1] + i
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest), *map(len, self.levels)], "<i8").tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels) + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n, n_rest = np.frombuffer(data, "<i8", 2).tolist()
        sizes = np.frombuffer(data, "<i8", n, 16).tolist()
        at, levels = 16 + 8 * n, []
        for size in sizes:
            width = -(-size // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels, np.frombuffer(data, U, 4 * n_rest, at).reshape(-1, 4))


def normalised(text: Column | str) -> Column:
    """White space runs as one blank; null as an empty text."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (doc_id, row_no, digest) per row. ``row_no`` tells repeated rows apart."""
    return materialize(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"),
        F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)).alias("digest"),
    ), "digests")


def distinct_digests(rows: DataFrame) -> DataFrame:
    """(digest, keep_id, keep_row, n): the smallest doc_id of each digest (nulls last), reduced before the shuffle."""
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_no")
    found = rows.groupBy("digest").agg(F.min(order).alias("keep"), F.count("*").alias("n"))
    return found.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_no").alias("keep_row"), "n")


def _matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), U).reshape(-1, 4)


def _build(_key, group: pd.DataFrame) -> pd.DataFrame:
    words = _matrix(group["digest"])
    index = PerfectHash.build(words)
    order = np.argsort(index.slots(words), kind="stable")
    ids = group["keep_id"]
    return pd.DataFrame({
        "shard": [_key[0]], "hash": [index.to_bytes()], "digests": [words[order].tobytes()],
        "unknown": [ids.isna().to_numpy(bool)[order].tobytes()],
        "ids": [ids.fillna(0).to_numpy(np.int64)[order].tobytes()],
        "rows": [group["keep_row"].to_numpy(np.int64)[order].tobytes()], "counts": [group["n"].to_numpy(np.int64)[order].tobytes()],
    })


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("shard")


def build_index(history: DataFrame, shard_digests: int = SHARD_DIGESTS) -> tuple[DataFrame, int]:
    """The stored index over ``distinct_digests`` rows, one row per shard, and its number of shards."""
    history = materialize(history, "history")
    n = max(1, -(-history.count() // shard_digests))
    index = history.withColumn("shard", _shard(n)).groupBy("shard").applyInPandas(
        _build, "shard int, hash binary, digests binary, unknown binary, ids binary, rows binary, counts binary")
    return materialize(index, "perfect-hash"), n


def _merge(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    """Every digest of a shard and its batch with the row that stays and the size of the group."""
    new = batch.reset_index(drop=True)
    new["seen"] = False
    if not len(index):
        return new[["digest", "keep_id", "keep_row", "n", "seen"]]
    shard = index.iloc[0]
    slots = np.frombuffer(shard["digests"], U).reshape(-1, 4)
    raw = shard["digests"]
    old = pd.DataFrame({
        "digest": [raw[i : i + 32] for i in range(0, len(raw), 32)],
        "keep_id": pd.array(np.frombuffer(shard["ids"], np.int64), dtype="Int64"),
        "keep_row": np.frombuffer(shard["rows"], np.int64).copy(), "n": np.frombuffer(shard["counts"], np.int64).copy(), "seen": True,
    })
    old.loc[np.frombuffer(shard["unknown"], bool), "keep_id"] = pd.NA
    if not len(new):
        return old
    words = _matrix(new["digest"])
    at = PerfectHash.from_bytes(shard["hash"]).slots(words)
    member = (at >= 0) & (slots[np.maximum(at, 0)] == words).all(axis=1)
    where = at[member]
    old.loc[where, "n"] = old["n"].to_numpy()[where] + new["n"].to_numpy()[member]
    found = new[member]
    mine, theirs = found["keep_id"].astype("Int64").array, old["keep_id"].array[where]
    earlier = (mine.fillna(2**63 - 1) < theirs.fillna(2**63 - 1)).to_numpy(bool) | (mine.isna() & theirs.isna() & (found["keep_row"].to_numpy() < old["keep_row"].to_numpy()[where]))
    # Equal ids: the rows can only be told apart by their number.
    same = ((mine == theirs).fillna(False)).to_numpy(bool) & (found["keep_row"].to_numpy() < old["keep_row"].to_numpy()[where])
    take = earlier | same
    ids = old["keep_id"].array.copy()
    ids[where[take]] = mine[take]
    rows = old["keep_row"].to_numpy().copy()
    rows[where[take]] = found["keep_row"].to_numpy()[take]
    old["keep_id"], old["keep_row"] = ids, rows
    return pd.concat([old, new.loc[~member, old.columns]], ignore_index=True)


def look_up(index: DataFrame, n_shards: int, batch: DataFrame) -> DataFrame:
    """Join a batch's ``distinct_digests`` with the index: (digest, keep_id, keep_row, n, seen) of all digests of both."""
    batch = batch.withColumn("shard", _shard(n_shards))
    return index.groupBy("shard").cogroup(batch.groupBy("shard")).applyInPandas(
        _merge, "digest binary, keep_id long, keep_row long, n long, seen boolean")


def dedup(docs: DataFrame, history_share: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the row of equal text that stays.

    The rows with the smaller ids (about ``history_share`` of them) are the history, the rest a new
    batch; the result is the same for any share. Null text is empty. Null ids come last. Of rows
    with equal id and text exactly one stays. An empty table gives an empty result; extra columns are not read.
    """
    rows = digest_rows(docs, id_col, text_col)
    cut = rows.approxQuantile("doc_id", [history_share], 0.05)
    limit = int(cut[0]) if cut else 0
    past = F.col("doc_id") <= limit
    index, n = build_index(distinct_digests(rows.where(past)))
    found = materialize(look_up(index, n, distinct_digests(rows.where(~past | F.col("doc_id").isNull()))), "winners")
    # A digest of very many rows is split by the skew handling of the join.
    return rows.join(found, "digest").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("seen").alias("in_history"), "row_no",
    )


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    def key(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("null"))

    kept = dedup(docs, id_col=id_col, text_col=text_col).where("kept").select(
        key(F.col("doc_id")).alias("__id"), F.unhex("text_sha256").alias("__digest"))
    marked = docs.withColumn("__id", key(F.col(id_col))).withColumn("__digest", F.unhex(F.sha2(normalised(text_col).cast("binary"), 256)))
    # Rows with equal id and equal text: one of them. The window uses the partitioning of the join.
    one = Window.partitionBy("__id", "__digest").orderBy(F.lit(1))
    both = marked.join(kept, ["__id", "__digest"], "left_semi").withColumn("__no", F.row_number().over(one))
    return both.where("__no = 1").select(*docs.columns)
