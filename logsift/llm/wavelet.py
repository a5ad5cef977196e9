"""Token ids in wavelet-matrix shards (operator 2).

A shard is one binary value that holds some million ids of consecutive documents: the sorted ids in use, one bit
plane per bit of an id's index among them, for every plane the number of ones before each 512 bits, and, compressed apart, the documents' ids and
lengths. Planes and counts lie in the value as they are used: a shard is opened without unpacking or counting anything, and any position, any count of an
id before a position and the place of its n-th occurrence are found from a few words of each plane. Shards are rows of a Parquet table, so that
any file system serves and a task that runs twice leaves one result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tokens import encode_all

SHARD_TOKENS = 1 << 20
_BLOCK = 512
_MAGIC = b"WAVELET2"
SHARD_SCHEMA = "part int, shard int, first long, n_tokens long, n_docs long, data binary"


def _index_type(used: int) -> type:
    """What holds the indexes of that many ids."""
    return np.uint16 if used <= 1 << 16 else np.uint32


class WaveletShard:
    """The ids of consecutive documents as bit planes with rank and select."""

    def __init__(self, alphabet: np.ndarray, n: int, words: list[np.ndarray], blocks: list[np.ndarray], documents: bytes):
        self.alphabet, self.n, self.words, self.blocks, self._documents = alphabet, n, words, blocks, documents
        self.zeros = [n - int(b[-1]) for b in blocks]

    @cached_property
    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the documents, whether they are known, and numbers of tokens; unpacked when first asked for."""
        raw = zstandard.ZstdDecompressor().decompress(self._documents)
        docs = int(np.frombuffer(raw, "<i8", 1)[0])
        known = np.unpackbits(np.frombuffer(raw, np.uint8, -(-docs // 8), 8 + 16 * docs), count=docs).astype(bool)
        return np.frombuffer(raw, "<i8", docs, 8), known, np.frombuffer(raw, "<i8", docs, 8 + 8 * docs)

    @property
    def doc_ids(self) -> np.ndarray:
        return self._table[0]

    @property
    def known(self) -> np.ndarray:
        return self._table[1]

    @property
    def lengths(self) -> np.ndarray:
        return self._table[2]

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> WaveletShard:
        used = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
        used[ids] = True
        alphabet = np.flatnonzero(used).astype("<u4")
        code = np.zeros(len(used), np.uint32)
        code[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
        # Two bytes hold an index in any shard of a usual vocabulary, and places are faster to take from than masks.
        now, words, blocks = code[ids].astype(_index_type(len(alphabet))), [], []
        size = -(-len(ids) // _BLOCK) * (_BLOCK // 8)
        for bit in range(max(1, int(len(alphabet) - 1).bit_length()) - 1, -1, -1):
            one = (now >> now.dtype.type(bit) & now.dtype.type(1)).astype(bool)
            plane = np.packbits(one, bitorder="little").tobytes()
            words.append(np.frombuffer(plane + bytes(size - len(plane)), "<u8"))
            ones = np.bitwise_count(words[-1]).reshape(-1, _BLOCK // 64).sum(axis=1, dtype=np.int64)
            blocks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))
            now = np.concatenate([now[np.flatnonzero(~one)], now[np.flatnonzero(one)]])
        table = np.array([len(lengths)], "<i8").tobytes() + doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + np.packbits(known).tobytes()
        return cls(alphabet, len(ids), words, blocks, zstandard.ZstdCompressor(level=1).compress(table))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, len(self.alphabet), len(self.words), len(self._documents)], "<i8").tobytes()
        planes = [part.tobytes() for pair in zip(self.words, self.blocks) for part in pair]
        return b"".join([_MAGIC, head, *planes, self.alphabet.astype("<u4").tobytes(), self._documents])

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        """Open a stored shard; its planes and counts stay where they are."""
        if data[:8] != _MAGIC:
            raise ValueError("not a wavelet shard")
        n, used, depth, size = np.frombuffer(data, "<i8", 4, 8).tolist()
        n_blocks = -(-n // _BLOCK)
        at, words, blocks = 40, [], []
        for _ in range(depth):
            words.append(np.frombuffer(data, "<u8", n_blocks * (_BLOCK // 64), at))
            at += n_blocks * (_BLOCK // 8)
            blocks.append(np.frombuffer(data, "<u4", n_blocks + 1, at))
            at += 4 * (n_blocks + 1)
        alphabet = np.frombuffer(data, "<u4", used, at)
        at += 4 * used
        return cls(alphabet, n, words, blocks, data[at : at + size])

    def _bit(self, level: int, i: int) -> int:
        return int(self.words[level][i >> 6]) >> (i & 63) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        word, total = i >> 6, int(self.blocks[level][i // _BLOCK])
        for w in self.words[level][i // _BLOCK * (_BLOCK // 64) : word]:
            total += int(w).bit_count()
        return total + (int(self.words[level][word]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else total

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a value in a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level in range(len(self.words)):
            bit, ones = self._bit(level, i), self._ones(level, i)
            code = code * 2 + bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[code])

    def _code(self, token: int) -> int:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def rank(self, token: int, i: int) -> int:
        """How often an id occurs among the first ``i``."""
        code = self._code(token)
        if code < 0:
            return 0
        low, high = 0, min(i, self.n)
        for level in range(len(self.words)):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if code >> (len(self.words) - 1 - level) & 1 else (low - a, high - b)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id, -1 if there are not so many."""
        code = self._code(token)
        if code < 0 or not 0 <= k < self.count(token):
            return -1
        low, path = 0, []
        for level in range(len(self.words)):
            bit, ones = code >> (len(self.words) - 1 - level) & 1, self._ones(level, low)
            path.append(bit)
            low = self.zeros[level] + ones if bit else low - ones
        at = low + k
        for level in range(len(self.words) - 1, -1, -1):
            at = self._select(level, path[level], at - self.zeros[level] if path[level] else at)
        return at

    def all_ids(self) -> np.ndarray:
        """Every id, from the lowest plane upwards."""
        code = np.zeros(self.n, _index_type(len(self.alphabet)))
        for depth, words in enumerate(reversed(self.words)):
            one = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").view(bool)
            ones, before = np.flatnonzero(one), np.empty_like(code)
            zeros = self.n - len(ones)
            before[np.flatnonzero(~one)], before[ones] = code[:zeros], code[zeros:] | code.dtype.type(1 << depth)
            code = before
        return self.alphabet[code] if self.n else np.zeros(0, "<u4")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text",
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode every text, end it with ``end_id`` and write shards in ascending order of the ids of documents.

    Null ids come first, equal ids in the order of their texts' hashes; null text is empty. A
    shard ends with the document that fills it, so a very long document makes a shard of its own length.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, end = TaskContext.get().partitionId(), np.array([end_id], np.uint32)
        ids: list[np.ndarray] = []
        docs_: list[int | None] = []
        first = size = shard = 0

        def close() -> pd.DataFrame:
            nonlocal ids, docs_, first, size, shard
            lengths = np.array([len(x) for x in ids], np.int64)
            numbers = np.array([d or 0 for d in docs_], np.int64)
            data = WaveletShard.build(np.concatenate(ids), numbers, np.array([d is not None for d in docs_]), lengths).to_bytes()
            row = pd.DataFrame({"part": [part], "shard": [shard], "first": [first], "n_tokens": [size], "n_docs": [len(ids)], "data": [data]})
            first, size, shard, ids, docs_ = first + size, 0, shard + 1, [], []
            return row

        for batch in batches:
            numbers = [None if n else int(v) for v, n in zip(batch["doc_id"].fillna(0).astype("int64").tolist(), batch["doc_id"].isna().tolist())]
            for number, tokens in zip(numbers, encode_all(tokenizer, batch["text"].tolist())):
                ids.append(np.concatenate([tokens, end]))
                docs_.append(number)
                size += len(tokens) + 1
                if size >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    tie = F.xxhash64("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), tie).sortWithinPartitions(F.asc_nulls_first("doc_id"), tie)
    ordered.mapInPandas(build, SHARD_SCHEMA).write.parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def read_documents(shards: DataFrame) -> DataFrame:
    """Decode shards: one row per document (doc_id, start, n_tokens, ids_crc32).

    ``start`` needs the number of ids in the parts before; there are as many parts as the writing job had tasks.
    """
    parts = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = dict(zip([p for p, _ in parts], np.cumsum([0, *(n for _, n in parts)]).tolist()))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, first, data in zip(batch["part"], batch["first"], batch["data"]):
                shard = WaveletShard.from_bytes(data)
                ids = shard.all_ids().astype("<u4")
                limits = shard.starts.tolist()
                yield pd.DataFrame({
                    "doc_id": pd.array(shard.doc_ids, dtype="Int64").copy() if shard.known.all() else pd.Series(shard.doc_ids, dtype="Int64").where(shard.known),
                    "start": before[part] + first + shard.starts[:-1], "n_tokens": shard.lengths,
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(limits, limits[1:])],
                })

    return shards.select("part", "first", "data").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_path(spark: SparkSession) -> str:
    return scratch_path(spark, "wavelet")
