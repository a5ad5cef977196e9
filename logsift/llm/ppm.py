"""Scoring by prediction by partial matching (operator 9).

The model is a trie of byte contexts up to four bytes long with the counts of the bytes that follow, taken from all learning texts.
A byte that its context has not seen escapes to the next shorter context (escape estimate by the number of
distinct bytes seen), where the bytes of the longer one are excluded; the last resort is uniform. Texts are dealt to blocks.
A block asks for each of its distinct five-byte strings and words once, the counts are added up and the probabilities worked out per
piece of the trie, and the answers go back to the blocks: no task and no broadcast holds the whole model.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bytestext import KeyTable, U, add_up, groups, runs, utf8, word_hashes

ORDER = 4
BLOCK_BYTES = 24 << 20
# Bytes that UTF-8 never has: one before a text's start, one for its end. The end can be predicted, the start cannot.
_START, _END = b"\xff" * ORDER, b"\xfe"
_SYMBOLS = 255
_END_WORD = U(0x0E0DF0E0DF0E0DF1)
_GRAM, _WORD = 0, 1


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ORDER + 1 bytes that end at each byte of each text and at its end, and where each text's begin (end as last)."""
    buf = np.frombuffer(b"".join(_START + t + _END for t in texts), np.uint8)
    wide = np.zeros(len(buf) - ORDER, U)
    for i in range(ORDER + 1):
        wide = (wide << U(8)) | buf[i : len(buf) - ORDER + i].astype(U)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return wide[buf[ORDER:] != 0xFF], at


def _requests(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The distinct strings and words of a block with their counts in learning texts."""
    found = {_GRAM: ([], []), _WORD: ([], [])}
    learn = rows["learn"].to_numpy(bool)
    for side in (True, False):
        texts = utf8(rows["text"][learn == side].tolist())
        for part in groups(texts):
            words = np.append(word_hashes(part)[0], np.full(len(part), _END_WORD))
            for kind, values in ((_GRAM, grams(part)[0]), (_WORD, words)):
                values = np.sort(values)
                limits = runs(values)
                found[kind][0].append(values[limits[:-1]])
                found[kind][1].append(np.diff(limits) * int(side))
    out = []
    for kind, (keys, counts) in found.items():
        keys, counts = add_up(np.concatenate(keys), np.concatenate(counts))
        out.append(pd.DataFrame({"block": key[0], "kind": kind, "key": keys.view(np.int64), "n": counts}))
    return pd.concat(out)


def probabilities(keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each string's last byte after the others.

    ``keys`` has every string whose context ends in the same two bytes as one of them; ``low`` are the counts of
    all pairs (65,536) and of all bytes (256).
    """
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    gone, gone_kinds = np.zeros(len(keys)), np.zeros(len(keys))
    for order in range(ORDER, -1, -1):
        mask = U((1 << 8 * (order + 1)) - 1)
        if order >= 2:
            seen, n = add_up(keys & mask, counts)
            seen, n = seen[n > 0], n[n > 0]
        else:
            table = low[0] if order == 1 else low[1]
            seen = np.flatnonzero(table).astype(U)
            n = table[table > 0]
        if not len(seen):
            continue
        limits = runs(seen >> U(8))
        contexts, total, kinds = (seen >> U(8))[limits[:-1]], np.add.reduceat(n, limits[:-1]), np.diff(limits)
        own = (keys & mask) >> U(8)
        at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
        known = contexts[at] == own
        t, d = np.where(known, total[at], 0) - gone, np.where(known, kinds[at], 0) - gone_kinds
        where = np.minimum(np.searchsorted(seen, keys & mask), len(seen) - 1)
        mine = np.where(seen[where] == (keys & mask), n[where], 0)
        # An order that adds no byte to those already excluded says nothing.
        tells = open_ & known & (t > 0)
        hit = tells & (mine > 0)
        out[hit] += np.log10(mine[hit] / (t[hit] + d[hit]))
        miss = tells & (mine == 0)
        out[miss] += np.log10(d[miss] / (t[miss] + d[miss]))
        open_ &= ~hit
        if order:
            # What the next order loses: its counts of the bytes seen here.
            shorter = U((1 << 8 * order) - 1)
            if order - 1 >= 2:
                less, less_n = add_up(keys & shorter, counts)
                below = less_n[np.searchsorted(less, seen & shorter)]
            else:
                below = (low[0] if order - 1 == 1 else low[1])[(seen & shorter).astype(np.int64)]
            lost = np.add.reduceat(below, limits[:-1])
            gone = np.where(known, lost[at], gone if order < ORDER else 0)
            gone_kinds = np.where(known, kinds[at], gone_kinds)
        else:
            gone_kinds = np.full(len(keys), float(len(seen)))
    rest = _SYMBOLS - gone_kinds
    out[open_] += np.log10(1.0 / np.maximum(rest[open_], 1))
    return out


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row; learning texts are those where ``learn`` holds.

    Null text is empty: only its end is scored. A null condition counts as not learning. Without learning texts the model is
    uniform and the base score 0 tokens' worth of smoothing. Repeated rows count and are scored as often as they occur. An empty
    table gives an empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int"))
    asked = materialize(dealt.select("block", "text", "learn").groupBy("block").applyInPandas(_requests, "block int, kind int, key long, n long"), "requests")
    totals = materialize(asked.groupBy("kind", "key").agg(F.sum("n").alias("n")), "totals")
    tokens, kinds = totals.where(f"kind = {_WORD}").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    pairs = totals.where(f"kind = {_GRAM} and n > 0").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n"))
    two = np.zeros(1 << 16)
    for r in pairs.collect():  # at most 65,536 rows
        two[r["pair"]] = r["n"]
    low = (two, two.reshape(256, 256).sum(axis=0))
    shared = spark.sparkContext.broadcast(low)

    def work_out(piece: pd.DataFrame) -> pd.DataFrame:
        keys = piece["key"].to_numpy(np.int64).view(U)
        order = np.argsort(keys)
        return pd.DataFrame({"kind": _GRAM, "key": keys[order].view(np.int64), "value": probabilities(keys[order], piece["n"].to_numpy(np.float64)[order], shared.value)})

    # Contexts that end in the same two bytes are worked out together.
    n_pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(n_pieces))
    scored = totals.where(f"kind = {_GRAM}").withColumn("piece", piece).groupBy("piece").applyInPandas(lambda p: work_out(p), "kind int, key long, value double")
    values = scored.unionByName(totals.where(f"kind = {_WORD}").select("kind", "key", F.col("n").cast("double").alias("value")))
    answers = asked.select("block", "kind", "key").join(values, ["kind", "key"]).select(F.col("block").alias("to"), "kind", "key", "value")

    def finish(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        kind, keys, value = known["kind"].to_numpy(), known["key"].to_numpy(np.int64).view(U), known["value"].to_numpy()
        table = {k: (KeyTable(keys[kind == k]), value[kind == k]) for k in (_GRAM, _WORD)}
        out = []
        smooth = np.log10(tokens + 0.1 * (kinds + 1)) if kinds or tokens else np.log10(0.1)
        for part in groups(utf8(rows["text"].tolist())):
            g, at = grams(part)
            logs = table[_GRAM][1][table[_GRAM][0].find(g)]
            w, words = word_hashes(part)
            counts = np.append(table[_WORD][1][table[_WORD][0].find(np.append(w, _END_WORD))], 0.0)
            end, counts = counts[-2], counts[:-2]
            base = np.concatenate([[0], np.cumsum(np.log10(counts + 0.1))])
            seen = np.concatenate([[0], np.cumsum(counts > 0)])
            n = np.diff(words) + 1
            out.append(pd.DataFrame({
                "n_tokens": n, "n_known": seen[words[1:]] - seen[words[:-1]] + int(end > 0), "train_tokens": tokens,
                "base_score": base[words[1:]] - base[words[:-1]] + np.log10(end + 0.1) - n * smooth, "score": np.add.reduceat(logs, at[:-1])}))
        both = pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["n_tokens", "n_known", "train_tokens", "base_score", "score"])
        both.insert(0, "doc_id", rows["doc_id"].reset_index(drop=True))
        return both

    return dealt.select("block", "doc_id", "text").groupBy("block").cogroup(answers.groupBy("to")).applyInPandas(
        lambda r, k: finish(r, k), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
