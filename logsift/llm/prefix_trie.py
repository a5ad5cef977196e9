"""Prefix trie of rebuilt conversations by whole-sequence collapse (operator 13).

A turn is a SHA-256 digest; a prefix is the sum (twice 64 bits) of its turns' digests hashed with their places. Identical
rebuilt conversations collapse into one weighted sequence with its list of ends, represented by its smallest conversation.
Sequences that are proper prefixes of others go by an anti join, which leaves the leaves. Only the prefixes of the
sequences are then aggregated, with their weights. A node belongs to the smallest conversation that runs through it,
and the nodes that a conversation owns are the lower end of its path; so sums over subtrees are sums over the
sequences that run through a node, and cost one row per turn however deep the trie is.

Ranks and running sums come from ranges of the sorted turns: a conversation that fills many ranges is summed up in
each and carried over by one row per range. A list of ends is joined in pieces of bounded size before its hash is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Ids per piece of an end list.
PIECE = 4096
_NODE = ["depth", "p1", "p2"]
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_LOW = (1 << 32) - 1


def wrapping_add(a: Column, b: Column) -> Column:
    """Sum of two longs modulo 2**64."""
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _range_sums(key: str, values: Sequence[str]):
    """Sums of the rows before, modulo 2**64, per key of a sorted range; only the last key's sums pass on between batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last, held = None, np.zeros(len(values), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            start = np.flatnonzero(first)
            of = np.cumsum(first) - 1
            if last is None or keys[0] != last:
                held[:] = 0
            out = batch.assign(part=np.int32(part))
            for i, name in enumerate(values):
                v = batch[name].to_numpy(np.int64)
                before = np.cumsum(v) - v
                before = before - before[start][of]
                before[of == 0] += held[i]
                out[f"before_{name}"] = before
                held[i : i + 1] = before[-1:] + v[-1:]
            last = keys[-1]
            yield out

    return run


def running_sums(rows: DataFrame, key: str, order: Sequence[str], values: Sequence[str], label: str) -> DataFrame:
    """Stored ``rows`` (of longs) with ``before_<value>``: the sum of the key's rows before, modulo 2**64."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    added = ", ".join(f"before_{v} long" for v in values)
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = materialize(ranged.mapInPandas(_range_sums(key, values), f"{fields}, part int, {added}"), label)
    # One row per range: only a range's last key goes on in the next, as that one's first.
    last = F.max(F.struct(key, *[F.struct(*[F.col(o).isNotNull(), o]) for o in order], *[f"before_{v}" for v in values], *values))
    ends = local.groupBy("part").agg(F.min(key).alias("first"), last.alias("last")).orderBy("part").collect()
    carried, open_key, sums = [], None, np.zeros(len(values), np.int64)
    with np.errstate(over="ignore"):
        for row in ends:
            if row["first"] != open_key:
                sums = np.zeros(len(values), np.int64)
            else:
                carried.append((row["part"], row["first"], *sums.tolist()))
            own = np.array([row["last"][f"before_{v}"] for v in values], np.int64) + np.array([row["last"][v] for v in values], np.int64)
            sums = sums + own if row["last"][key] == open_key else own
            open_key = row["last"][key]
    if not carried:
        return local.drop("part")
    names = [f"carried_{v}" for v in values]
    spark = rows.sparkSession
    small = spark.createDataFrame(carried, "part int, first long, " + ", ".join(f"{n} long" for n in names))
    joined = local.join(F.broadcast(small), (local["part"] == small["part"]) & (local[key] == small["first"]), "left")
    return joined.select(*rows.columns, *[
        F.when(F.col("first").isNull(), F.col(f"before_{v}")).otherwise(wrapping_add(F.col(f"before_{v}"), F.col(f"carried_{v}"))).alias(f"before_{v}")
        for v in values])


def digested_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, k1, k2, size, one): 120 bits of each turn's digest and the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return rows.select("conv_id", "turn", *[
        F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(name) for name, at in (("k1", 1), ("k2", 16))], "size", F.lit(1).cast("long").alias("one"))


def rebuilt(conversations: DataFrame, period: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, pos, k1, k2, size) of their rebuilt turns."""
    ranked = running_sums(digested_turns(conversations), "conv_id", ["turn", "k1", "k2"], ["one"], "ranked")
    ranked = ranked.select("conv_id", (F.col("before_one") + 1).alias("pos"), "k1", "k2", "size")
    counts = materialize(ranked.groupBy("conv_id").agg(F.count("*").alias("n")), "counts")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = F.col("conv_id") - F.col("conv_id") % period
    convs = counts.select("conv_id", base.alias("base"), head.alias("h")).join(
        counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = materialize(convs.select("conv_id", "base", "h", (F.col("h") - F.least("h", F.coalesce("n_base", F.lit(0)))).alias("moved")), "conversations")
    columns = ["k1", "k2", "size"]
    # At most heads - 1 turns of a base, for at most `period` conversations.
    first = ranked.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", *columns).join(convs, "base").where("pos <= h").select("conv_id", "pos", *columns)
    # A conversation with very many turns is split by the skew handling of the join.
    own = ranked.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("moved")).alias("pos"), *columns)
    return convs.select("conv_id"), first.unionByName(own)


def end_lists(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of (depth, p1, p2, conv_id): the hash of the ascending ids, joined by commas."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch[_NODE].to_numpy()
            new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, bool)
            starts = np.flatnonzero(new)
            place = np.arange(len(keys)) - starts[np.cumsum(new) - 1] if len(keys) else np.zeros(0, np.int64)
            cut = np.flatnonzero(place % PIECE == 0)
            ids = batch["conv_id"].to_numpy()
            yield batch.iloc[cut][_NODE].assign(first=ids[cut], ids=[",".join(map(str, ids[a:b].tolist())) for a, b in zip(cut, np.append(cut[1:], len(ids)))])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            done = []
            for *now, ids in batch[[*_NODE, "ids"]].itertuples(index=False, name=None):
                if now == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=[*_NODE, "ends_sha256"]).astype({c: "int64" for c in _NODE})
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*_NODE, "ends_sha256"])

    node = "depth long, p1 long, p2 long"
    joined = ends.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInPandas(pieces, f"{node}, first long, ids string")
    return joined.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInPandas(digests, f"{node}, ends_sha256 string")


def trie(conversations: DataFrame, period: int = 5, heads: int = 9) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, null first, those of one turn by the SHA-256 of role and text; repeated rows are turns of
    their own. Null roles and texts are empty. Conversation c is rebuilt from the first h turns of c - c % ``period`` and its own turns after
    its first h, where h = crc32 of the decimal id modulo ``heads``. Rows without conv_id belong to no conversation and are left out;
    an empty table has no root and gives an empty result; other columns are not read. Two prefixes are one node if 128 bits of their
    digests agree.
    """
    convs, turns = rebuilt(conversations, period, heads)
    hashed = turns.select("conv_id", "pos", "size", F.xxhash64("k1", "k2", "pos").alias("h1"), F.xxhash64("k2", "pos", "k1").alias("h2"))
    summed = running_sums(hashed, "conv_id", ["pos"], ["h1", "h2", "size"], "sums")
    prefixes = summed.select(
        "conv_id", F.col("pos").alias("depth"), *[wrapping_add(F.col(f"before_h{i}"), F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)],
        F.col("before_h1").alias("q1"), F.col("before_h2").alias("q2"), F.col("before_size").alias("before"), "size")
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2", (F.col("before") + F.col("size")).alias("total"))).alias("end"))
    zero = F.lit(0).cast("long")
    ends = materialize(convs.join(whole, "conv_id", "left").select(
        "conv_id", *[F.coalesce(f"end.{c}", zero).alias(c) for c in (*_NODE, "total")]), "ends")
    sequences = materialize(ends.groupBy(*_NODE).agg(
        F.count("*").alias("weight"), F.min("conv_id").alias("conv_id"), F.any_value("total").alias("total")), "sequences")

    # The path of every distinct sequence, once; the root has neither turn nor parent.
    paths = prefixes.join(sequences.select("conv_id"), "conv_id", "left_semi")
    roots = sequences.select("conv_id", *[zero.alias(c) for c in (*_NODE, "q1", "q2", "before", "size")])
    paths = materialize(paths.unionByName(roots), "paths")
    length = sequences.select("conv_id", F.col("depth").alias("length"))
    proper = paths.join(length, "conv_id").where("depth < length").select(*_NODE).distinct()
    leaves = sequences.join(proper, _NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owners = paths.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), F.any_value("before").alias("before"))
    owned = owners.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("top"))
    known = materialize(sequences.select("conv_id", "depth", "weight", "total").join(owned, "conv_id", "left").join(leaves, "conv_id", "left").select(
        "conv_id", "weight", "total", F.coalesce("top.depth", F.col("depth") + 1).alias("top"), F.coalesce("top.before", "total").alias("top_before"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "known")
    # A sequence that lies on a path of a smaller conversation owns nothing.
    # Bytes on the way down from a node, by weight, less those of the nodes that each sequence owns there.
    below = F.col("total") - F.col("before")
    mine = F.col("total") - F.greatest("before", "top_before")
    nodes = materialize(paths.join(known, "conv_id").groupBy(*_NODE).agg(
        F.min(F.struct("conv_id", "top")).alias("owner"), F.any_value("q1").alias("q1"), F.any_value("q2").alias("q2"),
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("weight") * below - mine).alias("saved_tokens")), "nodes")

    parent = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.where("depth > 0").select(*parent).groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    # Above the top of what it owns, a conversation's path is another's; below it, parent and child have one owner.
    tops = nodes.where("depth > 0 and depth = owner.top").select(F.struct(*_NODE).alias("node"), *parent)
    above = tops.join(nodes.select(*_NODE, F.col("owner.conv_id").alias("above")), _NODE).select("node.*", "above")
    single = sequences.where("weight = 1").select(*_NODE, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256).alias("ends_sha256"))
    several = ends.join(sequences.where("weight > 1").select(*_NODE), _NODE, "left_semi").select(*_NODE, "conv_id")
    hashes = single.unionByName(end_lists(several))
    out = nodes.join(children, _NODE, "left").join(above, _NODE, "left").join(hashes, _NODE, "left")
    return out.select(
        F.col("owner.conv_id").alias("conv_id"), "depth",
        F.when(F.col("depth") > 0, F.coalesce("above", "owner.conv_id")).alias("parent_conv_id"),
        "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"))
