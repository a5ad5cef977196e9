"""Near duplicates by HyperMinHash (operator 1).

One hash per shingle: its first bits choose a bucket, and a bucket keeps the leading-zero count and ten
further bits of its smallest remaining value. Empty buckets borrow from others by a fixed sequence. Bands of registers
are compared by hash; what meets is filtered by sizes and by the similarity estimated from the registers, corrected for
chance collisions, and then confirmed on the full shingle sets. Texts with the same set are one node from the start.
In a bucket that several nodes share, the first one is compared with all others. What is still in several components after
that is compared by differences: every node of an open bucket has the shingles in which it differs from one node of the bucket's
largest component, its centre. A link between a node that is not linked to the centre and any other node needs a known number of common differences,
so nodes are joined by the rarest of their differences, and the sizes of what they share are exact. A large group of copies costs its size
and not its square, next to texts that almost belong to it too, and no pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .bytestext import U, distinct_sorted, groups, lean, mix, utf8, word_hashes
from .components import components
from .filters import may_contain

REGISTERS = 256
BAND = 6  # registers per band; 42 bands find a pair at similarity 0.8 but for 3 in a million
BANDS = REGISTERS // BAND
_ATTEMPTS = 64
_MANTISSA = 10
_BORROW = np.random.default_rng(20240607).integers(0, REGISTERS, (REGISTERS, _ATTEMPTS))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; with fewer words, of the whole sequence."""
    hashes, at = word_hashes(texts)
    if not len(hashes):
        return [np.zeros(0, U)] * len(texts)

    def combine(first: int, number: int) -> np.ndarray:
        out = np.zeros(max(0, len(hashes) - number + 1), U)
        for i in range(number):
            out = out * U(0x9E3779B97F4A7C15) + hashes[i : i + len(out)]
        return mix(out + U(number))

    full, out = combine(0, words), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            out.append(distinct_sorted(full[a : b - words + 1]))
        elif b > a:
            whole = U(0)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    whole = whole * U(0x9E3779B97F4A7C15) + h
                out.append(mix(np.array([whole + U(b - a)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def signature_rows(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16) of every set; rows of empty sets have no meaning."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    filled = np.zeros((len(sets), REGISTERS), bool)
    for i, values in enumerate(sets):
        if len(values):
            bucket = (values >> U(56)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))  # sorted: a bucket's first is its smallest
            part, size = np.frexp((values[first] & U((1 << 56) - 1)).astype(np.float64))
            bits = np.clip((part * (2 << _MANTISSA)).astype(np.int64) - (1 << _MANTISSA), 0, (1 << _MANTISSA) - 1)
            out[i, bucket[first]] = ((56 - size) << _MANTISSA) | bits
            filled[i, bucket[first]] = True
    has = filled.any(axis=1)
    row, column = np.nonzero(~filled & has[:, None])
    source = np.full(len(row), -1)
    for attempt in range(_ATTEMPTS):
        left = np.flatnonzero(source < 0)
        if not len(left):
            break
        tried = _BORROW[column[left], attempt]
        good = filled[row[left], tried]
        source[left[good]] = tried[good]
    for i in np.flatnonzero(source < 0):  # very few filled buckets: the next one, going round
        have = np.flatnonzero(filled[row[i]])
        source[i] = have[np.searchsorted(have, column[i]) % len(have)]
    out[row, column] = out[row, source]
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One hash per band."""
    parts = signatures[:, : BANDS * BAND].reshape(len(signatures), BANDS, BAND).astype(U)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * U(0xD6E8FEB86659FD93), parts.shape[:2]).copy()
    for i in range(BAND):
        out = mix(out + parts[:, :, i])
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two signature matrices: matching registers, less those that match by chance."""
    zeros = 2.0 ** -np.arange(0, 48)

    def chance(n: np.ndarray) -> np.ndarray:
        rate = (n / REGISTERS)[:, None]
        return np.exp(-rate * zeros / 2) - np.exp(-rate * zeros)

    c = (chance(n_a) * chance(n_b)).sum(axis=1) / (1 << _MANTISSA)
    return ((a == b).mean(axis=1) - c) / (1 - c)


def sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Stored (doc_id, text_hash, n_shingles, s1, s2, signature): ``s1``, ``s2`` are a 128-bit digest of the set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, digest, signature = [], [], []
            for part in groups(utf8(batch["text"].tolist())):
                sets = shingle_sets(part, words)
                rows = signature_rows(sets)
                n += [len(s) for s in sets]
                digest += [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                signature += [rows[i].tobytes() if len(s) else None for i, s in enumerate(sets)]
            halves = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "n_shingles": np.array(n, np.int64), "s1": halves[:, 0], "s2": halves[:, 1], "signature": signature})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return materialize(rows.mapInPandas(lean(run), "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, signature binary"), "sketches")


def _bucket_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = band_keys(np.frombuffer(b"".join(batch["signature"]), np.uint16).reshape(-1, REGISTERS))
        yield pd.DataFrame({"bucket": keys.ravel().view(np.int64), "node": np.repeat(batch["node"].to_numpy(), BANDS)})


def _shared_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by bucket, those of buckets with more than one row; only the last row is kept between batches."""
    last: pd.DataFrame | None = None
    told = False  # the kept row has been passed on
    for batch in batches:
        rows = batch if last is None else pd.concat([last, batch], ignore_index=True)
        if not len(rows):
            continue
        bucket = rows["bucket"].to_numpy()
        same = np.zeros(len(rows) + 1, bool)
        same[1:-1] = bucket[1:] == bucket[:-1]
        keep = same[1:] | same[:-1]
        if last is not None and told:
            keep[0] = False
        told = bool(keep[-1]) or (len(rows) == 1 and told)
        yield rows[keep]
        last = rows.iloc[-1:]


def _node_sets(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Stored (rep, s1, s2, shingles) of the texts whose ids may be those of the nodes' first texts, each set of an id once.

    A filter spares the other texts, which are read where they lie and not shuffled; what passes by chance, and other texts
    under the same id, find no partner later.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = []
            for part in groups(utf8(batch["text"].tolist())):
                data += [s.tobytes() for s in shingle_sets(part, words)]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(d) for d in data), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"rep": batch["rep"], "s1": digest[:, 0], "s2": digest[:, 1], "shingles": data})

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    rows = rows.where(may_contain(nodes, "rep", F.col("rep"))).mapInPandas(lean(run), "rep long, s1 long, s2 long, shingles binary")
    return materialize(rows.dropDuplicates(["rep", "s1", "s2"]), "shingles")


def _confirm(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["shingles_a"], batch["shingles_b"]):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return run


def _estimated(percent: int, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy(np.float64), batch["n_b"].to_numpy(np.float64)
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, REGISTERS) for c in ("signature_a", "signature_b"))
            limit = percent / 100
            # Five standard deviations of the estimate below the limit; few shingles tell little.
            slack = 5 * np.sqrt(limit * (1 - limit) / np.minimum(REGISTERS, np.maximum(n_a, n_b)))
            yield batch.loc[estimate(x, y, n_a, n_b) >= limit - slack, columns]

    return run


def _open(state: DataFrame) -> DataFrame:
    """Of buckets that still hold several components: their largest component (of equal ones, the highest)."""
    per = state.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    held = per.groupBy("bucket").agg(F.count("*").alias("kinds"), F.max(F.struct("size", "component")).alias("largest"))
    return held.where("kinds > 1").select("bucket", F.col("largest.component").alias("largest"))


def _side(table: DataFrame, end: str, *columns: str) -> DataFrame:
    """Columns of the nodes, named for one end of a pair."""
    return table.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])


def _incidences(state: DataFrame) -> DataFrame:
    """(centre, node, component, largest) of the nodes in open buckets: the centre stands for the bucket's largest component.

    It is the node of its component whose buckets hold the most nodes, so that it differs little from many.
    """
    sizes = state.groupBy("bucket").agg(F.count("*").alias("size"))
    weights = state.join(sizes, "bucket").groupBy("component", "node").agg(F.sum("size").alias("weight"))
    centres = weights.groupBy(F.col("component").alias("largest")).agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("centre"))
    met = state.join(_open(state), "bucket").select("largest", "node", "component").distinct()
    return met.join(centres, "largest").where("node <> centre").select("centre", "node", "component", "largest")


def _differences(percent: int):
    """``added`` and ``lacked`` shingles against the centre's; ``excess`` is above zero if the two are not linked, and ``low`` the power of two below it.

    With p = ``percent``, sets x and y with d unlike shingles are linked if (100 + p) d <= (100 - p) (|x| + |y|).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            added, lacked, excess = [], [], []
            for x, c in zip(batch["shingles"], batch["of"]):
                x, c = np.frombuffer(x, U), np.frombuffer(c, U)
                added.append(np.setdiff1d(x, c, assume_unique=True).view(np.int64))
                lacked.append(np.setdiff1d(c, x, assume_unique=True).view(np.int64))
                excess.append((100 + percent) * (len(added[-1]) + len(lacked[-1])) - (100 - percent) * (len(x) + len(c)))
            low = [1 << e.bit_length() - 1 if e > 0 else 0 for e in excess]
            yield batch[["centre", "node", "component", "largest"]].assign(
                n=batch["shingles"].str.len() // 8, n_added=[len(x) for x in added], n_lacked=[len(x) for x in lacked], excess=excess, low=low, added=added, lacked=lacked)

    return run


def _needed(percent: int) -> str:
    """The number of common differences of a node and one of at least excess ``low``, if they are linked, times 2 (100 + percent)."""
    return f"low + {2 * percent} * n_added + 200 * n_lacked"


def _rarest(percent: int):
    """Differences of which a link needs at least one: of ``n`` that others have too, all but the ``needed`` - 1 most frequent.

    They are taken of the added ones, of the lacked ones, or of both together, whichever others have most rarely.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                needed = -(-row.needed // (2 * (100 + percent)))
                met = sorted((m["others"], m["e"], m["lacked"]) for m in row.met)
                parts = [[m for m in met if m[2] == side] for side in (False, True)]
                ways = [(part, needed - len(other)) for part, other in zip(parts, parts[::-1])] + [(met, needed)]
                taken = min((part[: max(0, len(part) - least + 1)] for part, least in ways if least > 0), key=lambda part: sum(m[0] for m in part))
                out += [(row.centre, row.low, m[1], row.node, row.component, row.n) for m in taken]
            yield pd.DataFrame(out, columns=["centre", "low", "e", "node", "component", "n"])

    return run


def _judge(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            common = [sum(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(both[:2], both[2:]))
                      for both in zip(batch["added"], batch["lacked"], batch["added_p"], batch["lacked_p"])]
            yield batch.loc[2 * (100 + percent) * np.array(common, np.int64) >= batch["needed"].to_numpy(), ["a", "b"]]

    return run


def _candidates(deltas: DataFrame, percent: int) -> DataFrame:
    """(centre, probe, node): pairs of different components that can be linked though ``probe`` is not linked to the centre."""
    probes = deltas.where("component <> largest and excess > 0").select(
        "centre", "low", F.explode(F.concat("added", "lacked")).alias("e"), "component", F.col("node").alias("probe"), F.col("n").alias("n_probe"))
    key = ["centre", "low", "e"]
    own = materialize(probes.groupBy(*key, "component").agg(F.count("*").alias("own")), "differences")
    every = own.groupBy(*key).agg(F.sum("own").alias("all"))
    node = ["centre", "node", "component", "n", "n_added", "n_lacked"]
    each = deltas.select(*node, F.posexplode(F.concat("added", "lacked")).alias("at", "e")).withColumn("lacked", F.col("at") >= F.col("n_added"))
    met = each.join(every, ["centre", "e"]).join(own, [*key, "component"], "left").withColumn("others", F.col("all") - F.coalesce("own", F.lit(0))).where("others > 0")
    rows = met.groupBy(*node, "low").agg(F.collect_list(F.struct("others", "e", "lacked")).alias("met")).withColumn("needed", F.expr(_needed(percent)))
    rows = rows.where(F.lit(2 * (100 + percent)) * F.size("met") >= F.col("needed")).select("centre", "low", "node", "component", "n", "needed", "met")
    rarest = rows.mapInPandas(_rarest(percent), "centre long, low long, e long, node long, component long, n long")
    # Components meet before their nodes do, so that nodes of one component are not paired.
    other = F.col("component").alias("other")
    meet = rarest.join(own.select(*key, other), key).where("component <> other")
    alike = 100 * F.least("n", "n_probe") >= percent * F.greatest("n", "n_probe")
    return meet.join(probes.select(*key, other, "probe", "n_probe"), [*key, "other"]).where(alike).select("centre", "probe", "node").distinct()


def _late_links(state: DataFrame, mine: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored links (a, b) between the components that still share buckets; pairs of one bucket are all judged or excluded."""
    digests = ["rep", "s1", "s2"]
    met = materialize(_incidences(state), "incidences")
    keys = mine.select("node", *digests)
    of = met.select("centre").distinct().join(keys.withColumnRenamed("node", "centre"), "centre").join(sets, digests).select("centre", F.col("shingles").alias("of"))
    pairs = met.join(keys, "node").join(sets, digests).join(of, "centre").select("centre", "node", "component", "largest", "shingles", "of")
    deltas = materialize(pairs.mapInPandas(_differences(percent), "centre long, node long, component long, largest long, n long, n_added long, n_lacked long, "
                                           "excess long, low long, added array<long>, lacked array<long>"), "deltas")
    to_centre = deltas.where("component <> largest and excess <= 0").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    one = deltas.select("centre", F.col("node").alias("probe"), F.col("excess").alias("low"), F.col("added").alias("added_p"), F.col("lacked").alias("lacked_p"))
    two = deltas.select("centre", "node", "n_added", "n_lacked", "added", "lacked")
    judged = _candidates(deltas, percent).join(one, ["centre", "probe"]).join(two, ["centre", "node"])
    judged = judged.select(F.col("probe").alias("a"), F.col("node").alias("b"), F.expr(_needed(percent)).alias("needed"), "added", "lacked", "added_p", "lacked_p")
    found = materialize(to_centre.unionByName(judged.mapInPandas(_judge(percent), "a long, b long")), "links")
    discard(met, deltas)
    return found


def _contracted(labels: DataFrame, found: DataFrame) -> DataFrame:
    """Stored labels after links joined components; only those are contracted, edges of earlier rounds are in the labels."""
    ends = found.join(labels.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    joined = materialize(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "joined")
    out = materialize(labels.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    discard(labels, joined)
    return out


def links(docs: DataFrame, nodes: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, to) of the nodes (node, rep, n, signature, s1, s2) that share a bucket: the smallest node reachable."""
    spark = docs.sparkSession
    buckets = nodes.select("node", "signature").mapInPandas(_bucket_rows, "bucket long, node long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = buckets.repartition(n, "bucket").sortWithinPartitions("bucket", "node").mapInPandas(_shared_buckets, "bucket long, node long")
    stored = materialize(shared, "buckets")
    members = stored.distinct()
    wanted = members.select("node").distinct()
    mine = materialize(nodes.join(wanted, "node", "left_semi"), "signatures")
    sets = _node_sets(docs, mine, words, id_col, text_col)
    labels = materialize(mine.select("node", F.col("node").alias("component")), "labels")
    state = materialize(members.join(mine.select("node", "n"), "node").select("bucket", "node", "n"), "members")
    discard(stored)
    # Every bucket's first node with the rest of that bucket: this joins most copies.
    first = state.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("c")).select("bucket", F.col("c.node").alias("a"), F.col("c.n").alias("n_a"))
    alike = 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
    pairs = state.join(first, "bucket").where((F.col("node") != F.col("a")) & alike).select("a", F.col("node").alias("b")).distinct()
    columns = ("n", "signature", "rep", "s1", "s2")
    digests = [f"{c}_{end}" for end in "ab" for c in ("rep", "s1", "s2")]
    near = pairs.join(_side(mine, "a", *columns), "a").join(_side(mine, "b", *columns), "b").mapInPandas(
        _estimated(percent, ["a", "b", *digests]), ", ".join(f"{c} long" for c in ["a", "b", *digests]))
    near = materialize(near, "near")
    full = near
    for end in "ba":
        full = full.join(sets.select(*[F.col(c).alias(f"{c}_{end}") for c in sets.columns]), [f"{c}_{end}" for c in ("rep", "s1", "s2")])
    found = materialize(full.select("a", "b", "shingles_a", "shingles_b").mapInPandas(_confirm(percent), "a long, b long"), "links")
    if not found.isEmpty():
        labels = _contracted(labels, found)
    now = materialize(state.join(labels, "node").select("bucket", "node", "component"), "members")
    discard(state, near, found)
    # Buckets that one component fills have nothing left to compare.
    state = materialize(now.join(_open(now).select("bucket"), "bucket", "left_semi"), "members")
    discard(now)
    if not state.isEmpty():
        found = _late_links(state, mine, sets, percent)
        if not found.isEmpty():
            labels = _contracted(labels, found)
        discard(found)
    discard(state, mine, sets)
    return labels.withColumnRenamed("component", "to")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash, stays) per row.

    Documents are linked if their sets of ``words``-word shingles (A-Z lower-cased) have a Jaccard similarity of at
    least ``percent`` hundredths. Null texts and texts without words have no shingles and no links; rows with a null
    id are linked with nothing and kept. Sets are the nodes, so rows with one id and several texts are judged each by its own text. ``kept`` compares
    ids; ``stays`` holds for one (doc_id, xxhash64 of the text) of each group of linked rows, the smallest, and for all rows without links.
    Repeated rows agree. An empty table gives an empty result; other columns are not read.
    """
    rows = sketches(docs, words, id_col, text_col)
    shingled = rows.where("doc_id is not null and n_shingles > 0")
    sets = shingled.groupBy("s1", "s2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature"))
    nodes = materialize(sets.select(F.monotonically_increasing_id().alias("node"), "first", F.col("first.doc_id").alias("rep"), "s1", "s2", "n", "signature"), "nodes")
    found = links(docs, nodes.drop("first"), words, percent, id_col, text_col)
    classed = nodes.select("s1", "s2", "node", "first").join(found, "node", "left").withColumn("class", F.coalesce("to", "node"))
    least = classed.groupBy("class").agg(F.min("first").alias("least"))
    of = materialize(classed.join(least, "class").select("s1", "s2", "least"), "classes")
    # Copies of one set in very large numbers are split by the skew handling of the join.
    linked = shingled.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(of, ["s1", "s2"])
    linked = linked.select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), "text_hash",
                           (F.struct("doc_id", "text_hash") == F.col("least")).alias("stays"))
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("stays"))
    out = linked.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "stays")
