"""Repeated passages by a logarithmic family of sparse suffix arrays (operator 8).

Suffixes are indexed at content-defined places: in every window of ``length`` bytes the k-byte string with the smallest hash is an
anchor, so two equal windows have the same anchor at the same place. A batch's suffix array holds its anchors, sorted
by the hash of their first k bytes, then by the hash of all bytes that a window around the anchor can reach, then by place. A new batch
is merge-scanned against the sorted levels of the index: an anchor whose reach occurred before is covered as a whole; anchors
that share k bytes but not their reach are compared window by window by 64-bit hashes of the windows. A level's rank is the logarithm of the
batch it holds; levels of equal rank merge into the next, so there are logarithmically many. Of equal contexts a level keeps the earliest.

Batches are of 1, 1, 1, 4, 8, 16, ... units, each from the fourth on about as large as all before it: the first two make a level of two units, the third and every
later batch a level of its own rank. So levels are scanned in proportion to the input, at most twice in all, however many batches there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bytestext import U, groups, mix, powers, prefix_hash, slice_hash, utf8
from .filters import may_contain

LENGTH = 100
K = 32
ENTRY = "kh long, ch long, doc_id long, pos int"
# Entries of one k-byte string that a task compares by itself; those of longer runs meet window by window.
RUN = 1 << 15
# Documents in the smallest batch of a large table, and how many such units a table is cut into.
UNIT_ROWS = 1 << 13
LEAST_UNITS, MOST_UNITS = 8, 1 << 8
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)


def _second_prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums to another base, so that an entry's two hashes are independent."""
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers(_BASE, len(buf)), out=out[1:])
    return out


def _second_slice(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    h = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts]
    return mix(h + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, place in it, hash of k bytes, hash of the whole reach) of the anchors of a group of texts.

    The reach of an anchor at p are the bytes from p - (length - k) to p + length, as far as the text has them. Equal
    hashes in a window are settled by the leftmost place.
    """
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    first = np.arange(len(buf) - k + 1)
    h = slice_hash(prefix_hash(buf), first, first + k)
    wide = length - k + 1  # k-byte strings per window
    # Place of the smallest hash of every window, by doubling the width; the left one of equals.
    best, span = first, 1
    while span * 2 <= wide:
        a, b = best[: len(best) - span], best[span:]
        best = np.where(h[b] < h[a], b, a)
        span *= 2
    a, b = best[:n], best[wide - span : wide - span + n]
    best = np.where(h[b] < h[a], b, a)
    # Windows must lie within one text.
    start = np.arange(n)
    text = np.searchsorted(at, start, side="right") - 1
    best = best[start + length <= at[text + 1]]
    pos = best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best
    text = np.searchsorted(at, pos, side="right") - 1
    left, right = np.maximum(pos - (length - k), at[text]), np.minimum(pos + length, at[text + 1])
    reach = _second_slice(_second_prefix(buf), left, right)
    return text, pos - at[text], h[pos], mix(reach + (pos - left).astype(U) * U(0xA0761D6478BD642F))


def _entries(length: int, k: int):
    """Suffix-array entries of texts; of equal reaches in one task's group of one document only the first counts later."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, at = batch["doc_id"].to_numpy(), 0
            for part in groups(utf8(batch["text"].tolist())):
                text, pos, kh, ch = anchors(part, length, k)
                yield pd.DataFrame({"kh": kh.view(np.int64), "ch": ch.view(np.int64), "doc_id": ids[at + text], "pos": pos.astype(np.int32)})
                at += len(part)

    return run


NEW, COVERED, COMPARE = 0, 1, 2


def _merge_scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over entries sorted by (kh, ch, doc_id, pos): the state of every entry; ``old`` marks those of levels.

    COVERED: the same reach came before. COMPARE: first of its reach, but other reaches have the same k bytes. NEW: alone with its k
    bytes. Only the last entry and the first one of an open run are kept between batches.
    """
    last_kh = last_ch = last_place = None
    reaches, waiting = 0, None  # of the open run: reaches so far, its first entry while it is alone
    for batch in batches:
        if not len(batch):
            continue
        # A document that occurs twice has its entries twice.
        entry = batch[["kh", "ch", "doc_id", "pos"]]
        again = (entry == entry.shift(1)).all(axis=1).to_numpy()
        again[0] = last_place is not None and tuple(entry.iloc[0]) == last_place
        last_place = tuple(entry.iloc[-1])
        batch = batch[~again].reset_index(drop=True)
        if not len(batch):
            continue
        kh, ch = batch["kh"].to_numpy(), batch["ch"].to_numpy()
        new_kh = np.concatenate([[last_kh is None or kh[0] != last_kh], kh[1:] != kh[:-1]])
        new_ch = new_kh | np.concatenate([[last_ch is None or ch[0] != last_ch], ch[1:] != ch[:-1]])
        run = np.cumsum(new_kh) - (0 if not new_kh[0] else 1)
        count = np.bincount(run, weights=new_ch).astype(np.int64)
        out = []
        if not new_kh[0]:
            count[0] += reaches
            if waiting is not None and count[0] > 1:
                out.append(waiting.assign(state=COMPARE))
                waiting = None
        elif waiting is not None:
            out.append(waiting.assign(state=NEW))
            waiting = None
        state = np.where(~new_ch, COVERED, np.where(count[run] > 1, COMPARE, NEW)).astype(np.int32)
        rows = batch.assign(state=state)
        # The first entry of the last run waits for what follows.
        if count[-1] == 1:
            hold = np.flatnonzero((run == run[-1]) & new_ch)
            if len(hold):
                waiting = batch.iloc[hold]
                rows = rows.drop(index=hold)
        out.append(rows)
        last_kh, last_ch, reaches = kh[-1], ch[-1], int(count[-1])
        yield pd.concat(out)
    if waiting is not None:
        yield waiting.assign(state=NEW)


def _sorted(entries: DataFrame) -> DataFrame:
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return entries.repartition(n, "kh").sortWithinPartitions("kh", "ch", "doc_id", "pos")


class SuffixLevels:
    """Levels of sorted entries; level ranks are distinct after each batch."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, entries: DataFrame, more_follow: bool = True, units: int = 1) -> DataFrame:
        """Scan a batch's suffix array with the levels; the stored COVERED and COMPARE entries.

        Batches must come in ascending order of doc_id. The batch becomes a level unless nothing follows it; its rank is the logarithm of ``units``.
        """
        both = entries.withColumn("old", F.lit(False))
        for _, level in self.levels:
            both = both.unionByName(level.withColumn("old", F.lit(True)))
        scanned = _sorted(both).mapInPandas(_merge_scan, f"{ENTRY}, old boolean, state int")
        wanted = scanned.where(f"state = {COMPARE} or (state = {COVERED} and not old)" + (" or not old" if more_follow else ""))
        found = materialize(wanted, "suffixes")
        if more_follow:
            self._insert(found.where(f"state <> {COVERED} and not old").select("kh", "ch", "doc_id", "pos"), units.bit_length() - 1)
        return found.where(f"state <> {NEW}")

    def _insert(self, level: DataFrame, rank: int = 0) -> None:
        same = [x for x in self.levels if x[0] == rank]
        if not same:
            self.levels.append((rank, level))
            return
        self.levels.remove(same[0])
        self._insert(materialize(_sorted(same[0][1].unionByName(level)), "suffix-level"), rank + 1)


def _reaches(length: int, k: int):
    """Bytes in reach of the places to compare, per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, places in zip(batch["doc_id"].tolist(), utf8(batch["text"].tolist()), batch["places"]):
                for pos, kh in sorted((p["pos"], p["kh"]) for p in places):
                    left = max(pos - (length - k), 0)
                    rows.append((kh, doc_id, pos, pos - left, text[left : pos + length]))
            yield pd.DataFrame(rows, columns=["kh", "doc_id", "pos", "before", "bytes"])

    return run


def _windows(group: pd.DataFrame, length: int, k: int) -> pd.DataFrame:
    """Byte ranges [start, end) covered by windows that another entry of the same k bytes has earlier. ``group`` may hold several runs of
    equal kh, sorted by (kh, doc_id, pos)."""
    group = group.drop_duplicates(["kh", "doc_id", "pos", "bytes"])
    data = group["bytes"].tolist()
    size = np.array([len(b) for b in data], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    prefix = _second_prefix(np.frombuffer(b"".join(data), np.uint8))
    before, pos, kh = group["before"].to_numpy(np.int64), group["pos"].to_numpy(np.int64), group["kh"].to_numpy(np.int64)
    n, out = len(group), []
    ids = group["doc_id"].to_numpy()
    # Rows that share an id can have the same place with unlike bytes around it; neither is earlier.
    place = np.cumsum(np.concatenate([[True], (kh[1:] != kh[:-1]) | (ids[1:] != ids[:-1]) | (pos[1:] != pos[:-1])])) if n else pos
    covered = np.zeros((n, length - k + 1), bool)
    for back in range(length - k + 1):
        start = before - back
        fits = np.flatnonzero((start >= 0) & (start + length <= size))
        if len(fits) > 1:
            h = _second_slice(prefix, at[fits] + start[fits], at[fits] + start[fits] + length) ^ mix(kh[fits].view(U))
            order = np.argsort(h, kind="stable")  # equal windows stay in order of place
            same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
            earliest = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
            at_place = place[fits[order]]
            covered[fits[order[at_place != at_place[earliest]]], back] = True
    for i in np.flatnonzero(covered.any(axis=1)).tolist():
        out += _spans(ids[i], pos[i], np.flatnonzero(covered[i]), length)
    return pd.DataFrame(out, columns=["doc_id", "start", "end"])


def _spans(doc_id: int, pos: int, backs: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Byte ranges of the windows that begin ``backs`` (ascending) before a place; windows next to each other are one."""
    return [(doc_id, pos - run[-1], pos - run[0] + length) for run in np.split(backs, np.flatnonzero(np.diff(backs) > 1) + 1)]


def _window_keys(length: int, k: int):
    """Every window around the places to compare: its hash, with its anchor's place in it, and the anchor's place in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _reaches(length, k)(batches):
            for first in range(0, len(whole), 10000):
                group = whole.iloc[first : first + 10000]
                data = group["bytes"].tolist()
                size = np.array([len(b) for b in data], np.int64)
                at = np.concatenate([[0], np.cumsum(size)])
                prefix = _second_prefix(np.frombuffer(b"".join(data), np.uint8))
                before = group["before"].to_numpy(np.int64)
                for back in range(length - k + 1):
                    start = before - back
                    fits = np.flatnonzero((start >= 0) & (start + length <= size))
                    h = _second_slice(prefix, at[fits] + start[fits], at[fits] + start[fits] + length)
                    wh = mix(h + U((back + 1) * 0xA0761D6478BD642F % (1 << 64))).view(np.int64)
                    yield group.iloc[fits][["kh", "doc_id", "pos"]].assign(wh=wh, back=np.int32(back))[["kh", "wh", "back", "doc_id", "pos"]]

    return run


def _joined_spans(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, pos, backs in zip(batch["doc_id"], batch["pos"], batch["backs"]):
                rows += _spans(doc_id, pos, np.sort(np.asarray(backs, np.int64)), length)
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end"])

    return run


def _long_runs(texts: DataFrame, length: int, k: int) -> DataFrame:
    """What ``_windows`` gives, for runs of any length: the earliest place of every window is an aggregate, and no task needs a whole run."""
    windows = materialize(texts.mapInPandas(_window_keys(length, k), "kh long, wh long, back int, doc_id long, pos int"), "windows")
    place = F.struct("doc_id", "pos")
    several = windows.groupBy("kh", "wh").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialize(several, "first-windows")
    # At most one in RUN windows is that frequent.
    frequent, rest = F.broadcast(firsts.where(F.col("n") > RUN)), firsts.where(F.col("n") <= RUN)
    met = windows.join(frequent, ["kh", "wh"]).unionByName(windows.join(frequent, ["kh", "wh"], "left_anti").join(rest, ["kh", "wh"]))
    later = met.where(place > F.col("first"))
    return later.groupBy("doc_id", "pos").agg(F.collect_set("back").alias("backs")).mapInPandas(_joined_spans(length), "doc_id long, start long, end long")


def _compare(length: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            kh = batch["kh"].to_numpy()
            limits = np.flatnonzero(kh[1:] != kh[:-1]) + 1
            if open_ and kh[0] != open_[-1]["kh"].iloc[-1]:
                limits = np.concatenate([[0], limits])
            if not len(limits):
                open_.append(batch)
                continue
            whole = pd.concat([*open_, batch.iloc[: limits[-1]]])
            open_ = [batch.iloc[limits[-1]:]]
            if len(whole):
                yield _windows(whole, length, k)
        if open_:
            yield _windows(pd.concat(open_), length, k)

    return run


def _cut(length: int, k: int):
    """Remove the covered bytes of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, places, ranges in zip(batch["doc_id"], utf8(batch["text"].tolist()), batch["places"], batch["ranges"]):
                spans = [(r["start"], r["end"]) for r in ranges] if ranges is not None else []
                for pos in (places if places is not None else ()):
                    first, last = max(pos - (length - k), 0), min(pos, len(text) - length)
                    if first <= last:
                        spans.append((first, last + length))
                removed: list[list[int]] = []
                for start, end in sorted(spans):
                    if removed and start <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], end)
                    else:
                        removed.append([start, end])
                kept, upto = [], 0
                for start, end in removed:
                    kept.append(text[upto:start])
                    upto = end
                kept.append(text[upto:])
                rest = b"".join(kept)
                rows.append((doc_id, len(text), len(text) - len(rest), len(removed), hashlib.sha256(rest).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def batch_units(rows: int) -> list[int]:
    """Sizes of the batches of a table, in units."""
    left, out = min(max(-(-rows // UNIT_ROWS), LEAST_UNITS), MOST_UNITS), []
    while left:
        size = 1 if len(out) < 3 else 1 << len(out) - 1
        # What would be left behind a batch and is smaller goes with it.
        out.append(left if left < 2 * size else size)
        left -= out[-1]
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, batches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row.

    A byte is removed if it lies in a string of ``length`` bytes that also starts earlier: in a document with a smaller id, or before
    in the same one. Texts are UTF-8 bytes, null is empty. The table is taken in as ``batches`` batches in ascending order of ids; the
    result does not depend on their number. Rows with a null id are left whole and cover nothing. Rows that share an
    id are one document for the order: equal texts among them do not cover each other, and other texts are ordered by place.
    An empty table gives an empty result; extra columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    sizes = [1] * batches if batches else batch_units(known.count())
    ends = np.cumsum(sizes)[:-1]
    cuts = known.approxQuantile("doc_id", [float(e) / sum(sizes) for e in ends], min(0.02, 0.25 / sum(sizes))) if len(ends) else []
    # Ids can be so few that batches have equal limits; such a batch is empty.
    units = {int(c): size for c, size in zip(cuts, sizes)}
    limits = [None, *sorted(units), None]
    index, found = SuffixLevels(), None
    for i, (low, high) in enumerate(zip(limits, limits[1:])):
        part = known
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        entries = part.mapInPandas(_entries(length, k), ENTRY)
        new = index.add(entries, more_follow=i + 2 < len(limits), units=units.get(high, 1))
        found = new if found is None else found.unionByName(new)
    # Entries to compare, each once, with their bytes.
    compared = found.where(f"state = {COMPARE}")
    long_runs = materialize(compared.groupBy("kh").agg(F.count("*").alias("n")).where(F.col("n") > RUN).select("kh", F.lit(True).alias("long")), "long-runs")
    some_long = not long_runs.isEmpty()
    entries = compared.select("kh", "doc_id", "pos").distinct()
    # At most one in RUN entries starts a long run.
    entries = entries.join(F.broadcast(long_runs), "kh", "left") if some_long else entries.withColumn("long", F.lit(None).cast("boolean"))
    place = F.struct("pos", "kh")
    compare = materialize(entries.groupBy("doc_id").agg(F.collect_list(F.when(F.col("long").isNull(), place)).alias("places"), F.collect_list(F.when(F.col("long"), place)).alias("long_places")), "compare")
    texts = known.where(may_contain(compare, "doc_id", F.col("doc_id"))).join(compare, "doc_id")
    reach = texts.select("doc_id", "text", "places").mapInPandas(_reaches(length, k), "kh long, doc_id long, pos int, before int, bytes binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    covers = reach.repartition(n, "kh").sortWithinPartitions("kh", "doc_id", "pos").mapInPandas(_compare(length, k), "doc_id long, start long, end long")
    if some_long:
        covers = covers.unionByName(_long_runs(texts.where(F.size("long_places") > 0).select("doc_id", "text", F.col("long_places").alias("places")), length, k))
    ranges = materialize(covers, "ranges")
    of_doc = ranges.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    covered = found.where(f"state = {COVERED}").groupBy("doc_id").agg(F.collect_set("pos").alias("places"))
    spans = materialize(covered.join(of_doc, "doc_id", "full"), "spans")
    touched = may_contain(spans, "doc_id", F.coalesce("doc_id", F.lit(-1)))
    marked = rows.withColumn("touched", touched)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    untouched = marked.where("not touched or doc_id is null").select("doc_id", "text", F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("ranges"))
    cut = marked.where("touched and doc_id is not null").join(spans, "doc_id", "left").select("doc_id", "text", "places", "ranges")
    return untouched.unionByName(cut).mapInPandas(_cut(length, k), schema)
