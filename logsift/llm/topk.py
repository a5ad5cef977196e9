"""Exact top-k by inner product through distributed histogram selection (operator 5).

Queries and candidates meet in cells of bounded size. Every round scores all pairs, counts the scores of each query in
equal ranges of its current interval, adds the counts up over all cells and narrows the interval to the range that holds the
k-th highest score, until the range is one integer. A last pass keeps scores above that value and, at the value, the
smallest ids, and ranks them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CELL_CANDIDATES = 4096
CELL_QUERIES = 4096
BINS = 256
_TILE = 256  # queries scored at once
_EXACT = float(2**53)


def usable(vector: str) -> Column:
    """Neither null nor with null or non-finite components."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & fine


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while every partial sum fits into 53 bits, else in integers of any size, held to the limits of a long."""
    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)), np.int64)
    bound = (np.abs(queries) @ np.abs(candidates).max(axis=0)).max()
    if bound < _EXACT:
        return (queries @ candidates.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in queries], [[int(x) for x in row] for row in candidates]
    limit = 2**62
    return np.array([[max(-limit, min(limit, sum(a * b for a, b in zip(q, c)))) for c in whole[1]] for q in whole[0]], np.int64)


def _tiles(queries: pd.DataFrame, candidates: pd.DataFrame):
    """(rows of queries, scores, own): scores of a few queries against all candidates of the cell."""
    width = max(max(map(len, queries["vector"])), max(map(len, candidates["candidate"])))
    right, ids = _matrix(candidates["candidate"].tolist(), width), candidates["candidate_id"].to_numpy(np.int64)
    for at in range(0, len(queries), _TILE):
        part = queries.iloc[at : at + _TILE]
        own = part["vec_id"].to_numpy(np.int64)[:, None] == ids[None, :]
        yield part, _scores(_matrix(part["vector"].tolist(), width), right), own, ids


def _count(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            for part, scores, own, _ in _tiles(queries, candidates):
                low, width = part["low"].to_numpy(np.int64)[:, None], part["width"].to_numpy(np.int64)[:, None]
                bins = (scores - low) // width
                inside = (scores >= low) & (scores < part["high"].to_numpy(np.int64)[:, None]) & ~own
                flat = (np.arange(len(part))[:, None] * BINS + bins)[inside]
                counts = np.bincount(flat, minlength=len(part) * BINS).reshape(len(part), BINS)
                # Ranges below this cell's own k-th score cannot hold the k-th score of all.
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                row, bin_ = np.nonzero((counts > 0) & (above < k))
                out.append(pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[row], "bin": bin_, "n": counts[row, bin_]}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "bin": [], "n": []}).astype("int64")

    return run


def _take(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            for part, scores, own, ids in _tiles(queries, candidates):
                kth, above = part["low"].to_numpy(np.int64)[:, None], part["above"].to_numpy(np.int64)
                row, column = np.nonzero((scores >= kth) & ~own)
                found = pd.DataFrame({"query_id": part["vec_id"].to_numpy()[row], "vec_id": ids[column], "score": scores[row, column],
                                      "tie": scores[row, column] == kth[row, 0], "room": k - above[row]})
                found = found.sort_values(["query_id", "tie", "vec_id"])
                place = found.groupby(["query_id", "tie"]).cumcount()
                out.append(found[~found["tie"] | (place < found["room"])][["query_id", "vec_id", "score"]])
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
          cell_candidates: int = CELL_CANDIDATES, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row where ``is_query`` holds.

    Components become floor(scale * x). Rows with null id or unusable vector take no part; missing trailing components are
    zero; rows with the id of the query are its own. A query with fewer than k others gets all of them, a lone one none. Of
    repeated rows with one id each is a candidate. Extra columns are not read.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    floors = F.when(F.size(vector_col) > 0, whole).otherwise(F.array().cast("array<double>"))
    rows = materialize(vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), floors.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    n, n_queries, largest = rows.agg(F.count("*"), F.count_if("asks"), F.max(square)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n_queries:
        return spark.createDataFrame([], schema)
    groups, blocks = max(1, -(-n // cell_candidates)), max(1, -(-n_queries // cell_queries))
    cells = int(groups * blocks)
    # Every cell holds some of the candidates and some of the queries.
    some = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * groups + F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    candidates = rows.withColumn("candidate_cell", F.explode(some)).select(
        "candidate_cell", F.col("vec_id").alias("candidate_id"), F.col("vector").alias("candidate"))
    asked = rows.where("asks").dropDuplicates(["vec_id"])
    reach = int(min(2.0**62, np.ceil(np.sqrt(largest or 0.0)) ** 2 + 1))
    state = asked.select("vec_id", F.lit(-reach).alias("low"), F.lit(reach + 1).alias("high"), F.lit(-(-(2 * reach + 1) // BINS)).alias("width"), F.lit(0).cast("long").alias("above"))
    block = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(blocks))

    def dealt(with_state: DataFrame) -> DataFrame:
        both = asked.select("vec_id", "vector").join(with_state, "vec_id")
        return both.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: block * groups + g)))

    def meet(function, with_state: DataFrame, out: str) -> DataFrame:
        return dealt(with_state).repartition(cells, "cell").groupBy("cell").cogroup(
            candidates.repartition(cells, "candidate_cell").groupBy("candidate_cell")).applyInPandas(
            lambda q, c: function(q, c), out)

    width = -(-(2 * reach + 1) // BINS)
    while True:
        counts = meet(_count(k), state, "vec_id long, bin long, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("vec_id").orderBy(F.desc("bin"))
        ranked = counts.join(state, "vec_id").withColumn("upto", F.sum("n").over(down)).withColumn("need", F.lit(k) - F.col("above"))
        # The first range, from above, with which the k-th score is reached; none with too few scores.
        hit = ranked.where(F.col("upto") >= F.col("need")).groupBy("vec_id").agg(
            F.max(F.struct("bin", "n", "upto", "low", "high", "width", "above")).alias("x"))
        narrowed = hit.select("vec_id", (F.col("x.low") + F.col("x.bin") * F.col("x.width")).alias("low"),
                              F.least(F.col("x.high"), F.col("x.low") + (F.col("x.bin") + 1) * F.col("x.width")).alias("high"),
                              (F.col("x.above") + F.col("x.upto") - F.col("x.n")).alias("above"))
        next_width = max(1, -(-width // BINS))
        # A query with fewer than k scores keeps its low end, below all of them, and an empty interval in later rounds.
        state = materialize(state.select("vec_id", F.col("low").alias("old")).join(narrowed, "vec_id", "left").select(
            "vec_id", F.coalesce("low", "old").alias("low"), F.coalesce("high", "old").alias("high"), F.lit(next_width).cast("long").alias("width"), F.coalesce("above", F.lit(0)).alias("above")), "intervals")
        if width == 1:
            break
        width = next_width
    found = meet(_take(k), state, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
