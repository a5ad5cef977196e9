"""Mixing sources to target weights (operator 6), in DataFrame operations only.

Every row gets a hash-random key. Key ranges (their number follows the number of rows) order
each source; sums per range, running sums over the ranges of a source and running sums inside a
range together are the prefix sum of a whole source, without a task that holds one. A source's
budget is taken in whole epochs, and the last epoch is cut where the prefix sum meets what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

RANGE_ROWS = 20_000
_KEY_BITS = 40


def word_count(text: str = "text") -> Column:
    """Number of words, runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Add ``target`` to (src, source_size) rows.

    Sources take the weights in the order of ``src``, repeating. Their shares of the whole stop
    at ``most`` times their size; what is beyond is shared again by weight among the others until none is above.
    """
    # Ranks without one task for all sources: order ranges first, then inside each.
    ranged = materialize(sources.repartitionByRange("src").withColumn("part", F.spark_partition_id()), "sources")
    before = ranged.groupBy("part").count().withColumn(
        "before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("src")) + F.col("before") - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    weighted = materialize(ranged.join(F.broadcast(before), "part").select("src", "source_size", weight.cast("double").alias("weight")), "weights")
    cap = F.lit(most) * F.col("source_size")
    total, per_weight = weighted.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:
        above = (F.lit(per_weight) * F.col("weight") > cap)
        full, left = weighted.agg(
            F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        share = (total - (full or 0)) / left if left else per_weight
        if share <= per_weight:
            break
        per_weight = share
    return weighted.select("src", "source_size", F.least(F.lit(per_weight) * F.col("weight"), cap.cast("double")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 7, keep: Sequence[str] = ("doc_id",),
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_rows: int = RANGE_ROWS) -> DataFrame:
    """The columns ``keep`` of every row and a struct ``__mix`` (size, source_size, target, taken).

    Null text has size 0, a null source is a source of its own and the last one. A source
    without words has target 0. Rows equal in id and text are ordered by chance between
    themselves, so the result as a whole does not depend on it. An empty table gives an empty result.
    """
    # The letter keeps null apart from every name and behind all of them.
    src = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("~"))
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 64 - _KEY_BITS)
    rows = materialize(docs.select(
        F.struct(*keep).alias("row"), F.col(id_col).cast("string").alias("id"), src.alias("src"), word_count(text_col).alias("size"), key.alias("key")), "sizes")
    n_ranges = max(1, -(-rows.count() // range_rows))
    rows = rows.withColumn("range", F.shiftright(F.col("key") * F.lit(n_ranges), _KEY_BITS))
    sums = materialize(rows.groupBy("src", "range").agg(F.sum("size").alias("words")), "ranges")
    targets = source_targets(sums.groupBy("src").agg(F.sum("words").alias("source_size")), weights, most)
    upto = sums.withColumn("before", F.sum("words").over(Window.partitionBy("src").orderBy("range")) - F.col("words"))
    plan = upto.join(targets, "src").select("src", "range", "before", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("src", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    # floor() of a quotient of doubles can be one too high only beyond 2**53 words; integers settle it.
    epochs = F.when(whole * F.col("source_size") > budget, whole - 1).otherwise(whole)
    rest = budget - F.col("epochs") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return (
        rows.withColumn("inside", F.coalesce(inside, F.lit(0))).join(plan, ["src", "range"])
        .withColumn("start", F.col("before") + F.col("inside")).withColumn("epochs", epochs).withColumn("rest", rest)
        .select("row.*", F.struct(
            "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"),
            F.col("epochs").alias("epochs"), last.alias("in_last_epoch")).alias("__mix"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its columns.

    Documents stay whole here: the one that a source's budget cuts is taken once more if at
    least half of it lies within the budget. Rows without words cost nothing; they stay once.
    """
    taken = mix(docs, keep=docs.columns, **options)
    once_more = F.col("__mix.in_last_epoch") * 2 >= F.greatest(F.col("__mix.size"), F.lit(1))
    times = F.when(F.col("__mix.size") == 0, F.lit(1)).otherwise(F.col("__mix.epochs") + F.when(once_more, 1).otherwise(0))
    copies = taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return copies.select(*docs.columns)
