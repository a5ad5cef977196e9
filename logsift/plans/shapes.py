"""Plan shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from logsift.session import materialize

BROADCAST_ROWS = 500_000
HOT_ROWS = 1_000_000
SALTS = 32


def head_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_column: str = "rn", salts: int = SALTS
) -> DataFrame:
    """First ``n`` rows of every group, ranked, without one task per hot group.

    The first window ranks inside (keys, salt), where the salt is the input
    partition; Spark's window group limit keeps at most ``n`` rows per group and
    task before the shuffle. The second window sees at most ``salts * n`` rows of
    any group. The salt never changes the result, only who computes it.
    """
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.spark_partition_id() % salts)
        .withColumn(rank_column, F.row_number().over(local))
        .filter(F.col(rank_column) <= n)
        .drop("_salt")
        .withColumn(rank_column, F.row_number().over(final))
        .filter(F.col(rank_column) <= n)
    )


def join_keyed(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Join a large, possibly skewed ``left`` to a ``right`` with one row per key.

    ``right`` is written once (unless ``stored`` says it was) and counted. Up to
    ``broadcast_rows`` rows it is broadcast, so ``left`` is not shuffled at all.
    Beyond that the keys with more than ``hot_rows`` rows in ``left`` are split off:
    there can be few of them, so their share of ``right`` is broadcast, while the
    rest meets in a shuffle join in which no key is large. Rows without a key match
    nothing and skip the join. ``how`` is inner, left, left_semi or left_anti.
    """
    keys = list(keys)
    if not stored:
        right = materialize(right, "side")
    if right.count() <= broadcast_rows:
        return left.join(F.broadcast(right), keys, how)

    keyed = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    counts = left.filter(keyed).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(counts.filter(F.col("_n") > hot_rows).select(*keys), "hot")
    parts = []
    if hot.isEmpty() or hot.count() > broadcast_rows:
        # No key is large, or so many are that none of them dominates.
        parts.append(left.filter(keyed).join(right, keys, how))
    else:
        hot = F.broadcast(hot)
        parts.append(left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how))
        parts.append(left.filter(keyed).join(hot, keys, "left_anti").join(right, keys, how))
    unkeyed = left.filter(~keyed)
    if how == "left":
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in keys]
        parts.append(unkeyed.select("*", *missing))
    elif how == "left_anti":
        parts.append(unkeyed)
    return reduce(DataFrame.unionByName, parts)


def fill_cores(df: DataFrame, task_rows: int | None = None) -> DataFrame:
    """A scan with fewer partitions than cores (a small or unsplittable file), spread over all cores.

    For scans that feed CPU-heavy expressions. Large inputs have more splits than
    cores and are left as they are; with ``task_rows`` only if no split has more rows than that, as
    a file's splits can be many and yet a few of them hold all its row groups.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if task_rows is None:
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
    # No column is read for the count.
    split = df.groupBy(F.spark_partition_id()).count()
    rows, most, splits = split.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0)), F.count(F.lit(1))).first()
    return df.repartition(max(cores, -(-rows // task_rows))) if splits < cores or most > task_rows else df


def computed_once(df: DataFrame, *columns: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The ``keep`` columns and the given ones, each evaluated once per row whatever follows.

    A generator over a one-element array keeps the optimizer from copying costly
    expressions into the filters and join conditions above it.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))


def spread_nulls(df: DataFrame, keys: Sequence[str], salts: int = 1024) -> Column:
    """Join helper: 0 where all keys are set, else a value spreading the rows that can never match."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return F.when(missing, F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int") + 1).otherwise(0)
