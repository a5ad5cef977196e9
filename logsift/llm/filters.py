"""A filter over ids: it spares rows that cannot match a shuffle, and lets a few others pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits per id, and the most a filter has (32 MiB); beyond that more rows pass, and no result changes.
BITS_PER_ID = 16
MOST_BITS = 1 << 28
_ROW_BITS = 32768


def may_contain(ids: DataFrame, id_col: str, probe: Column) -> Column:
    """A condition that holds for every ``probe`` among the ids (a stored table)."""
    n_bits = min(MOST_BITS, max(_ROW_BITS, 1 << (BITS_PER_ID * ids.count()).bit_length()))

    def place(column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n_bits)) + 1

    p = place(F.col(id_col))
    rows = ids.select(p.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    # At most MOST_BITS / 8 bytes.
    shared = ids.sparkSession.sparkContext.broadcast({int(r["bucket"]): bytes(r["bits"]) for r in rows.collect()})

    def test(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros((n_bits // _ROW_BITS + 2) * _ROW_BITS // 8, np.uint8)
        for bucket, data in shared.value.items():
            table[bucket * _ROW_BITS // 8 : (bucket + 1) * _ROW_BITS // 8] = np.frombuffer(data, np.uint8)
        for batch in batches:
            at = batch.to_numpy(np.int64) - 1 + _ROW_BITS
            yield pd.Series((table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return F.pandas_udf(test, "boolean")(place(probe))
