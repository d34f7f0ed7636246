"""A bit filter of fixed size that keeps rows without a partner out of a shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 23


def likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys may be among the wanted ones; a join on the keys must follow.

    The filter has 2**FILTER_BITS bits (1 MB) whatever the number of wanted keys: rows are tested
    where they are read, and wide ones that nobody asks for are not shuffled.  With very many wanted keys it lets
    more through, never less.  Nulls are values like others.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(1 << FILTER_BITS))
    words = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")
    )
    table = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in words.collect():
        table[row.word] = row.bits
    shared = rows.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    @F.arrow_udf("boolean")
    def held(bits: pa.Array) -> pa.Array:
        at = bits.to_numpy().astype(np.int64)
        return pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1)

    return rows.where(held(bit))
