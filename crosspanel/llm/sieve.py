"""A Bloom filter of ids with a fixed size, so that few rows of a large table meet an exact join.

A table's rows are sieved where they lie; only those that may be named among the
ids are shuffled and joined. The filter has ``BITS`` bits whatever the number of
ids; with very many it lets more rows pass, which costs time and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.text import mixed

BITS, TURNS = 1 << 25, 3
_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _places(ids: np.ndarray) -> np.ndarray:
    """Bit numbers of each id, a row for each turn."""
    return mixed(ids.astype(np.int64).view(np.uint64)[None] + _SALTS[:TURNS, None]) % np.uint64(BITS)


def _marks(batches):
    for batch in batches:
        places = _places(batch.column(0).drop_null().to_numpy()).reshape(-1)
        yield pa.RecordBatch.from_arrays([
            pa.array((places >> np.uint64(6)).astype(np.int64)),
            pa.array((np.uint64(1) << (places & np.uint64(63))).view(np.int64))], ["word", "mask"])


def sieve(ids: DataFrame) -> Broadcast:
    """The filter of a one-column table of long ids; at most BITS / 64 words reach the driver."""
    words = ids.mapInArrow(_marks, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(bits)


def sieved(df: DataFrame, column: str, bits: Broadcast, named: bool) -> DataFrame:
    """Rows of ``df`` whose id may be among the sieve's (``named``), or surely isn't; a null id isn't."""
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            ids = batch.column(at).cast(pa.int64())
            places = _places(ids.fill_null(0).to_numpy())
            inside = ((bits.value[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(0)
            inside &= ids.is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(inside if named else ~inside))

    return df.mapInArrow(run, df.schema)
