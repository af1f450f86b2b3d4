"""Sharding by jump consistent hashing: the id and the number of shards decide, and no ring table is kept.

Going from n to n+1 shards moves a 1/(n+1) share of the rows, all of them into
the new shard.  Nulls: a null id is hashed as a value of its own.  Equal ids go
to equal shards; rows that repeat an id are numbered by text checksum and size.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import gapless

_STEP = np.uint64(2862933555777941757)
_NULL_KEY = np.uint64(0x5BD1E995)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key (Lamping and Veach): the last jump below ``shards``."""
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), np.int64)
    jump = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = jump[live]
        key[live] = key[live] * _STEP + np.uint64(1)
        jump[live] = ((jump[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def assign_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot, grown_shard) per row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1; ``slot`` is gapless
    from 0 in each shard, in order of (id, text_crc32, size); ``grown_shard`` is
    the shard with one shard more.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            keys = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if ids.null_count:
                keys = np.where(ids.is_null().to_numpy(zero_copy_only=False), _NULL_KEY, keys)
            yield pa.record_batch([*b.columns, pa.array(jump_hash(keys, shards), pa.int32()), pa.array(jump_hash(keys, shards + 1), pa.int32())], names=["id", "size", "text_crc32", "shard", "grown_shard"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = rows.mapInArrow(deal, "id long, size long, text_crc32 long, shard int, grown_shard int")
    return gapless(dealt, ["shard"], ["id", "text_crc32", "size"], "slot").select("id", "size", "text_crc32", "shard", "slot", "grown_shard")
