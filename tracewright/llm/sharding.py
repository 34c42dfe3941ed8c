"""Sharding by a two-pass external shuffle.

Pass one counts bytes per shard and scatters records by seeded hashes into buckets that fit a task's memory; pass two
applies a seeded Fisher-Yates shuffle to each bucket. A bucket's first slot is the number of records in the shard's
earlier buckets, so slots are gapless and every shard is in uniformly random order.

Shards obey the law `key`: the shard is the one whose seeded hash with doc_id is highest (rendezvous hashing), so it
depends on doc_id and the number of shards alone, and one more shard only takes rows into itself. Load is balanced by
the hash, not by a quota.

Defined cases: null doc_id hashes as a key of its own; null text has size 16 and the checksum of the empty string;
rows with equal doc_id share a shard, and their order before the shuffle is by (doc_id, checksum, size), which is a
tie only between equal records; an empty table gives no rows; other columns travel with their record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import text_bytes

RECORD_OVERHEAD = 16
BUCKET_BYTES = 8 << 20


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """struct(weight, shard) of the highest weight among shards 0..shards-1."""
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, s, F.lit(seed)).alias("weight"), s.alias("shard"))))


def place(docs: DataFrame, shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    """docs with shard, grown_shard and bucket. The number of buckets per shard follows from one counted pass."""
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    sized = docs.withColumn("size", text_bytes() + RECORD_OVERHEAD).withColumn("text_crc32", checksum)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    best = rendezvous(key, shards, seed)
    sized = sized.withColumn("__best", best).withColumn("shard", F.col("__best.shard").cast("int"))
    extra = F.xxhash64(key, F.lit(shards), F.lit(seed))
    sized = sized.withColumn("grown_shard", F.when(extra > F.col("__best.weight"), F.lit(shards)).otherwise(F.col("shard")).cast("int")).drop("__best")
    largest = sized.groupBy("shard").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    per_shard = max(1, -(-int(largest) // bucket_bytes))
    return sized.withColumn("bucket", F.col("shard").cast("long") * per_shard + F.pmod(F.xxhash64(F.lit(seed + 1), key, "text_crc32"), F.lit(per_shard)))


def external_shuffle(docs: DataFrame, shards: int, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs plus size, text_crc32, shard, grown_shard, bucket and slot; each record moves once."""
    placed = place(docs, shards, seed, bucket_bytes)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    names = placed.columns

    def shuffle(records: pa.Table, offset: pa.Table) -> pa.Table:
        if not records.num_rows:
            return records.append_column("slot", pa.array([], pa.int64()))
        order = pc.sort_indices(records, [("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")]).to_numpy().copy()
        bucket = records.column("bucket")[0].as_py()
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # Fisher-Yates
        first = offset.column("first_slot")[0].as_py()
        return records.take(pa.array(order)).append_column("slot", pa.array(np.arange(first, first + len(order), dtype=np.int64)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields) + ", slot long"
    return placed.groupBy("bucket").cogroup(offsets.groupBy("bucket")).applyInArrow(shuffle, schema).select(*names, "slot")


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard, each bucket one file in slot order; every task writes only the bucket it shuffled."""
    shuffled.write.partitionBy("shard").parquet(path)
