"""Sharding: a two-pass external shuffle of whole records into a fixed number of shards (DataFrame functions only).

Pass 1 scatters: the shard is the one whose seeded hash with doc_id is largest (rendezvous hashing), so doc_id and the
shard count alone decide, and one more shard takes rows only into itself. Within a shard a second seeded hash of the
record and of a number that its row gets picks the bucket, also where very many rows are equal; a shard has as many
buckets as its own bytes need, so a shard that holds much more than the others has more, not larger ones. Pass 2 sorts each bucket (so that a rerun sees the same order), applies
Spark's seeded Fisher-Yates `shuffle`, and writes the records with their place.

Defined results: null text counts 0 bytes; rows with a null doc_id share one shard, spread over its buckets; exact
repeated rows keep one place each; an empty table gives an empty table; extra columns travel along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of records that one task shuffles at a time, at most; smaller where all cores would not have work.
BUCKET_BYTES = 64 << 20
#: The largest number of buckets whose offsets are broadcast (about 24 bytes each); beyond it they are joined by shuffle.
BROADCAST_BUCKETS = 100_000


def shard_of(key: Column, shards: int, seed: int = 17) -> Column:
    best = F.greatest(*[F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]) if shards > 1 else F.struct(F.lit(0).alias("s"))
    return best["s"]


def shard(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of docs as struct `record`, with size, shard, slot (gapless from 0 in the shard) and grown_shard."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select(F.struct(*docs.columns).alias("record"), size.alias("size"), shard_of(F.col("doc_id"), shards, seed).alias("shard"), F.xxhash64(F.lit(seed), F.lit(shards), "doc_id").alias("newest"), (F.monotonically_increasing_id() % 1024).alias("place"))
    # One row a shard: its bytes decide its buckets.
    weights = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    goal = min(bucket_bytes, max(1 << 20, sum(weights.values()) // (4 * spark.sparkContext.defaultParallelism)))
    parts = [max(1, -(-weights.get(s, 0) // goal)) for s in range(shards)]
    buckets = sum(parts)
    lookup = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("shard"))
    best = F.greatest(*[F.xxhash64(F.lit(seed), F.lit(s), F.col("record.doc_id")) for s in range(shards)]) if shards > 1 else F.xxhash64(F.lit(seed), F.lit(0), F.col("record.doc_id"))
    # Equal rows are told apart by where they stand within a file, which a repeated task finds again.
    place = F.xxhash64(F.lit(seed + 1), F.col("record.doc_id"), F.col("record.text"), F.col("place"))
    scattered = rows.select(
        "record", "size", "shard",
        F.when(F.col("newest") > best, shards).otherwise(F.col("shard")).alias("grown_shard"),
        (lookup([sum(parts[:s]) for s in range(shards)]) + F.pmod(place, lookup(parts).cast("long"))).cast("int").alias("bucket"),
    )
    placed = scattered.repartition(buckets, "bucket") if not hasattr(scattered, "repartitionById") else scattered.repartitionById(buckets, F.col("bucket"))
    item = F.struct(F.col("record.doc_id").alias("k"), F.xxhash64("record.text").alias("t"), "record", "size", "grown_shard")
    shuffled = (
        placed.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(item), lambda a, b: _by_key(a, b)).alias("items"))
        .select("shard", "bucket", F.posexplode(F.shuffle("items", seed)).alias("pos", "item"))
        .select("shard", "bucket", "pos", "item.record", "item.size", "item.grown_shard")
    )
    written, _ = common.store(shuffled, "shards")
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    before = F.broadcast(before) if buckets <= BROADCAST_BUCKETS else before
    return written.join(before, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b"))).select("record", "size", "shard", (F.col("before") + F.col("pos")).alias("slot"), "grown_shard")


def _by_key(a: Column, b: Column) -> Column:
    """Order by doc_id (nulls first), then by the text's hash."""
    ka, kb = F.struct(a["k"].isNotNull(), a["k"], a["t"]), F.struct(b["k"].isNotNull(), b["k"], b["t"])
    return F.when(ka < kb, -1).when(ka > kb, 1).otherwise(0)


def digest(placed: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return placed.select(
        F.col("record.doc_id").alias("doc_id"), F.col("size").cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )
