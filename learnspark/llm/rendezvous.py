"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Each (key, shard) pair has a pseudo-random u in (0, 1); a record goes to the shard with the largest
-weight / ln(u). A new shard can only win records for itself, so nothing moves between old shards,
and a shard's share is its weight's share. Slots number a shard's records without gaps: records are
counted in small chunks, the chunk counts are summed up per shard, and only within a chunk are rows
numbered, so no task holds a whole shard.

Defined results: a null key is hashed as the empty string; a null text has no bytes (size 1, CRC 0);
rows that repeat a key share its shard and get slots of their own; an empty table gives an empty
result; other columns are left alone, and a result column that the input has is an error that names it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnspark.llm.common import cut, free_names, table

#: Rows to number in one window partition, about.
CHUNK_ROWS = 20_000
SALT = "learnspark-shard"


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(SALT), F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.lit(float(weight)) / F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The winning shard of 0..len(weights)-1; equal scores, if ever, go to the larger number."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    return F.array_max(F.array(*[F.struct(_score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]))["shard"]


def with_slots(sharded: DataFrame, key: str, rows: int, shards: int, shard_col: str = "shard", slot_col: str = "slot", spread: Sequence[str] = ()) -> DataFrame:
    """sharded plus slot_col, gapless from 0 in each shard.

    Rows are numbered in chunks of about CHUNK_ROWS by a hash of the key and of the columns in
    `spread`, so that the rows of a hot key that differ there are not all in one chunk.
    """
    chunk, size, start, at = free_names(sharded, "chunk", "size_of", "start_of", "at")
    chunks = max(1, rows // (CHUNK_ROWS * shards))
    order = [F.col(f"`{c}`") for c in (key, *spread)]
    part = sharded.withColumn(chunk, F.pmod(F.xxhash64(*[c.cast("string") for c in order], F.lit("chunk")), F.lit(chunks)))
    sizes = part.groupBy(shard_col, chunk).agg(F.count("*").alias(size))
    before = Window.partitionBy(shard_col).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard_col, chunk, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(shard_col, chunk).orderBy(*order)
    numbered = part.withColumn(at, F.row_number().over(inside) - 1)
    joined = numbered.join(starts, [shard_col, chunk]).withColumn(slot_col, F.col(start) + F.col(at))
    return joined.select(*[F.col(f"`{c}`") for c in sharded.columns], slot_col)


def assign(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] = (), shard_col: str = "shard", grown_col: str = "grown_shard") -> DataFrame:
    """df plus shard_col, and grown_col where `grown` gives the weights of shards to be added; neither may be in df."""
    if clash := {shard_col, grown_col} & set(df.columns):
        raise ValueError(f"df has {sorted(clash)} already; name other columns")
    of = F.col(f"`{key}`")
    out = df.withColumn(shard_col, shard_of(of, weights))
    return out.withColumn(grown_col, shard_of(of, [*weights, *grown])) if grown else out


def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    sharded = cut(assign(docs, "doc_id", [1.0] * 16, [1.0]))
    slots = with_slots(sharded, "doc_id", sharded.count(), 16, spread=["text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
