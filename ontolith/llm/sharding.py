"""Two-pass external shuffle into shards.

Pass one scatters the records over memory-sized buckets by a seeded hash. Pass two puts each bucket, alone in memory, into
a random order by Fisher-Yates (Spark's `shuffle` expression is that algorithm) and deals the resulting global order out to
the shards: position p goes to shard p mod n, slot p div n. Shard sizes thus differ by one row at most.

Everything is DataFrame code. The hash is over a row's columns and its place in the table, so that equal rows are scattered
too. Buckets are exchanged by bucket number (one bucket a partition), so the size of a task is the size of a bucket and does not
depend on any key of the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, partitions, steady

#: Up to this many buckets (24 bytes each) the table of bucket offsets may be broadcast; one task adds it up.
BROADCAST_BUCKETS = 1 << 20


def _size(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        total = total + (F.coalesce(F.octet_length(col(name)), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16))
    return total


def external_shuffle(df: DataFrame, *, shards: int, seed: int = 17, bucket_bytes: int = 64 << 20) -> DataFrame:
    """All rows of `df` in one random order, dealt out to `shards`.

    Returns record (a struct of all columns of df, so that no name can clash), bucket int, position long (the place in the
    global order), shard int and slot long (gapless from 0 in each shard). An empty input gives an empty result; nulls
    are hashed like any value; equal rows are rows of their own. The order is fixed by the seed, the rows and their places
    in the files of df (of a table that is written first, if df is not a Parquet table just read). A row, however long its
    texts, counts with its bytes when the number of buckets is chosen, and lies whole in one bucket.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = df.sparkSession
    df, at = steady(df, Scratch(spark, "sharding"))
    total = df.agg(F.sum(_size(df))).first()[0] or 0
    buckets = max(partitions(spark), math.ceil(total / bucket_bytes))

    hashed = [col(n) for n, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    record = F.struct(*[col(n) for n in df.columns])
    keyed = df.select(F.xxhash64(F.lit(seed), *at, *hashed).alias("h"), record.alias("record"))
    keyed = keyed.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)).cast("int"))

    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)

    piled = (
        keyed.repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "h")
        .groupBy("bucket")
        .agg(F.collect_list("record").alias("pile"))
        .select("bucket", F.shuffle("pile", F.lit(seed)).alias("pile"))
    )
    placed = piled.join(offsets, "bucket").select("bucket", "start", F.posexplode("pile").alias("at", "record"))
    position = F.col("start") + F.col("at")
    return placed.select(
        "record",
        "bucket",
        position.alias("position"),
        F.pmod(position, F.lit(shards)).cast("int").alias("shard"),
    ).withColumn("slot", F.expr(f"position div {shards}"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes the records under path/shard=K, each file in slot order. Buckets stay where they are: no further exchange."""
    shuffled.sortWithinPartitions("shard", "slot").select("record.*", "shard").write.partitionBy("shard").parquet(path)
