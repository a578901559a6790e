"""Exact deduplication by a log-structured merge index of digests.

Entries (digest, best row, count) are flushed from memtables as runs sorted by digest. A run lies in slices, a file each, with a
Parquet Bloom filter on the digest for point lookups. Compaction merges up to `fan_in` runs at a time; of equal digests it keeps
the preferred row: the longest original text, then the smallest identifier. A digest with more than one row is a hit. The digests
of all hits make one filter of fixed size, which rows pass before they are verified or joined: what it does not know has no copy.
Hits receive byte verification: the normalised texts themselves are compared, and a digest that two texts share is resolved by
the texts.

Copies are folded map-side wherever they meet, so a group of copies, however large, never gathers in one task. Digests with
so many rows that one task would feel them are few, and are joined by broadcast. Only DataFrame expressions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, col, known_keys, may_be, partitions, without_spaces


#: A digest that has this share of all rows, or a greater one, is hot; there are 1,000 of them at most.
HOT_SHARE = 1 / 1000
#: Up to so many hits, some 100 bytes each in memory, Spark may choose to broadcast them; beyond, they are merged.
MOST_BROADCAST = 1 << 16


def _best() -> Column:
    """The preferred row of a group: most code points, then the smallest id, null ids last."""
    return F.min("best")


class DigestIndex:
    """Runs of (digest long, best struct<neg_len, no_id, id>, n long) in a scratch folder."""

    def __init__(self, spark: SparkSession, scratch: Scratch, rows: int, fan_in: int = 8, slice_rows: int = 1 << 19):
        self.spark, self.scratch, self.rows, self.fan_in, self.slice_rows = spark, scratch, rows, fan_in, slice_rows
        self.level, self.runs, self.like = 0, 0, None

    def _write(self, entries: DataFrame, runs: int) -> None:
        """Runs in slices of digests, so that a file is some slice_rows entries, whatever the size of a run."""
        slices = max(1, -(-self.rows // (runs * self.slice_rows)))
        slice_ = F.pmod(F.xxhash64(F.lit(2), "digest"), F.lit(slices)).cast("int").alias("slice")
        folded = entries.groupBy("run", slice_, "digest").agg(_best().alias("best"), F.sum("n").alias("n"))
        self.like = folded.select("digest", "best", "n", "run")
        options = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.slice_rows)}
        tasks = min(runs * slices, max(partitions(self.spark), runs * slices // 64))
        dealt = folded.repartition(tasks, "run", "slice").sortWithinPartitions("run", "digest").drop("slice")
        dealt.write.partitionBy("run").options(**options).parquet(self.scratch.path(f"level{self.level}"))
        self.runs = runs

    def flush(self, entries: DataFrame, memtables: int) -> None:
        """Level 0: one sorted run for each memtable. An entry's memtable is a hash of its id, so memtables are of equal size."""
        run = F.pmod(F.xxhash64("best.id", "digest"), F.lit(memtables)).cast("int")
        self._write(entries.withColumn("run", run), memtables)

    def compact(self) -> None:
        """Merges fan_in runs to one, level after level, until one run is left."""
        while self.runs > 1:
            old, merged = f"level{self.level}", -(-self.runs // self.fan_in)
            entries = self.entries().withColumn("run", F.expr(f"run div {self.fan_in}").cast("int"))
            self.level += 1
            self._write(entries, merged)
            self.scratch.drop(old)

    def entries(self) -> DataFrame:
        return self.scratch.read(f"level{self.level}", self.like)

    def lookup(self, digests: list[int]) -> DataFrame:
        """Point lookups: the pushed-down IN filter meets each file's Bloom filter and sorted pages."""
        return self.entries().where(F.col("digest").isin(digests))


def exact_dedup(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = without_spaces,
    digest: Callable[[Column], Column] = F.xxhash64,
    memtable_rows: int = 1 << 20,
    slice_rows: int = 1 << 19,
    fan_in: int = 8,
) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size long, kept boolean, text_sha256 (of the normalised text).

    Null texts count as empty, and empty texts are equal to one another. Rows with equal ids are rows of their own for
    group_size; a null id is preferred last. Where ids repeat, every row that has the kept id is marked as kept. Other
    columns of df are not looked at. An empty table gives an empty one. Long texts are read whole; only those that may have a
    copy are exchanged, one of each kind from a task. `digest` maps the normalised text to a long; any function gives right
    results. memtable_rows: rows of a memtable, however many memtables that makes.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    text = F.coalesce(col(text_col), F.lit(""))
    base = df.select(col(id_col).alias("id"), text.alias("text")).withColumn("norm", normalise(F.col("text")))
    base = base.withColumn("digest", digest(F.col("norm")).cast("long"))
    seen = scratch.write(
        base.select("id", "digest", F.char_length("text").alias("len"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "seen"
    )
    best = F.struct((-F.col("len")).alias("neg_len"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")).alias("best")
    rows = seen.count()
    index = DigestIndex(spark, scratch, rows, fan_in, slice_rows)
    index.flush(seen.select("digest", best, F.lit(1).cast("long").alias("n")), max(1, -(-rows // memtable_rows)))
    index.compact()

    hits = scratch.write(index.entries().where("n > 1").select("digest", "best", "n"), "hits")
    known = scratch.write(known_keys(hits, "digest"), "filter")
    alone = may_be(seen, known, "digest", "left_anti")  # has no copy: it need not meet the hits
    low_high = may_be(base, known, "digest").groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    verified = scratch.write(low_high.select("digest", (F.col("low") == F.col("high")).alias("same")), "verified")
    shared = verified.where("not same").select("digest")
    same = verified.where("same").select("digest")
    if hits.count() > MOST_BROADCAST:
        hits, same = hits.hint("merge"), same.hint("merge")
    hits = scratch.write(hits.join(same, "digest"), "sure")
    hits = hits if hits.count() <= MOST_BROADCAST else hits.hint("merge")
    out = _resolved(alone.select("*", F.lit(None).cast(dict(hits.dtypes)["best"]).alias("best"), F.lit(None).cast("long").alias("n")))
    if shared.isEmpty():
        return out.unionByName(_met(may_be(seen, known, "digest"), hits, rows))
    out = out.unionByName(_met(may_be(seen, known, "digest").join(shared, "digest", "left_anti"), hits, rows))
    mixed = base.join(shared, "digest", "left_semi").select(
        "id", "norm", F.char_length("text").alias("len"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    )
    by_text = mixed.select("norm", best).groupBy("norm").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
    return out.unionByName(_resolved(mixed.join(by_text, "norm")))


def _met(seen: DataFrame, hits: DataFrame, rows: int) -> DataFrame:
    """Rows with the hit of their digest, if there is one; hot digests by broadcast, the others by an exchange."""
    hot = F.broadcast(hits.where(F.col("n") >= F.greatest(F.lit(2), F.lit(rows * HOT_SHARE))))
    rest = hits.where(F.col("n") < F.greatest(F.lit(2), F.lit(rows * HOT_SHARE)))
    cold = seen.join(hot.select("digest"), "digest", "left_anti").join(rest, "digest", "left")
    return _resolved(seen.join(hot, "digest")).unionByName(_resolved(cold))


def _resolved(joined: DataFrame) -> DataFrame:
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id"))
    return joined.select("id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
