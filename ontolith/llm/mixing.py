"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows. Virtual time runs in slots of one block. With target weight w (the weights add up to
one), block k of a source is released at floor(k / w) and due at ceil((k + 1) / w); among the released blocks the one with
the earliest deadline goes next. Each source then stands less than one block from w times the virtual time. Slots for which
no block is released, because sources have run out, are left out; the others keep their proportions to one another.

Weights are integers. Whenever virtual time reaches a multiple of their sum, the period, every source stands at exactly its
share: all blocks due are done and no block is released earlier. So periods are scheduled each for itself, by one task each, and
the slot that a period begins with is the number of blocks before it. A task holds the sources that are not through yet and the
blocks of one period, however many rows there are. Rows find their slot by a join.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, importable, partitions, steady

#: Default weights are shares in so many parts; a source has one at least.
PARTS = 1 << 16


def pfair(supply: list[tuple[str, int, int]], total: int, period: int) -> Iterator[tuple[str, int, int, int]]:
    """supply: (source, blocks, integer weight > 0); total: the sum of all weights, those of sources not in supply included.
    Yields (source, block, release, deadline) of the blocks of a period in the order of their slots."""
    future = [(period * total, r, period * w) for r, (_, blocks, w) in enumerate(supply) if period * w < blocks]  # (release, source, block)
    heapq.heapify(future)
    ready: list[tuple[int, int, int]] = []  # (deadline, source, block)
    now = period * total
    while future or ready:
        if not ready and future[0][0] > now:
            now = future[0][0]
        while future and future[0][0] <= now:
            _, r, k = heapq.heappop(future)
            heapq.heappush(ready, (-(-(k + 1) * total // supply[r][2]), r, k))
        deadline, r, k = heapq.heappop(ready)
        source, blocks, weight = supply[r]
        yield source, k, k * total // weight, deadline
        now, k = now + 1, k + 1
        if k < min(blocks, (period + 1) * weight):
            heapq.heappush(future, (k * total // weight, r, k))


def mix(
    df: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, int] | None = None, power: float = 0.5,
    block_rows: int = 16, seed: int = 23,
) -> DataFrame:
    """All rows of df once, with their place in the mix: record (a struct of all columns of df), weight long, block long (in
    its source, from 0), release long, deadline long, slot long, place long (in the block, from 0), slots long (of the whole
    schedule).

    weights: positive integer target weights by source; a source that is not named gets the least. By default a source's
    weight is its share of the sum of all counts of rows to the given power, in 65,536 parts, and 1 at least. Within a source,
    rows stand in the order of a seeded hash of the id and the row's place in the files of df (of a table that is written
    first, if df is not a Parquet table just read), so that equal rows and null ids are spread like others. A block has
    block_rows rows; a source's last block may have fewer. A null source is a source of its own. Rows with equal ids are rows
    of their own. An empty table gives an empty one. Texts are carried, however long, and not looked at.
    """
    spark = df.sparkSession
    importable(spark)
    scratch = Scratch(spark, "mixing")
    df, at = steady(df, scratch)
    record = F.struct(*[col(c) for c in df.columns])
    name = F.coalesce(F.concat(F.lit("="), col(source_col).cast("string")), F.lit(""))
    h = F.xxhash64(F.lit(seed), col(id_col), *at)
    # A row's rank in its source, without gathering a source in one task: the counts of the cells of the hash give the rank that
    # a cell begins with, and a window ranks inside the cell. There are as many cells as keep the rows of one to a few thousand.
    rows = df.count()
    cells = max(4096, -(-rows // 1024))
    base = df.select(name.alias("source"), F.pmod(F.shiftright(h, 8), F.lit(cells)).alias("cell"), h.alias("h"), record.alias("record"))
    counts = scratch.write(base.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = counts.groupBy("source").agg(F.sum("n").alias("rows"))
    if weights:
        named = F.element_at(F.create_map(*[F.lit(x) for s, w in weights.items() for x in (f"={s}", w)]), F.col("source"))
        weight = F.coalesce(named, F.lit(min(weights.values())))
    else:
        whole = sources.agg(F.sum(F.pow("rows", F.lit(power)))).first()[0] or 1.0
        weight = F.greatest(F.lit(1), F.round(F.pow("rows", F.lit(power)) / F.lit(whole) * PARTS))
    sources = sources.select("source", F.ceil(F.col("rows") / F.lit(block_rows)).cast("long").alias("blocks"), weight.cast("long").alias("weight"))
    sources = scratch.write(sources, "sources")
    total, blocks = sources.agg(F.sum("weight"), F.sum("blocks")).first()

    def schedule(pdf: pd.DataFrame) -> pd.DataFrame:
        period = int(pdf["period"].iloc[0])
        supply = sorted((s, int(b), int(w)) for s, b, w in zip(pdf["source"], pdf["blocks"], pdf["weight"], strict=True))
        weight_of = {s: w for s, _, w in supply}
        out = [(period, k, source, block, weight_of[source], release, deadline) for k, (source, block, release, deadline) in enumerate(pfair(supply, total, period))]
        return pd.DataFrame(out, columns=["period", "at", "source", "block", "weight", "release", "deadline"])

    in_periods = sources.select("*", F.explode(F.expr("sequence(0, (blocks - 1) div weight)")).alias("period"))
    slots = in_periods.groupBy("period").applyInPandas(schedule, "period long, at long, source string, block long, weight long, release long, deadline long")
    slots = scratch.write(slots, "slots")
    # One row for each period, of 65,536 blocks or more by default: one task can add them up.
    sizes = slots.groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    begins = sizes.select("period", (F.sum("n").over(Window.orderBy("period")) - F.col("n")).alias("begin"))
    slots = slots.join(begins, "period").select("source", "block", "weight", "release", "deadline", (F.col("begin") + F.col("at")).alias("slot"))

    so_far = Window.partitionBy("source").orderBy("cell")
    starts = scratch.write(counts.select("source", "cell", (F.sum("n").over(so_far) - F.col("n")).alias("before")), "starts")
    in_cell = Window.partitionBy("source", "cell").orderBy("h", "record" if _ordered(df) else "h")
    ranked = base.join(starts, ["source", "cell"]).withColumn("rank", F.col("before") + F.row_number().over(in_cell) - 1)
    ranked = ranked.select("source", F.expr(f"rank div {block_rows}").alias("block"), F.expr(f"rank % {block_rows}").alias("place"), "record")
    placed = ranked.join(slots, ["source", "block"]).withColumn("slots", F.lit(blocks or 0).cast("long"))
    return placed.select("record", "weight", "block", "release", "deadline", "slot", "place", "slots")


def in_order(mixed: DataFrame) -> DataFrame:
    """The records in mixed order: partition after partition, and sorted in each."""
    parts = partitions(mixed.sparkSession)
    part = F.expr(f"cast(slot * {parts} div slots as int)")
    return mixed.repartitionById(parts, part).sortWithinPartitions("slot", "place").select("record.*")


def _ordered(df: DataFrame) -> bool:
    """Whether rows can be compared as a whole, to put rows with equal ids in a fixed order."""
    return not any("map<" in kind or "variant" in kind for _, kind in df.dtypes)
