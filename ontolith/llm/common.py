"""Shared plumbing: scratch tables in the shared folder, workers that can import this package, and safe column access."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontolith.plans.scratch import Scratch, shared_folder

__all__ = ["SPACES", "Scratch", "col", "importable", "partitions", "known_keys", "may_be", "place", "shared_folder", "steady", "without_spaces"]

#: The six characters that count as white space in every text contract here.
SPACES = " \t\n\x0b\x0c\r"


def col(name: str) -> Column:
    """A top-level column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def importable(spark: SparkSession) -> None:
    """Lets Python workers started from now on import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_spaces(text: Column) -> Column:
    """The text without the characters of SPACES; null counts as empty. Six byte searches beat one regular expression."""
    out = F.coalesce(text, F.lit(""))
    for ch in SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def place(df: DataFrame) -> tuple[Column, Column] | None:
    """Of a Parquet table just read, a row's file (its name, without what differs from one write to the next) and place in that;
    None for other DataFrames."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return None
    at = df.metadataColumn("_metadata")
    try:
        df.select(at["row_index"])
    except AnalysisException:
        return None
    return F.regexp_replace(at["file_name"], "[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", ""), at["row_index"]


def steady(df: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple[Column, Column]]:
    """The rows with a place each that is the same whenever they are read, so that equal rows can be told apart. What is not
    a Parquet table just read is written first."""
    at = place(df)
    if at is None:
        df = scratch.write(df, "rows")
        at = place(df)
    return df, at


#: The filter of keys: so many bits of a key name a bitmap of 32,768 bits. At most 16 MB are broadcast, whatever the number of keys.
FILTER_BITS = 12


def known_keys(keys: DataFrame, key: str) -> DataFrame:
    """(part int, bits binary): a bitmap of the long `key` for each of 2^FILTER_BITS parts. Keys should be spread like hashes."""
    return keys.groupBy(_part(key).alias("part")).agg(F.bitmap_construct_agg(F.col(key).bitwiseAND(F.lit(32767))).alias("bits"))


def _part(key: str) -> Column:
    return F.shiftrightunsigned(F.col(key), 64 - FILTER_BITS).cast("int")


def may_be(df: DataFrame, known: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key the filter knows (left_semi: all that are known, and few others) or does not know (left_anti)."""
    own = F.col(key)
    byte = F.conv(F.hex(F.substring("bits", (own.bitwiseAND(F.lit(32767)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), own.bitwiseAND(F.lit(7)).cast("int") + 1)
    return df.join(F.broadcast(known), (_part(key) == F.col("part")) & (byte.bitwiseAND(bit) != 0), how)
