"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next one's docs.

What holds for every stage: an empty table gives an empty one; null and empty texts are documents like others; extra columns
are carried by all stages but the last, whatever their names; texts are worked on whole, however long; rows that are equal, or
share an id, are rows of their own but where a stage says otherwise. The columns doc_id (an integer), text and source are needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ontolith.llm import line_dedup, minhash, mixing, packing, quality
from ontolith.llm.common import Scratch, col
from ontolith.llm.queries import table, tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored alike, as one empty passage; equal texts have
    equal scores, so ties stay or go together; rows without an id are scored too. Without labels of both kinds in
    sf_dir every document has the share of label 1 for a score."""
    return quality.quality_score(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("record.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; documents stay, with what is left of their text, which may be empty. Of equal lines
    those in the smallest id stay; rows that share an id are one document; null texts stay null; rows without an id keep
    all their lines and take none from others."""
    return line_dedup.line_dedup(docs).select("record.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, with all rows of that id. Documents
    without text are alike to nothing and stay; so do rows without an id."""
    gone = Scratch(spark, "pipeline").write(minhash.near_dedup(docs).where("not kept").select("id").distinct(), "gone")
    return docs.join(gone, col("doc_id") == gone["id"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows in the order of the mix. A null source is a source of its own; equal rows and null ids have places
    of their own."""
    return mixing.in_order(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids; the order of the mix decides which come together. A document without text is
    one piece, its end id; rows that share an id are packed each for itself."""
    return packing.pack(docs, tokenizer_path=tokenizer_path(), keep_order=True).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_shared_lines),
    ("minhash near-dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A learned classifier and seeded orders are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
