"""Providers of embeddings and completions.

The defaults are native expressions. Others are plain Python callables over batches; they run in Python workers with retries, and
a row whose attempts all fail is marked, not raised.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from . import vectors


@runtime_checkable
class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


@runtime_checkable
class AuditSink(Protocol):
    def emit(self, event: dict) -> None: ...


class TableSink:
    """An audit sink and event bus that keeps what it is given as rows; table() gives them as a DataFrame."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []

    def emit(self, event: dict) -> None:
        self.publish("audit", json.dumps(event, ensure_ascii=False, sort_keys=True).encode())

    def publish(self, topic: str, payload: bytes) -> None:
        self.rows.append((topic, payload.decode()))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *r) for k, r in enumerate(self.rows)], "ord long, topic string, payload string")


@runtime_checkable
class EventBus(Protocol):
    def publish(self, topic: str, payload: bytes) -> None: ...


@runtime_checkable
class EvalTarget(Protocol):
    def __call__(self, items: DataFrame) -> DataFrame: ...


def hashing_embedder(text):
    """The native embedding: a binary bag of hashed n-grams as a dense vector."""
    return vectors.dense(vectors.hashed_terms(text))


def embedded(df: DataFrame, text: str, embedder: Embedder, out: str = "vec") -> DataFrame:
    """df with the embeddings of a text column; a provider that returns another count of vectors is an error."""
    schema = StructType([*df.schema, StructField(out, ArrayType(DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = embedder.embed(batch[text].tolist())
            if len(got) != len(batch):
                raise ValueError(f"{len(got)} vectors for {len(batch)} texts")
            yield batch.assign(**{out: [[float(x) for x in v] for v in got]})

    return df.mapInPandas(run, schema)


def json_object(reply: str) -> bool:
    """Whether a reply holds a JSON object, from its first { to its last }."""
    try:
        return isinstance(json.loads(reply[reply.index("{") : reply.rindex("}") + 1]), dict)
    except ValueError:
        return False


def completed(df: DataFrame, prompt: str, completer: Completer, attempts: int = 2, valid: Callable[[str], bool] = json_object) -> DataFrame:
    """df with reply (null if no attempt gave a valid one) and warnings (the failed attempts). By default a reply must hold a
    JSON object, as extraction needs it."""
    schema = StructType([*df.schema, StructField("reply", StringType()), StructField("warnings", IntegerType())])

    def ask(text: str) -> tuple[str | None, int]:
        for k in range(attempts):
            try:
                if valid(reply := completer.complete(text)):
                    return reply, k
            except Exception:  # noqa: BLE001, S110 -- a failed attempt is counted
                pass
        return None, attempts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [ask(t) for t in batch[prompt]]
            yield batch.assign(reply=[r for r, _ in got], warnings=[w for _, w in got])

    return df.mapInPandas(run, schema)
