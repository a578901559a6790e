"""Mixture-controlled packing by deficit round-robin.

Documents are tokenised once and written. Each source is a queue; its documents stand in the order of a seeded hash of id, text
and place in the written table, which gives a document a virtual time: the share of its queue's allotment that is served before it. Virtual time is cut into
slices of bounded token count, and each slice is served by deficit round-robin: a window of `length` tokens credits every
queue with its target share; the queue with the largest deficit is served next, a document at a time, and what a document
takes beyond its credit is carried as a negative deficit into the next windows. The deficits a slice starts with follow
from the tokens each queue had before it (prefix sums), so they carry across partitions too. Windows are cut from the
resulting stream without gaps: only the last sequence is padded.

Rows that come in a mixed order can keep it (keep_order): queues then stand in that order, virtual time is the place in it,
and the target shares of a slice are those of the tokens that the order has there, so that no deficit is left at its end.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import Scratch, col, importable, partitions, place

#: The id after each document.
END = 1
#: Where cutting at blanks could cut inside a run of white space, which the pattern takes whole.
_RUNS = re.compile(r"\s \s|\s $")


class Tokenizer:
    """The ids of tokenizers with add_special_tokens=False, strings of special tokens in the text included, which are one id.

    For a byte-level BPE file the work is done word by word: a blank starts a new pre-token, so text is cut at blanks and the
    ids of each word are kept for its next occurrences. Texts in which a blank stands inside a run of white space are
    encoded whole, those that hold an added token by the file's own reader."""

    KEPT = 1 << 17

    def __init__(self, path: str):
        import json

        self.path, self.words, self.added, self.reader = path, {}, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = self._fast(spec)
        if not self.fast:
            self.whole = self.by_file
        size = len(spec["model"]["vocab"]) + len(spec.get("added_tokens") or ())
        #: Ids are unsigned little-endian integers of 16 bits, or 32 where the vocabulary may need them.
        self.code = "H" if size <= 1 << 16 and all(t["id"] < 1 << 16 for t in spec.get("added_tokens") or ()) else "I"

    def _fast(self, spec: dict) -> bool:
        """The same vocabulary and merge order as tiktoken ranks, read from the same file, if it is byte-level BPE."""
        import tiktoken

        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            return False
        if spec.get("normalizer") or spec["model"].get("ignore_merges"):
            return False
        to_byte = {c: b for b, c in _byte_letters().items()}
        added = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.whole = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        return True

    def by_file(self, text: str) -> list[int]:
        if self.reader is None:
            from tokenizers import Tokenizer as Reader

            self.reader = Reader.from_file(self.path)
        return self.reader.encode(text, add_special_tokens=False).ids

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def __call__(self, text: str) -> bytes:
        if not self.fast or self.added and self.added.search(text):
            return self.packed(self.by_file(text))
        if _RUNS.search(text):
            return self.packed(self.whole(text))
        first, *rest = text.split(" ")
        known = self.words
        if len(known) > self.KEPT:
            known.clear()
        try:
            parts = [known[w] for w in rest]
        except KeyError:
            for word in set(rest).difference(known):
                known[word] = self.packed(self.whole(" " + word))
            parts = [known[w] for w in rest]
        return self.packed(self.whole(first)) + b"".join(parts)


#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable ones as they are, the others, in order, from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One for each path in a process."""
    return _tokenizers.setdefault(path, None) or _tokenizers.__setitem__(path, Tokenizer(path)) or _tokenizers[path]


def tokenise(df: DataFrame, path: str, carried: list[str]) -> DataFrame:
    """The carried columns, ids binary (unsigned, 16 or 32 bits each) and n long, the end id included. `text` null: empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path)
        end, width = encode.packed([END]), struct.calcsize(f"<{encode.code}")
        for batch in batches:
            ids = [encode(t or "") + end for t in batch["text"]]
            yield batch[carried].assign(ids=ids, n=[len(x) // width for x in ids])

    schema = StructType([*df.select(*carried).schema, StructField("ids", BinaryType()), StructField("n", LongType())])
    return df.select(*carried, "text").mapInPandas(run, schema)


def serve(sizes: np.ndarray, queues: np.ndarray, shares: dict[int, float], deficits: dict[int, float], length: int, room: int) -> np.ndarray:
    """The order in which deficit round-robin serves the documents of a slice.

    sizes and queues: tokens and queue of each document, in queue order. deficits: what each queue is owed at the start.
    room: the tokens left in the window that the slice begins in. Deficits may be negative.
    """
    waiting = {q: np.flatnonzero(queues == q) for q in np.unique(queues)}
    at = dict.fromkeys(waiting, 0)
    owed = {q: deficits.get(q, 0.0) + shares.get(q, 0.0) * room for q in waiting}
    left, out = float(room), []
    while len(out) < len(sizes):
        live = [q for q in waiting if at[q] < len(waiting[q])]
        while left <= 0:  # next windows
            for q in live:
                owed[q] += shares.get(q, 0.0) * length
            left += length
        for q in sorted(live, key=lambda q: (-owed[q], q)):  # one round
            while at[q] < len(waiting[q]) and left > 0 and owed[q] > 0:
                k = waiting[q][at[q]]
                at[q] += 1
                out.append(k)
                owed[q] -= sizes[k]
                left -= sizes[k]
            if left <= 0:
                break
        else:
            if left > 0 and (live := [q for q in live if at[q] < len(waiting[q])]):
                # credit is used up but the window is not full: queues that have run out leave their share to the others
                q = max(live, key=lambda q: (owed[q], -q))
                k = waiting[q][at[q]]
                at[q] += 1
                out.append(k)
                owed[q] -= sizes[k]
                left -= sizes[k]
    return np.array(out, dtype=np.int64)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    df: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: dict[str, float] | None = None,
    length: int = 2048, slice_tokens: int = 1 << 22, seed: int = 11, keep_order: bool = False,
) -> DataFrame:
    """One row for each piece: id, source, start, length, ids_crc32 (of the little-endian unsigned 32-bit ids), doc_tokens
    (with the end id), sequence_id, offset (both gapless from 0), ids (of the piece,
    little-endian and unsigned, 16 bits each, or 32 where the vocabulary has more than 65,536).

    weights: target token share of each source (others get the least of them); by default each source's share of all
    tokens, so that all queues run out together. A source that runs out earlier leaves its share to the others. A null
    text is empty: one piece with the end id. A null source is a queue of its own. Rows with equal ids are packed each for
    itself. An empty table gives an empty one. A long text is one row while its slice is packed (a slice of slice_tokens is
    exceeded by one document at most) and is cut at every window. Other columns of df are not looked at.

    keep_order: the order of df's rows (see ordered()) decides instead of weights and the seeded hash.
    """
    if keep_order and weights:
        raise ValueError("the order of the rows decides, or weights do")
    spark = df.sparkSession
    importable(spark)
    scratch = Scratch(spark, "packing")
    queue = F.xxhash64(F.lit(3), "source").alias("queue")
    named = [col(id_col).alias("id"), col(source_col).cast("string").alias("source"), col(text_col).alias("text")]
    if keep_order:
        part, row = ordered(df)
        narrow, carried = df.select(*named, part.alias("part"), row.alias("row")).select("*", queue), ["id", "source", "queue", "part", "row"]
    else:
        narrow, carried = df.select(*named).select("*", queue, F.xxhash64(F.lit(seed), "id", "text").alias("h")), ["id", "source", "queue", "h"]
    tokens = scratch.write(tokenise(narrow, tokenizer_path, carried), "tokens", compression="zstd")
    if not keep_order:  # rows that are equal in id and text are told apart by their places, so that they spread over virtual time
        spread = F.xxhash64("h", *place(tokens))
        tokens = tokens.withColumn("u", (spread.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)).drop("h")

    queues = tokens.groupBy("queue", "source").agg(F.sum("n").alias("tokens"))
    if weights:
        weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("source", F.lit("")))
        queues = queues.withColumn("weight", F.coalesce(weight, F.lit(min(weights.values()))))
    else:
        queues = queues.withColumn("weight", F.col("tokens").cast("double"))
    queues = scratch.write(queues, "queues")
    total, weight, longest = queues.agg(F.sum("tokens"), F.sum("weight"), F.max(F.col("tokens") / F.col("weight"))).first()
    total = total or 0
    slices = max(1, math.ceil(total / slice_tokens), min(4 * partitions(spark), total // ((8 if keep_order else 64) * length)))
    if keep_order:
        parts = scratch.write(tokens.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("tokens")), "parts")
        first = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        starts = parts.select("part", F.coalesce(first, F.lit(0)).alias("first"), (F.col("tokens") / F.col("rows")).alias("mean"))
        # The tokens before a row, as if those of its part were dealt evenly: a document has one at least, so no two rows are equal.
        times = tokens.join(_small(starts, parts), "part").withColumn("u", F.col("first") + F.col("row") * F.col("mean"))
        cut: Column = F.least(F.floor(F.col("u") * F.lit(slices / max(1, total))), F.lit(slices - 1)).cast("int")
        share = F.col("own") / F.sum("own").over(Window.partitionBy("slice"))
        sums = scratch.write(times.withColumn("slice", cut).groupBy("slice", "queue").agg(F.sum("n").alias("own")).withColumn("share", share), "sums")
    else:
        # Virtual time runs from 0 to 1; a queue whose tokens are few for its weight is through earlier.
        stretch = queues.select("queue", (F.col("tokens") / F.col("weight") / F.lit(longest or 1.0)).alias("stretch"), (F.col("weight") / F.lit(weight or 1.0)).alias("share"))
        times = tokens.join(_small(stretch, queues), "queue")
        cut = F.least(F.floor(F.col("u") * F.col("stretch") * slices), F.lit(slices - 1)).cast("int")
        sums = scratch.write(times.withColumn("slice", cut).groupBy("slice", "queue").agg(F.sum("n").alias("own"), F.first("share").alias("share")), "sums")

    before = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.groupBy("slice").agg(F.sum("own").alias("all"))
    base = base.select("slice", F.coalesce(F.sum("all").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    carry = sums.select("slice", "queue", "share", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("had")).join(base, "slice")
    owed = F.lit(0.0) if keep_order else F.col("share") * F.col("base") - F.col("had")
    carry = carry.groupBy("slice").agg(F.first("base").alias("base"), F.collect_list(F.struct("queue", "share", owed.alias("owed"))).alias("queues"))

    def run(docs: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["u", "id"], kind="stable", na_position="last").reset_index(drop=True)
        base = int(start["base"].iloc[0])
        shares = {x["queue"]: x["share"] for x in start["queues"].iloc[0]}
        owed = {x["queue"]: x["owed"] for x in start["queues"].iloc[0]}
        turn = serve(docs["n"].to_numpy(), docs["queue"].to_numpy(), shares, owed, length, length - base % length)
        return _pieces(docs.iloc[turn], base, length)

    names = ", ".join(f"{n} {k}" for n, k in narrow.select("id", "source").dtypes)
    keyed = times.withColumn("slice", cut).select("slice", "id", "source", "u", "queue", "n", "ids")
    return keyed.groupBy("slice").cogroup(carry.groupBy("slice")).applyInPandas(run, f"{names}, {PIECES}")


def ordered(df: DataFrame) -> tuple[Column, Column]:
    """Where each row stands: its part (a string, in order) and its row in that, from 0. Of a table just read the parts are
    its files, by the partition that wrote them; tasks read files in any order. Otherwise they are the partitions of df."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        at = df.metadataColumn("_metadata")
        number = F.regexp_extract(at["file_name"], r"^part-(\d+)", 1)
        return F.concat(F.lpad(number, 10, "0"), at["file_name"]), at["row_index"]
    at = F.monotonically_increasing_id()
    return F.lpad(F.shiftright(at, 33).cast("string"), 10, "0"), at.bitwiseAND(F.lit((1 << 33) - 1))


def _small(df: DataFrame, like: DataFrame) -> DataFrame:
    """Broadcast a table of sources only if it is small."""
    return F.broadcast(df) if like.count() <= 100_000 else df


def _pieces(docs: pd.DataFrame, base: int, length: int) -> pd.DataFrame:
    """Cuts the documents, in their order, at every multiple of `length` tokens from `base` on."""
    out, at = [], base
    for i, source, n, raw in zip(docs["id"], docs["source"], docs["n"], docs["ids"], strict=True):
        ids, start = np.frombuffer(raw, dtype=f"<u{len(raw) // n}"), 0
        while start < n:
            size = min(n - start, length - at % length)
            own = ids[start : start + size]
            out.append((i, source, start, size, zlib.crc32(own.astype("<u4").tobytes()), n, at // length, at % length, own.tobytes()))
            start, at = start + size, at + size
    return pd.DataFrame(out, columns=["id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
