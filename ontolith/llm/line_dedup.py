"""Removal of lines that documents share, by a sharded minimal perfect hash.

The distinct hashes of all lines, with the count of documents and the smallest document of each, are dealt to shards. For each
shard a minimal perfect hash maps n hashes to 0..n-1 and indexes three arrays: fingerprints of 32 bits, counts of 8 bits (255
stands for more) and smallest documents. Documents do not join lines: their line hashes go to the shard and probe its arrays; those
whose count is 2 or more and whose smallest document is another one come back as lines to drop. A shard that many lines probe,
because a line stands in very many documents, is sent to as many places as keep the lines of one place to `probe_rows`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, col, importable

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STRIP = SPACES.encode()


def line_key(line: bytes) -> bytes:
    return line.strip(_STRIP).translate(_LOWER)


def code_points(raw: bytes) -> int:
    """Code points of UTF-8."""
    return len(raw) - sum(1 for b in raw if b & 0xC0 == 0x80)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hashed(line: bytes, least: int) -> tuple[int, int] | None:
    """The two halves of the key's 128-bit hash, None if the key is too short to count."""
    key = line_key(line)
    if len(key) < least or len(key) < 4 * least and code_points(key) < least:
        return None
    x = xxhash.xxh3_128_intdigest(key)
    return _signed(x >> 64), _signed(x & (1 << 64) - 1)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit finaliser over unsigned longs."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by levels: a level is a field of bits, two for each key left; keys that have a bit to themselves set
    it, the others go on to the next level. A key's place is the number of bits set before its own."""

    def __init__(self, keys: np.ndarray):
        """keys: distinct unsigned longs."""
        left, fields = np.asarray(keys, dtype=np.uint64), []
        while len(left):
            at = self._at(left, len(fields), 2 * len(left))
            hits = np.bincount(at, minlength=2 * len(left))
            fields.append(hits == 1)
            left = left[hits[at] != 1]
        self._set(fields)

    def _set(self, fields: list[np.ndarray]) -> None:
        self.fields, self.ranks, base = fields, [], 0
        for bits in fields:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())

    def dump(self) -> tuple[bytes, bytes]:
        """The sizes of the fields and their bits."""
        return np.array([len(b) for b in self.fields], dtype=np.int64).tobytes(), b"".join(np.packbits(b).tobytes() for b in self.fields)

    @classmethod
    def load(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        out, at, fields = cls(np.empty(0, dtype=np.uint64)), 0, []
        for size in np.frombuffer(sizes, dtype=np.int64).tolist():
            fields.append(np.unpackbits(np.frombuffer(bits, dtype=np.uint8, count=-(-size // 8), offset=at), count=size).astype(bool))
            at += -(-size // 8)
        out._set(fields)
        return out

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (_mix(keys, level + 1) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, 0..n-1; of a key that is not in the set, any place."""
        left = np.asarray(keys, dtype=np.uint64)
        out, todo = np.zeros(len(left), dtype=np.int64), np.arange(len(left))
        for level, (bits, ranks) in enumerate(zip(self.fields, self.ranks, strict=True)):
            at = self._at(left[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out


SHARD = "shard int, seed int, probes long, sizes binary, bits binary, fingerprints binary, counts binary, firsts binary"


def _keys(high: np.ndarray, low: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of both halves of a hash."""
    return high.astype(np.int64).view(np.uint64) ^ _mix(low.astype(np.int64).view(np.uint64), seed)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one shard, from its rows (shard, high, low, lines, first, last)."""
    high, low, seed = pdf["high"].to_numpy(), pdf["low"].to_numpy(), 1000
    while len(np.unique(keys := _keys(high, low, seed))) < len(keys):
        seed += 1
    ph = PerfectHash(keys)
    at = ph(keys)
    several = pdf["last"].to_numpy() > pdf["first"].to_numpy()
    columns = {"fingerprints": low.astype(np.int64).astype(np.uint32), "counts": np.where(several, np.minimum(pdf["lines"], 255), 1).astype(np.uint8), "firsts": pdf["first"].to_numpy(np.int64)}
    for name, values in columns.items():
        columns[name] = np.zeros(len(pdf), dtype=values.dtype)
        columns[name][at] = values
    sizes, bits = ph.dump()
    arrays = {name: [values.tobytes()] for name, values in columns.items()}
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [seed], "probes": [int(pdf["lines"].sum())], "sizes": [sizes], "bits": [bits], **arrays})


def _probe(lines: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
    """The (id, high, low) of lines to drop: found in the shard's arrays, with a smaller document."""
    none = lines[["id", "high", "low"]].iloc[:0]
    if not len(lines) or not len(shards):
        return none
    s, low = shards.iloc[0], lines["low"].to_numpy(np.int64)
    at = PerfectHash.load(s["sizes"], s["bits"])(_keys(lines["high"].to_numpy(), low, int(s["seed"])))
    known = np.frombuffer(s["fingerprints"], dtype=np.uint32)[at] == low.astype(np.uint32)
    gone = known & (np.frombuffer(s["counts"], dtype=np.uint8)[at] >= 2) & (np.frombuffer(s["firsts"], dtype=np.int64)[at] < lines["id"].to_numpy(np.int64))
    return lines.loc[gone, ["id", "high", "low"]]


#: Up to this many shards (16 bytes each) the table of their places is broadcast.
BROADCAST_SHARDS = 1 << 20


def line_dedup(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, shard_lines: int = 1 << 17, probe_rows: int = 1 << 18
) -> DataFrame:
    """The columns of df with the text cleaned, in a struct `record`, and n_lines long, n_dropped long.

    Lines are what \\n separates; a key is the line stripped of white space, with A-Z lower-cased. A key of at least `least`
    code points that stands in two documents or more loses all lines but those of the smallest document id that has it.
    Null and empty texts are one empty line; a null text stays null in the record. Rows with a null id keep all lines and
    count for nobody; rows with equal ids are one document. The id must be an integer. An empty table gives an empty one. Of a
    long text only the hashes of its distinct lines are kept, beside the text itself. shard_lines: lines of a shard on
    average; probe_rows: lines that probe one copy of a shard, on average.
    """
    spark = df.sparkSession
    importable(spark)
    scratch = Scratch(spark, "line-dedup")
    narrow = df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).where("id is not null and text is not null")

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, high, low = [], [], []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                found = {h for line in t.encode("utf-8", "surrogatepass").split(b"\n") if (h := hashed(line, least))}
                ids += [i] * len(found)
                high += [h for h, _ in found]
                low += [x for _, x in found]
            yield pd.DataFrame({"id": np.array(ids, np.int64), "high": np.array(high, np.int64), "low": np.array(low, np.int64)})

    lines = scratch.write(narrow.mapInPandas(hashes, "id long, high long, low long"), "lines")
    shards = max(1, -(-lines.count() // shard_lines))
    shard = F.pmod(F.xxhash64("high", "low"), F.lit(shards)).cast("int").alias("shard")
    counted = lines.groupBy(shard, "high", "low").agg(F.count(F.lit(1)).alias("lines"), F.min("id").alias("first"), F.max("id").alias("last"))
    arrays = scratch.write(counted.groupBy("shard").applyInPandas(_build, SHARD), "arrays")

    copies = arrays.select("shard", F.ceil(F.col("probes") / F.lit(probe_rows)).cast("int").alias("copies"))
    if shards <= BROADCAST_SHARDS:
        copies = F.broadcast(copies)
    routed = lines.select(shard, "id", "high", "low").join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64(F.lit(7), "id"), "copies").cast("int"))
    placed = arrays.select("*", F.explode(F.expr(f"sequence(0, cast(ceil(probes / {probe_rows}) as int) - 1)")).alias("copy"))
    placed = placed.toDF(*placed.columns)  # columns of its own: both sides come from the same table
    drops = (
        routed.groupBy("shard", "copy")
        .cogroup(placed.groupBy("shard", "copy"))
        .applyInPandas(_probe, "id long, high long, low long")
        .groupBy("id")
        .agg(F.collect_set(F.struct("high", "low")).alias("drops"))
    )
    record = F.struct(*[col(c) for c in df.columns])
    base = df.select(record.alias("record"), col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    halves = [F.col("drops")[h].alias(h) for h in ("high", "low")]
    cut = _cutter(least)("text", "high", "low").alias("cut")
    cleaned = base.join(drops, "id", "left").select("record", "text", *halves).select("record", cut)
    fields = [(F.col("cut.text") if c == text_col else F.col("record")[c]).alias(c) for c in df.columns]
    return cleaned.select(F.struct(*fields).alias("record"), "cut.n_lines", "cut.n_dropped")


def _cutter(least: int):
    """(text, high halves, low halves of the lines to drop) -> the text that is left and the counts."""

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cut(text: pd.Series, high: pd.Series, low: pd.Series) -> pd.DataFrame:
        out = []
        for t, hs, ls in zip(text, high, low, strict=True):
            if t is None or hs is None:
                out.append((t, 1 if t is None else t.count("\n") + 1, 0))
                continue
            drops = set(zip(hs.tolist(), ls.tolist(), strict=True))
            lines = t.encode("utf-8", "surrogatepass").split(b"\n")
            kept = [line for line in lines if hashed(line, least) not in drops]
            out.append((b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return cut
