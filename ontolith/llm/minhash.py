"""Near-duplicates by MinHash.

A document's set of word shingles gives `bands * rows` minima of universal hash functions. Documents whose minima agree in a
whole band meet in a bucket. Candidates are checked by their signatures (set sizes, one bit of each minimum, and the parities
of the sets' parts, which differ in no more places than the sets do in shingles), then confirmed on the full sets; confirmed links are joined into components by alternating large-star and small-star.

With 4 rows and 32 bands, two sets of similarity 0.8 meet in no band with probability 5e-8, and the signature check, at more
than seven standard deviations, adds nothing to that.

No bucket is expanded into pairs of rows. Documents with equal sets are one class with one representative. The members of a
bucket go with its smallest member, the center; all members of a center's buckets are a group. The center is compared with
its group, the links found are joined into components, and then only members outside the group's largest component are
compared with the rest of the group: first with the few whose signatures are nearest, which joins most of them to the others,
and only those still outside with all. Pairs inside one component need no comparing, so no link that would change a component
is lost. Comparing is done in blocks of bounded size, twice: first sizes, signature bits and parities only, then the full sets of those
documents that have a partner left, in bins by bytes. Of the links that a bin finds only a spanning forest leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontolith.operators.components import components

from .common import Scratch, col, importable, known_keys, may_be, partitions

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `size` words; with fewer words, of the whole sequence."""
    # bytes.split() without arguments splits at exactly the six ASCII white-space characters
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    if len(tokens) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], dtype=np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), dtype=np.uint64)
    n = len(w) - size + 1
    h = w[:n].copy()
    for k in range(1, size):
        h = h * _P + w[k : k + n]
    h = np.sort(_mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


class Family:
    """Universal hash functions x -> (a x + b) mod 2^32, a odd, over 32 bits of the shingles' hashes; the high bits decide the
    minima. 32-bit products are what processors multiply many of at a time."""

    def __init__(self, bands: int, rows: int, seed: int):
        draw = np.random.default_rng(seed).integers(0, 1 << 32, size=(2, bands * rows), dtype=np.uint64).astype(np.uint32)
        self.bands, self.rows = bands, rows
        self.a, self.b = (draw[0] | np.uint32(1))[:, None], draw[1][:, None]
        self.salts = np.arange(1, bands * rows + 1, dtype=np.uint64) * _P
        self.places = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def minima(self, x: np.ndarray) -> np.ndarray:
        x = (x >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.bands * self.rows, (1 << 32) - 1, dtype=np.uint32)
        for k in range(0, len(x), 512):
            h = self.a * x[None, k : k + 512]
            h += self.b
            np.minimum(out, h.min(axis=1), out=out)
        return _mix(out.astype(np.uint64) + self.salts)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One long for each row of minima and band."""
        m = minima.reshape(len(minima), self.bands, self.rows)
        h = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), m.shape[:2])
        for r in range(self.rows):
            h = _mix(h * _P + m[:, :, r])
        return h.view(np.int64)

    def bits(self, minima: np.ndarray) -> np.ndarray:
        """One bit of each minimum, in whole 64-bit words for each row."""
        one = np.pad(minima >> np.uint64(63), ((0, 0), (0, -minima.shape[1] % 64)))
        return (one.reshape(len(one), -1, 64) * self.places).sum(axis=2, dtype=np.uint64)


#: A set's shingles are dealt to so many parts by hash; whether their number in each is odd is one bit.
PARTS = 1024


def parities(x: np.ndarray) -> bytes:
    """One bit for each part of the set. The parities of two sets differ in at most as many bits as one set only has shingles."""
    return np.packbits(np.bincount((x % np.uint64(PARTS)).astype(np.int64), minlength=PARTS) & 1).tobytes()


def signatures(df: DataFrame, size: int, family: Family) -> DataFrame:
    """id, n int, high long, low long (a 128-bit hash of the set), keys array<long>, bits binary, parity binary."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            minima = np.empty((len(batch), family.bands * family.rows), dtype=np.uint64)
            sizes, digests, odd = [], [], []
            for k, text in enumerate(batch["text"]):
                x = shingles(text, size)
                minima[k] = family.minima(x)
                sizes.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                odd.append(parities(x))
            halves = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            bits = [x.tobytes() for x in family.bits(minima)]
            yield pd.DataFrame({"id": batch["id"], "n": np.array(sizes, np.int32), "high": halves[:, 0], "low": halves[:, 1], "keys": list(family.keys(minima)), "bits": bits, "parity": odd})

    return df.mapInPandas(sign, "id long, n int, high long, low long, keys array<long>, bits binary, parity binary")


#: Documents of one side in a block.
BLOCK = 512
#: About so many rows of small blocks go to one call that compares bits; so many pairs, and bytes of sets, to one that compares sets.
BIN, BIN_PAIRS, BIN_BYTES = 2000, 1000, 1 << 20
#: Members outside the largest component of a group are compared with so many of each block, nearest first; in the last round with all.
NEAREST = (4, None)


class Signed(NamedTuple):
    """Documents of one side of a block, by what their signatures say."""

    id: np.ndarray
    component: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    parity: np.ndarray

    @staticmethod
    def blocks(pdf: pd.DataFrame) -> dict[tuple, Signed]:
        """The sides of each block (g, x, y) in a bin."""
        if not len(pdf):
            return {}
        words = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint64).reshape(len(pdf), -1) for c in ("bits", "parity"))
        columns = (*(pdf[c].to_numpy(np.int64) for c in ("id", "component", "n")), *words)
        return {key: Signed(*(c[at] for c in columns)) for key, at in pdf.groupby(["g", "x", "y"]).indices.items()}


class Compared:
    """What two documents must agree in: signatures first, then the full sets."""

    def __init__(self, family: Family, size: int, percent: int):
        self.size, self.percent = size, percent
        # Bits of sets of similarity s agree with probability (1 + s) / 2; eight standard deviations are allowed for.
        k, p = family.bands * family.rows, (1 + percent / 100) / 2
        self.most_differ = k - int(k * p - 8 * (k * p * (1 - p)) ** 0.5)

    def chances(self, asked: Signed, members: Signed, nearest: int | None = None) -> list[tuple[int, int]]:
        """Pairs (asked, member) of ids that may be linked, of different components; of each asked, all or the nearest by signature."""
        out = []
        for i, c, m, own, odd in zip(asked.id.tolist(), asked.component.tolist(), asked.n.tolist(), asked.bits, asked.parity, strict=True):
            sizes = 100 * np.minimum(members.n, m) >= self.percent * np.maximum(members.n, m)
            differ = np.bitwise_count(members.bits ^ own).sum(axis=1)
            at = np.flatnonzero(sizes & (members.component != c) & (members.id != i) & (differ <= self.most_differ))
            # linked sets of n and m shingles have at most (100 - percent) / (100 + percent) of n + m in one only
            apart = np.bitwise_count(members.parity[at] ^ odd).sum(axis=1, dtype=np.int64)
            near = (100 + self.percent) * apart <= (100 - self.percent) * (members.n[at] + m)
            at, apart = at[near], apart[near]
            if nearest is not None and len(at) > nearest:
                at = at[np.argpartition(differ[at] + apart, nearest - 1)[:nearest]]
            out += [(i, j) for j in members.id[at].tolist()]
        return out

    def alike(self, p: np.ndarray, q: np.ndarray) -> bool:
        both = np.concatenate([p, q])
        both.sort(kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common > 0 and 100 * common >= self.percent * (len(both) - common)

    def links(self, pairs: np.ndarray, texts: dict[int, list[str]]) -> np.ndarray:
        """The pairs of ids that are linked, by any of their texts, a spanning forest of them; sets are made once for each text.
        Pairs that the links found before have joined already are not compared."""
        sets: dict[int, list[np.ndarray]] = {}
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def made(i: int) -> list[np.ndarray]:
            if i not in sets:
                sets[i] = [shingles(t, self.size) for t in texts[i]]
            return sets[i]

        kept = []
        for a, b in pairs.tolist():
            if (x := root(a)) == (y := root(b)):
                continue
            if any(self.alike(p, q) for p in made(a) for q in made(b)):
                parent[max(x, y)] = min(x, y)
                kept.append((a, b))
        return np.array(kept, dtype=np.int64).reshape(-1, 2)


def _confirm(asked: DataFrame, members: DataFrame, marks: DataFrame, texts: DataFrame, compared: Compared, scratch: Scratch, name: str, nearest: int | None = None) -> DataFrame:
    """The links (a, b) between documents asked for and members of their group (nearest: the so many nearest of each block only); both are (g, id, component). Those asked for
    and the members of a group are dealt to blocks by a hash; each pair of blocks is compared by itself, several small ones in a
    call. Blocks carry 32 bytes and the parities of a document; texts go only where a partner is left."""
    count = lambda df, c: df.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(c))
    blocks = scratch.write(count(asked, "x").join(count(members, "y"), "g"), f"{name}-blocks")
    total = blocks.join(asked.unionByName(members).groupBy("g").agg(F.count(F.lit(1)).alias("c")), "g").agg(F.sum(F.col("c") * F.greatest("x", "y"))).first()[0]
    bins = max(partitions(marks.sparkSession), -(-(total or 0) // BIN))

    def dealt(df: DataFrame, own_blocks: str, other: str) -> DataFrame:
        hashed = F.pmod(F.xxhash64(F.lit(13), "id"), F.col(own_blocks)).cast("int").alias(own_blocks)
        all_of = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        sent = df.join(marks, "id").join(blocks, "g").select("g", "id", "component", "n", "bits", "parity", hashed, all_of)
        sent = sent.withColumn("bin", F.pmod(F.xxhash64("g", "x", "y"), F.lit(bins)))
        return sent.toDF(*sent.columns)  # columns of its own: both sides come from the same tables

    def compare(a: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        others, found = Signed.blocks(m), []
        for key, side in Signed.blocks(a).items():
            if key in others:
                found += compared.chances(side, others[key], nearest)
        pairs = np.unique(np.sort(np.array(found, dtype=np.int64).reshape(-1, 2), axis=1), axis=0)
        return pd.DataFrame(pairs, columns=["a", "b"])

    both = dealt(asked, "x", "y").groupBy("bin").cogroup(dealt(members, "y", "x").groupBy("bin"))
    chances = scratch.write(both.applyInPandas(compare, "a long, b long"), f"{name}-chances").distinct()
    return _linked(chances, marks, texts, compared, scratch, name)


def _linked(chances: DataFrame, marks: DataFrame, texts: DataFrame, compared: Compared, scratch: Scratch, name: str) -> DataFrame:
    """The linked ones of pairs (a, b), by their full sets. The partners of a document are dealt to as many parts as they have
    BIN_PAIRS, or their sets BIN_BYTES, and parts to bins of about that size. Texts pass a filter of fixed size first, so that only
    those that have a partner are exchanged, and are then merged with their bins, in the same way at every size."""
    size = marks.groupBy("id").agg((F.max("n").cast("long") * 8).alias("size"))
    chances = scratch.write(chances, f"{name}-pairs")
    most = chances.join(size, chances["b"] == size["id"]).groupBy("a").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("pairs"))
    share = F.greatest(F.col("bytes") / F.lit(BIN_BYTES), F.col("pairs") / F.lit(BIN_PAIRS))
    parts = scratch.write(most.select("a", F.ceil(share).cast("int").alias("parts"), share.alias("share")), f"{name}-parts")
    bins = max(partitions(marks.sparkSession), math.ceil(parts.agg(F.sum("share")).first()[0] or 0))
    place = F.pmod(F.xxhash64(F.lit(17), "a", F.pmod(F.xxhash64(F.lit(19), "b"), F.col("parts"))), F.lit(bins)).alias("bin")
    pairs = scratch.write(chances.join(parts.drop("share"), "a").select("a", "b", place), f"{name}-dealt")
    where = pairs.select("bin", F.col("a").alias("id")).unionByName(pairs.select("bin", F.col("b").alias("id"))).distinct()
    where = scratch.write(where, f"{name}-where")
    key = F.xxhash64("id").alias("key")
    known = scratch.write(known_keys(where.select(key), "key"), f"{name}-known")
    sent = may_be(texts.select("*", key), known, "key").join(where.hint("merge"), "id").select("bin", "id", "text")
    sent = sent.toDF(*sent.columns)

    def link(p: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, list[str]] = {}
        for i, text in zip(t["id"].tolist(), t["text"], strict=True):
            own.setdefault(i, []).append(text)
        return pd.DataFrame(compared.links(p[["a", "b"]].to_numpy(np.int64), own) if len(p) else np.empty((0, 2), np.int64), columns=["a", "b"])

    links = scratch.write(pairs.groupBy("bin").cogroup(sent.groupBy("bin")).applyInPandas(link, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-chances", f"{name}-pairs", f"{name}-dealt")
    return links


def near_dedup(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, seed: int = 31
) -> DataFrame:
    """One row for each row of df: id long, n_shingles long (size of its set), component_id long (smallest id that can be
    reached over links, itself included), kept boolean (whether that is its own id).

    Two documents are linked if 100 * intersection >= percent * union of their sets of `size`-word shingles (A-Z
    lower-cased, words between ASCII white space). Null, empty and blank texts have an empty set and no links. Rows with
    equal ids count as one document with the links of all of them. Rows with a null id have no links; their component is
    null. The id must be an integer; other columns of df are not looked at. An empty table gives an empty one. Texts are read
    whole; a long one is in memory with its set while it is compared; the sets of a call have 1 MB together, or are those of one pair.
    """
    spark = df.sparkSession
    importable(spark)
    scratch = Scratch(spark, "minhash")
    family = Family(bands, rows, seed)
    narrow = df.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    texts = narrow.where("id is not null and text is not null")
    signed = scratch.write(signatures(texts, size, family), "signed")
    classes = signed.where("n > 0").groupBy("high", "low").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "keys", "bits", "parity")])
    classes = scratch.write(classes, "classes")

    in_bands = classes.select("id", F.explode("keys").alias("key"))
    buckets = in_bands.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("last")).where("center < last").select("key", "center")
    grouped = in_bands.join(scratch.write(buckets, "buckets"), "key").select(F.col("center").alias("g"), "id").distinct()
    groups = scratch.write(grouped, "groups")
    rows = groups.count()
    marks, compared = classes.select("id", "n", "bits", "parity"), Compared(family, size, percent)

    centers = groups.where("g = id").select("g", "id", F.col("id").alias("component"))
    others = groups.where("g != id").select("g", "id", F.col("id").alias("component"))
    links = _confirm(centers, others, marks, texts, compared, scratch, "stars")
    again = signed.where("n > 0").groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    if not again.isEmpty():  # rows that share an id are one document: their classes are linked through it
        shared = signed.where("n > 0").join(again, "id").select("id", "high", "low")
        links = links.unionByName(shared.join(classes.select("high", "low", F.col("id").alias("b")), ["high", "low"]).select(F.col("id").alias("a"), "b"))
    found = components(links, scratch, "first")

    for k, nearest in enumerate(NEAREST):
        placed = groups.where("g != id").join(found, "id", "left").select("g", "id", F.coalesce("component", "id").alias("component"))
        placed = scratch.write(placed, f"placed-{k}", rows)
        per = placed.groupBy("g", "component").agg(F.count(F.lit(1)).alias("c"))
        top = per.groupBy("g").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        top = scratch.write(top.select("g", F.col("top.component").alias("top")), f"top-{k}", rows)
        if top.isEmpty():
            break
        members = scratch.write(placed.join(top, "g"), f"members-{k}", rows)
        asked = members.where("component != top").drop("top")
        more = _confirm(asked, members.drop("top"), marks, texts, compared, scratch, f"rest-{k}", nearest)
        scratch.drop(f"placed-{k}", f"top-{k}", f"members-{k}")
        if not more.isEmpty():
            # the components found so far are stars themselves
            found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more), scratch, f"more-{k}")

    reps = classes.select("high", "low", F.col("id").alias("rep")).join(found.withColumnRenamed("id", "rep"), "rep", "left")
    reps = scratch.write(reps.select("high", "low", F.coalesce("component", "rep").alias("rep_component")), "reps")
    own = signed.select("id", "n", "high", "low").join(reps, ["high", "low"], "left")
    out = own.select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep_component", "id").alias("component_id"))
    bare = narrow.where("id is null or text is null").select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(bare).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
