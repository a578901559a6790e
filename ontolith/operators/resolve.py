"""Entity resolution: merging by key, merging by embedding, redirection of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontolith.plans.scratch import Scratch

from .components import components

THRESHOLD = 0.92


def merge_by_key(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first record (by ord) of each key survives; later properties win key by key; the prov of each absorbed record is
    appended in order. Returns keys, ord, properties map, prov, absorbed array<string>."""
    keys = keys or ["object_type", "id"]
    entries = records.select(*keys, "ord", F.explode("properties").alias("name", "value"))
    values = entries.groupBy(*keys, "name").agg(F.max_by("value", "ord").alias("value"))
    maps = values.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))
    provs = records.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "prov"))).alias("all"))
    joined = provs.join(maps, keys, "left")
    empty = F.map_from_entries(F.array().cast("array<struct<name:string,value:string>>"))
    return joined.select(
        *keys,
        F.col("all")[0]["ord"].alias("ord"),
        F.coalesce("properties", empty).alias("properties"),
        F.col("all")[0]["prov"].alias("prov"),
        F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: x["prov"]).alias("absorbed"),
    )


def merged_keys(records: DataFrame, scratch: Scratch, name: str, keys: list[str] | None = None) -> DataFrame:
    """What merge_by_key gives without provs: keys, ord, properties, and records, the number of records of a key. Of records of a key
    that set the same properties only the latest leaves the exchange of all records."""
    keys = keys or ["object_type", "id"]
    names = F.array_sort(F.map_keys("properties")).alias("names")
    last = F.max(F.struct("ord", F.map_entries("properties").alias("entries"))).alias("last")
    sets = records.groupBy(*keys, names).agg(F.min("ord").alias("first"), last, F.count(F.lit(1)).alias("records"))
    sets = scratch.write(sets.select(*keys, "first", "last.ord", "last.entries", "records"), name)
    entries = sets.select(*keys, "ord", F.inline("entries").alias("name", "value"))
    values = entries.groupBy(*keys, "name").agg(F.max_by("value", "ord").alias("value"))
    maps = values.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))
    empty = F.map_from_entries(F.array().cast("array<struct<name:string,value:string>>"))
    one = sets.groupBy(*keys).agg(F.min("first").alias("ord"), F.sum("records").alias("records"))
    return one.join(maps, keys, "left").select(*keys, "ord", F.coalesce("properties", empty).alias("properties"), "records")


#: Vectors of a type that decide where its space is cut, and the most regions it is cut into; both decide about costs only.
SAMPLE, MOST_REGIONS = 4096, 1024


class Regions:
    """The unit vectors of a type in regions, cut at the means of coordinates that vary most."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.cuts: dict[int, tuple[int, float, int, int]] = {}
        self.count, made = 0, 1
        waiting, smallest = [(0, sample)], max(2, len(sample) // max(1, regions))
        while waiting:
            node, x = waiting.pop()
            if len(x) >= 2 * smallest and (spread := x.var(axis=0)).max() > 0:
                j = int(spread.argmax())
                left = x[:, j] <= (cut := float(x[:, j].mean()))
                if left.any() and not left.all():
                    self.cuts[node] = (j, cut, made, made + 1)
                    waiting += [(made, x[left]), (made + 1, x[~left])]
                    made += 2
                    continue
            self.cuts[node] = (-1, 0.0, self.count, 0)
            self.count += 1

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), dtype=np.int64)
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, at = waiting.pop()
            j, cut, low, high = self.cuts[node]
            if j < 0:
                out[at] = low
            elif len(at):
                left = x[at, j] <= cut
                waiting += [(low, at[left]), (high, at[~left])]
        return out


def _apart(low: np.ndarray, high: np.ndarray, box_low: np.ndarray, box_high: np.ndarray) -> np.ndarray:
    """Squared distances between boxes, at least; a point is a box."""
    gap = np.maximum(0, np.maximum(box_low - high, low - box_high))
    return (gap * gap).sum(axis=-1)


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, block_rows: int = 2048) -> DataFrame:
    """Pairs (object_type, a, b, cosine) of equal type with cosine >= threshold, a before b by ord.

    vectors: object_type, ord, vec. Rows of a type are dealt to regions of space, and those of a region to blocks by a hash. Each
    pair of blocks meets in a task of bounded size as a matrix product, and only the pairs that pass leave it. A row goes only
    where the bounds of a block's region leave a similar vector possible, so that no pair is lost; where vectors have no clusters
    it goes to most blocks. A zero vector is similar to nothing.
    """
    keyed = _met(vectors, threshold, block_rows)

    def meet_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        left = pdf[pdf["own"] == pdf["low"].iloc[0]]
        right = pdf[pdf["own"] == pdf["high"].iloc[0]]
        if len(left) and len(right):
            a, b = _unit(left["vec"]), _unit(right["vec"])
            i, j = left["ord"].to_numpy(), right["ord"].to_numpy()
            cos = a @ b.T
            x, y = np.nonzero((cos >= threshold) & (i[:, None] < j[None, :]))
            out.append(pd.DataFrame({"a": i[x], "b": j[y], "cosine": cos[x, y]}))
            if pdf["low"].iloc[0] != pdf["high"].iloc[0]:
                x, y = np.nonzero((cos >= threshold) & (i[:, None] > j[None, :]))
                out.append(pd.DataFrame({"a": j[y], "b": i[x], "cosine": cos[x, y]}))
        found = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "cosine": []})
        return found.assign(object_type=pdf["object_type"].iloc[0])[["object_type", "a", "b", "cosine"]]

    schema = f"object_type {dict(vectors.dtypes)['object_type']}, a long, b long, cosine double"
    return keyed.groupBy("object_type", "low", "high").applyInPandas(meet_blocks, schema)


def _met(vectors: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Rows with the pairs of blocks (low, high) of their type that they go to: object_type, ord, vec, own, low, high."""
    kind, scratch = dict(vectors.dtypes)["object_type"], Scratch(vectors.sparkSession, "similar")
    columns = f"object_type {kind}, ord long, vec array<double>"
    vectors = scratch.write(vectors.select("object_type", "ord", F.col("vec").cast("array<double>").alias("vec")), "vectors")
    counts = {r["object_type"]: r["c"] for r in vectors.where("object_type is not null").groupBy("object_type").agg(F.count(F.lit(1)).alias("c")).collect()}
    cuts = {}
    for t, c in counts.items():
        some = vectors.where((F.col("object_type") == F.lit(t)) & (F.pmod(F.xxhash64(F.lit(23), "ord"), F.lit(-(-c // SAMPLE))) == 0)).select("vec").limit(2 * SAMPLE).toPandas()
        x = _unit(some["vec"]) if len(some) else np.zeros((0, 0))
        cuts[t] = Regions(x, min(MOST_REGIONS, -(-c // block_rows)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, rows in batch.groupby("object_type"):
                x = _unit(rows["vec"])
                real = x.any(axis=1)
                yield rows[real].assign(region=cuts[t].of(x[real]))

    dealt = scratch.write(vectors.where("object_type is not null").mapInPandas(deal, f"{columns}, region long"), "dealt")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, list] = {}
        for batch in batches:
            for key, rows in batch.groupby(["object_type", "region"]):
                x = _unit(rows["vec"])
                c, low, high = found.get(key, (0, x[0], x[0]))
                found[key] = (c + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
        if found:
            yield pd.DataFrame([(*key, *v) for key, v in found.items()], columns=["object_type", "region", "c", "low", "high"])

    each = f"object_type {kind}, region long, c long, low array<double>, high array<double>"
    bounds = dealt.select("object_type", "region", "vec").mapInPandas(bound, each)

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = np.array(pdf["low"].tolist()).min(axis=0), np.array(pdf["high"].tolist()).max(axis=0)
        return pd.DataFrame([(pdf["object_type"].iloc[0], pdf["region"].iloc[0], pdf["c"].sum(), low, high)], columns=pdf.columns)

    boxes = bounds.groupBy("object_type", "region").applyInPandas(joined, each).toPandas()
    reach = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors with the threshold as cosine
    near: dict[tuple, list[tuple]] = {}  # of a region: those in reach, with their blocks and bounds
    first: dict[tuple, tuple[int, int]] = {}
    for t, of in boxes.groupby("object_type"):
        low, high, blocks = np.array(of["low"].tolist()), np.array(of["high"].tolist()), -(-of["c"].to_numpy() // block_rows)
        starts, regions = np.cumsum(blocks) - blocks, of["region"].tolist()
        for k, region in enumerate(regions):
            first[t, region] = (int(starts[k]), int(blocks[k]))
            near[t, region] = [(int(starts[o]), int(blocks[o]), low[o], high[o]) for o in np.flatnonzero(_apart(low[k], high[k], low, high) <= reach)]

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(["object_type", "region"]):
                x, (start, own_blocks) = _unit(rows["vec"]), first[key]
                own = start + rows["hashed"].to_numpy() % own_blocks
                for begin, blocks, low, high in near[key]:
                    at = np.flatnonzero(_apart(x, x, low, high) <= reach)
                    for other in range(begin, begin + blocks) if len(at) else ():
                        yield rows.iloc[at][["object_type", "ord", "vec"]].assign(own=own[at], low=np.minimum(own[at], other), high=np.maximum(own[at], other))

    hashed = F.shiftrightunsigned(F.xxhash64("ord"), 1).alias("hashed")
    return dealt.select("object_type", "ord", "vec", "region", hashed).mapInPandas(send, f"{columns}, own long, low long, high long")


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def clusters(pairs: DataFrame, name: str = "clusters") -> DataFrame:
    """(ord, survivor) of every record in a pair (a, b): the lowest ord of its component."""
    found = components(pairs.select("a", "b"), Scratch(pairs.sparkSession, name), name)
    both = found.select(F.col("id").alias("ord"), F.col("component").alias("survivor"))
    return both.unionByName(found.select(F.col("component").alias("ord"), F.col("component").alias("survivor")).distinct())


def alias_map(records: DataFrame, found: DataFrame) -> DataFrame:
    """(id, survivor_id) of every record that is absorbed."""
    ids = records.select("ord", "id")
    gone = found.where("ord != survivor").join(ids, "ord")
    return gone.join(ids.select(F.col("ord").alias("survivor"), F.col("id").alias("survivor_id")), "survivor").select("id", "survivor_id").distinct()


def redirect(links: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links with both ends moved to survivors; the types of the ends do not matter."""
    for end in ("source_id", "target_id"):
        moved = aliases.select(F.col("id").alias(end), F.col("survivor_id").alias("moved"))
        links = links.join(moved, end, "left").withColumn(end, F.coalesce("moved", end)).drop("moved")
    return links


def by_embedding(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(object_type, id, survivor_id) of every record that is absorbed: of the records of one type that similar pairs connect, the
    first by ord survives. records: object_type, id, ord (of any ordered type), vec."""
    scratch = Scratch(records.sparkSession, "by-embedding")
    # vectors that are equal are compared once; how else they are linked follows from that
    numbered = scratch.write(records.select("object_type", "id", F.col("ord").alias("place"), "vec", F.monotonically_increasing_id().alias("ord")), "numbered")
    real = F.coalesce(F.exists("vec", lambda x: x != 0) & ~F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) > 1e150)) & F.exists("vec", lambda x: F.abs(x) > 1e-150), F.lit(False))
    alike = real if threshold <= 1 - 1e-9 else F.lit(False)
    by_vector = numbered.withColumn("vec", F.transform("vec", lambda x: x.cast("double") + F.lit(0.0))).withColumn("lone", F.when(~alike, F.col("ord"))).select("object_type", "vec", "lone", "ord")
    one = scratch.write(by_vector.groupBy("object_type", "vec", "lone").agg(F.min("ord").alias("rep")), "one")
    same = by_vector.where("lone is null").join(one.where("lone is null").drop("lone"), ["object_type", "vec"]).where("ord != rep").select(F.col("ord").alias("a"), F.col("rep").alias("b"))
    pairs = similar_pairs(one.select("object_type", F.col("rep").alias("ord"), "vec"), threshold).select("a", "b")
    found = clusters(pairs.unionByName(same))
    own = numbered.drop("vec").join(found, "ord")
    first = own.groupBy("survivor").agg(F.min_by("id", F.struct("place", "ord")).alias("survivor_id"))
    return own.join(first, "survivor").where("id != survivor_id").select("object_type", "id", "survivor_id")


def fold(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """Records after absorption: a survivor takes the properties of the records it absorbs, later ones (by ord) win key by key,
    and their provs, each followed by those it had absorbed itself. Adds merged_via: 'embedding' where something was absorbed,
    else empty. records: object_type, id, ord, properties, prov, absorbed, or records (a number, which is added up) in place of the
    last two. aliases: object_type, id, survivor_id."""
    moved = records.join(aliases.select("object_type", "id", "survivor_id"), ["object_type", "id"], "left").withColumn("gone", F.col("survivor_id").isNotNull())
    target = moved.withColumn("id", F.coalesce("survivor_id", "id"))
    entries = target.select("object_type", "id", "ord", "gone", F.explode("properties").alias("name", "value"))
    values = entries.groupBy("object_type", "id", "name").agg(F.max_by("value", F.struct("gone", "ord")).alias("value"))
    maps = values.groupBy("object_type", "id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))
    entire = "prov" in records.columns
    folded = [F.max(F.when(~F.col("gone"), F.col("ord"))).alias("ord"), F.count_if("gone").alias("folded")]
    if entire:
        taken = F.array_sort(F.collect_list(F.when(F.col("gone"), F.struct("ord", F.concat(F.array("prov"), "absorbed").alias("provs")))))
        folded += [F.max(F.when(~F.col("gone"), F.struct("prov", "absorbed"))).alias("own"), taken.alias("taken")]
    else:
        folded.append(F.sum("records").alias("records"))
    provs = target.groupBy("object_type", "id").agg(*folded)
    empty = F.map_from_entries(F.array().cast("array<struct<name:string,value:string>>"))
    absorbed = ["own.prov", F.concat("own.absorbed", F.flatten(F.transform("taken", lambda x: x["provs"]))).alias("absorbed")] if entire else ["records"]
    via = F.when(F.col("folded") > 0, "embedding").otherwise("").alias("merged_via")
    return provs.join(maps, ["object_type", "id"], "left").select("object_type", "id", "ord", F.coalesce("properties", empty).alias("properties"), *absorbed, via)
