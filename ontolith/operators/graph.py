"""Graph expansion over link tables (link_type, source_id, target_id, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjacency(links: DataFrame) -> DataFrame:
    """Every link from both of its ends: (id, other, link_type, direction, ord)."""
    out = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "link_type", F.lit("out").alias("direction"), "ord")
    back = links.select(F.col("target_id").alias("id"), F.col("source_id").alias("other"), "link_type", F.lit("in").alias("direction"), "ord")
    return out.unionByName(back)


def neighbors(edges: DataFrame, seeds: DataFrame, *, link_type: str | None = None, max_hops: int = 2, objects: DataFrame | None = None) -> DataFrame:
    """Breadth-first neighbours of each seed (column id): (seed, id, hop, rank).

    Links count in both directions; link_type restricts every hop; a node appears once, at its first hop, ranked by hop,
    its discoverer's rank and link order. Nodes that are no objects are passed through but not returned. One join a hop.
    """
    if max_hops < 1:
        return seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"), F.lit(0).alias("rank")).limit(0)
    if link_type is not None:
        edges = edges.where(F.col("link_type") == link_type)
    steps = edges.select(F.col("id").alias("at"), "other", "ord", "direction")
    frontier = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("hop"), F.lit(0).alias("rank")).distinct()
    visited = frontier
    for hop in range(1, max_hops + 1):
        reached = frontier.join(steps, F.col("id") == F.col("at")).select("seed", F.col("other").alias("id"), F.struct("rank", "ord", "direction").alias("way"))
        first = reached.groupBy("seed", "id").agg(F.min("way").alias("way"))
        fresh = first.join(visited.select("seed", "id"), ["seed", "id"], "left_anti")
        order = Window.partitionBy("seed").orderBy("way", "id")
        frontier = fresh.select("seed", "id", F.lit(hop).alias("hop"), F.row_number().over(order).alias("rank"))
        visited = visited.unionByName(frontier)
    found = visited.where("hop > 0")
    if objects is not None:
        found = found.join(objects.select("id").distinct(), "id", "left_semi")
    order = Window.partitionBy("seed").orderBy("hop", "rank")
    return found.select("seed", "id", "hop", F.row_number().over(order).alias("rank"))


def trails(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """Every hop of every path of 1..max_hops links from each seed, no link twice in a path: (seed, path, length, depth, node,
    link_type, ord). path is the path's link ordinals, joined by '-'."""
    if max_hops < 1:
        raise ValueError("max_hops must be at least 1")
    steps = edges.select(F.col("id").alias("at"), "other", "link_type", "ord")
    hop = F.struct(F.col("other").alias("node"), "link_type", "ord")
    paths = seeds.select(F.col("id").alias("seed")).distinct().join(steps, F.col("seed") == F.col("at")).select("seed", F.col("other").alias("end"), F.array(hop).alias("hops"))
    out = paths
    for _ in range(1, max_hops):
        longer = paths.join(steps, F.col("end") == F.col("at")).where(~F.exists("hops", lambda h: h["ord"] == F.col("ord")))
        paths = longer.select("seed", F.col("other").alias("end"), F.concat("hops", F.array(hop)).alias("hops"))
        out = out.unionByName(paths)
    path = F.array_join(F.transform("hops", lambda h: h["ord"].cast("string")), "-")
    return out.select("seed", path.alias("path"), F.size("hops").alias("length"), F.posexplode("hops").alias("at", "hop")).select(
        "seed", "path", "length", (F.col("at") + 1).alias("depth"), "hop.node", "hop.link_type", "hop.ord"
    )


def two_hop_edges(edges: DataFrame, starts: DataFrame, rels: list[str] | DataFrame | None = None, *, by: list[str] | None = None, order: str = "type") -> DataFrame:
    """The distinct links within two hops of the starts (columns id, and ord for their order), second hops back to the start left out:
    (source_id, target_id, link_type, hit, rank). hit: whether the link's type is asked for (all are if none is); rank puts
    hits first, then sorts by type, then by first discovery; with order 'found' by first discovery only.

    by: columns of starts, a question's id for instance; links are then found, and ranked, for each of their values, and rels
    may be a DataFrame of these columns and link_type."""
    by = by or []
    first = starts.select(*by, F.col("id").alias("start"), F.col("ord").alias("s")).join(edges.withColumnRenamed("ord", "e"), F.col("start") == F.col("id"))
    one = first.select(*by, "start", "s", "e", "direction", F.col("other").alias("mid"), "id", "other", "link_type")
    hops = edges.select(F.col("id").alias("mid"), F.col("other").alias("other2"), F.col("link_type").alias("type2"), F.col("direction").alias("direction2"), F.col("ord").alias("e2"))
    two = one.join(hops, "mid").where("other2 != start")

    def oriented(direction: str, a: str, b: str, kind: str, *place: str) -> list:
        out = F.col(direction) == "out"
        return [
            F.when(out, F.col(a)).otherwise(F.col(b)).alias("source_id"),
            F.when(out, F.col(b)).otherwise(F.col(a)).alias("target_id"),
            F.col(kind).alias("link_type"),
            F.struct(*[F.coalesce(F.col(p).cast("long"), F.lit(-1)).alias(f"p{k}") if p else F.lit(-1).cast("long").alias(f"p{k}") for k, p in enumerate(place)]).alias("place"),
        ]

    found = one.select(*by, *oriented("direction", "id", "other", "link_type", "s", "e", "")).unionByName(two.select(*by, *oriented("direction2", "mid", "other2", "type2", "s", "e", "e2")))
    distinct = found.groupBy(*by, "source_id", "target_id", "link_type").agg(F.min("place").alias("place"))
    if isinstance(rels, DataFrame):
        asked = rels.select(*by, "link_type", F.lit(True).alias("asked")).distinct()
        some = asked.select(*by, F.lit(True).alias("some")).distinct()
        distinct = distinct.join(asked, [*by, "link_type"], "left").join(some, by, "left").withColumn("hit", F.col("some").isNull() | F.col("asked").isNotNull()).drop("asked", "some")
    else:
        distinct = distinct.withColumn("hit", F.col("link_type").isin(*rels) if rels else F.lit(True))
    kind = ["link_type"] if order == "type" else []
    window = Window.partitionBy(*by).orderBy(~F.col("hit"), *kind, "place", "source_id", "target_id")
    return distinct.select(*by, "source_id", "target_id", "link_type", "hit", F.row_number().over(window).alias("rank"))


def links_of(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The links of each object (column id) as it sees them: (id, to, rel, dir, ord); rel is the link's label."""
    own = ids.select("id").distinct()
    out = links.select(F.col("source_id").alias("id"), F.col("target_id").alias("to"), F.col("label").alias("rel"), F.lit("out").alias("dir"), "ord")
    back = links.select(F.col("target_id").alias("id"), F.col("source_id").alias("to"), F.col("label").alias("rel"), F.lit("in").alias("dir"), "ord")
    return out.unionByName(back).join(own, "id", "left_semi").select("id", "to", "rel", "dir", "ord")


def objects_in(found: DataFrame) -> DataFrame:
    """(objects): how many distinct objects stand at the ends of links."""
    return found.select(F.explode(F.array("source_id", "target_id")).alias("id")).agg(F.count_distinct("id").alias("objects"))


def focus_or_default(objects: DataFrame, asked: str, place: int = 2) -> DataFrame:
    """(id) of the object asked for; if there is none, of the second by ord."""
    own = objects.where(F.col("id") == asked).select("id", F.lit(0).alias("o"))
    other = objects.select("id", "ord").orderBy("ord", "id").offset(place - 1).limit(1).select("id", F.lit(1).alias("o"))
    return own.unionByName(other).orderBy("o").limit(1).select("id")


def ego_graph(objects: DataFrame, relations: DataFrame, focus: DataFrame) -> DataFrame:
    """For each focus (column id) the relations at either end and their objects: (focus, kind 'node' or 'edge', id, source_id,
    target_id, link_type). The focus is a node of its own graph."""
    ids = focus.select(F.col("id").alias("focus")).distinct()
    out = relations.join(ids, F.col("source_id") == F.col("focus")).unionByName(relations.join(ids, F.col("target_id") == F.col("focus")).where("source_id != target_id"))
    edges = out.select("focus", "link_type", "source_id", "target_id")
    ends = edges.select("focus", F.explode(F.array("source_id", "target_id")).alias("id")).unionByName(ids.select("focus", F.col("focus").alias("id"))).distinct()
    nodes = ends.join(objects.select("id").distinct(), "id", "left_semi")
    none = F.lit(None).cast("string")
    return nodes.select("focus", F.lit("node").alias("kind"), "id", none.alias("source_id"), none.alias("target_id"), none.alias("link_type")).unionByName(
        edges.select("focus", F.lit("edge").alias("kind"), none.alias("id"), "source_id", "target_id", "link_type")
    )


def incident_counts(objects: DataFrame, links: DataFrame) -> DataFrame:
    """(object_type, objects, prop_keys, links, first_three): a link counts once for a type, even with both ends in it."""
    kinds = objects.select("id", "object_type").distinct()
    ends = links.select("ord", F.explode(F.array("source_id", "target_id")).alias("id")).join(kinds, "id").select("ord", "object_type").distinct()
    at_type = ends.groupBy("object_type").agg(F.count(F.lit(1)).alias("links"))
    keys = objects.select("object_type", F.explode_outer(F.map_keys("properties")).alias("key")).groupBy("object_type").agg(F.count_distinct("key").alias("prop_keys"))
    order = Window.partitionBy("object_type").orderBy("ord", "id")
    first = objects.withColumn("k", F.row_number().over(order)).where("k <= 3").groupBy("object_type")
    first = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]), ",").alias("first_three"))
    counts = objects.groupBy("object_type").agg(F.count(F.lit(1)).alias("objects"))
    return counts.join(keys, "object_type").join(first, "object_type").join(at_type, "object_type", "left").withColumn("links", F.coalesce("links", F.lit(0)))
