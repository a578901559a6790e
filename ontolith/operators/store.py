"""Objects, links and vectors as tables: upserts, look-ups and the checks around them.

Tables: objects (object_type, id, properties map<string,string>, prov string, ord), links (link_type, source_id, target_id,
properties, prov, ord), vectors (collection, id, vec array<double>, object_type, text, prov, ord). `ord` orders writes; in
upserts what has the greater ord is later. All merges are aggregations by key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontolith.plans.scratch import Scratch

NAME = re.compile(r"^[A-Za-z0-9_]+$")


def check_names(names: list[str], known: list[str] | None = None) -> None:
    """Type and link names are letters, digits and underscores, and known if a catalogue is given."""
    for name in names:
        if not NAME.match(name):
            raise ValueError(f"{name!r} is not a valid name")
        if known is not None and name not in known:
            raise ValueError(f"{name!r} is not in the ontology")


#: Keys with more writes than this are merged write by write; there is one such key in that many rows at most.
MOST_WRITES = 1000


def _merged(records: DataFrame, keys: list[str]) -> DataFrame:
    """Later values win key by key, keys that are not set again stay; prov is the last one. The writes of most keys are gathered
    and folded in one exchange; a key with very many writes is not gathered, its properties are aggregated one by one."""
    many = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("writes")).where(F.col("writes") > MOST_WRITES).select(*keys)
    many = Scratch(records.sparkSession, "upsert").write(many, "many")
    if many.isEmpty():
        return _gathered(records, keys)
    return _gathered(records.join(many, keys, "left_anti"), keys).unionByName(_aggregated(records.join(many, keys, "left_semi"), keys))


def _gathered(records: DataFrame, keys: list[str]) -> DataFrame:
    write = F.struct("ord", "prov", F.map_entries("properties").alias("entries"))
    all_ = records.groupBy(*keys).agg(F.array_sort(F.collect_list(write)).alias("all"))
    flat = all_.select(*keys, F.flatten(F.filter(F.transform("all", lambda w: w["entries"]), lambda e: e.isNotNull())).alias("flat"), F.element_at("all", -1).alias("last"))
    names = F.array_sort(F.array_distinct(F.transform("flat", lambda e: e["key"])))
    latest = lambda name: F.element_at(F.filter("flat", lambda e: e["key"] == name), -1)["value"]
    props = F.map_from_arrays(names, F.transform(names, latest))
    return flat.select(*keys, props.alias("properties"), F.col("last.prov").alias("prov"), F.col("last.ord").alias("ord"))


def _aggregated(records: DataFrame, keys: list[str]) -> DataFrame:
    entries = records.select(*keys, "prov", "ord", F.explode_outer("properties").alias("name", "value"))
    each = entries.groupBy(*keys, "name").agg(F.max_by("value", "ord").alias("value"), F.max(F.struct("ord", "prov")).alias("last"))
    pairs = F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "value")))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(pairs)).alias("properties"), F.max("last").alias("last")).select(*keys, "properties", F.col("last.prov").alias("prov"), F.col("last.ord").alias("ord"))


def upsert_objects(stored: DataFrame | None, incoming: DataFrame, mode: str = "merge") -> DataFrame:
    """merge: by type and id, property by property. replace: whole objects by id, empty ids left out. `ord` of the incoming
    must be greater than that of the stored."""
    records = incoming if stored is None else stored.unionByName(incoming)
    if mode == "merge":
        return _merged(records, ["object_type", "id"])
    if mode != "replace":
        raise ValueError("mode is merge or replace")
    whole = F.struct("object_type", "id", "properties", "prov", "ord")
    return records.where(F.coalesce("id", F.lit("")) != "").groupBy("id").agg(F.max_by(whole, "ord").alias("o")).select("o.*")


def upsert_links(stored: DataFrame | None, incoming: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """By type, source and target; with objects given, links without both endpoints are left out."""
    records = incoming if stored is None else stored.unionByName(incoming)
    out = _merged(records, ["link_type", "source_id", "target_id"])
    return out if objects is None else with_endpoints(out, objects)


def with_endpoints(links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links both of whose ends are objects, whatever their type."""
    ids = objects.select("id")
    return links.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def dangling(links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links with an end that is no object."""
    ids = objects.select("id").distinct()
    source, target = ids.select(F.col("id").alias("source_id"), F.lit(True).alias("has_source")), ids.select(F.col("id").alias("target_id"), F.lit(True).alias("has_target"))
    found = links.join(source, "source_id", "left").join(target, "target_id", "left")
    return found.where("has_source is null or has_target is null").drop("has_source", "has_target")


def get_objects(objects: DataFrame, object_type: str, ids: DataFrame | list[str] | None = None) -> DataFrame:
    """Objects of a type; ids: None for all, an empty list for none."""
    found = objects.where(F.col("object_type") == object_type)
    if ids is None:
        return found
    if isinstance(ids, list):
        return found.where(F.col("id").isin(ids)) if ids else found.limit(0)
    return found.join(ids.select("id"), "id", "left_semi")


def upsert_vectors(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Replaces by collection and id."""
    records = incoming if stored is None else stored.unionByName(incoming)
    whole = F.struct(*records.columns)
    return records.groupBy("collection", "id").agg(F.max_by(whole, "ord").alias("v")).select("v.*")


def records_from_vertices(rows: DataFrame, properties: str = "properties") -> DataFrame:
    """Vertex rows (label, properties) as records: system keys (two leading underscores) go, prov is read from __prov."""
    props: Column = F.col(properties)
    own = F.map_filter(props, lambda k, _: ~k.startswith("__"))
    prov = F.coalesce(F.try_parse_json(F.element_at(props, "__prov")).cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select(F.col("label").alias("object_type"), F.element_at(props, "id").alias("id"), own.alias("properties"), F.to_json(prov).alias("prov"))


def records_from_edges(rows: DataFrame, properties: str = "properties") -> DataFrame:
    """Edge rows (label, source_id, target_id, properties) as link records; prov is read from __prov."""
    props: Column = F.col(properties)
    prov = F.coalesce(F.try_parse_json(F.element_at(props, "__prov")).cast("map<string,string>"), F.create_map().cast("map<string,string>"))
    return rows.select(F.col("label").alias("link_type"), "source_id", "target_id", F.map_filter(props, lambda k, _: k != "__prov").alias("properties"), F.to_json(prov).alias("prov"))


def normalised(rows: DataFrame) -> DataFrame:
    """Records of several shapes as (id, object_type, score): id or else object_id, object_type or else type, score or else 0."""
    said = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in rows.columns], F.lit(""))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in rows.columns else F.lit(0.0)
    return rows.select(said("id", "object_id").alias("id"), said("object_type", "type").alias("object_type"), score.alias("score"))


def decoded(text: Column) -> Column:
    """The JSON text of a graph value: type marks (::vertex, ::edge, ::path, ::agtype) go where they stand outside strings."""
    return F.regexp_replace(F.trim(text), r'("(?:[^"\\]++|\\.)*+")|::(?:vertex|edge|path|agtype)(?![\p{L}\p{N}_])', "$1")


def decoded_vertices(rows: DataFrame, text: str) -> DataFrame:
    """Vertex rows (label, properties) from graph values as text; what is no JSON object gives no row."""
    read = rows.select(F.from_json(decoded(F.col(text)), "label string, properties map<string,string>").alias("v"))
    return read.where("v.label is not null").select("v.label", F.coalesce("v.properties", F.create_map().cast("map<string,string>")).alias("properties"))


def graph_name(namespace: str) -> str:
    """The name of a namespace's graph."""
    name = "oag_" + namespace.replace(".", "_")
    check_names([name])
    return name


class VectorStore:
    """Vectors of named collections with the two operations of a vector store; nothing is mutated."""

    def __init__(self, vectors: DataFrame):
        self.vectors = vectors

    def with_vectors(self, incoming: DataFrame) -> VectorStore:
        return VectorStore(upsert_vectors(self.vectors, incoming))

    def search(self, collection: str, questions: DataFrame, k: int, linked: DataFrame | None = None) -> DataFrame:
        """The k nearest of a collection; linked types, if given, filter what was found."""
        from .retrieve import of_linked_types, vector_search

        own = self.vectors.where(F.col("collection") == collection)
        hits = vector_search(questions, own, k).join(own.select("id", "object_type", "text", "prov"), "id")
        return hits if linked is None else of_linked_types(hits, linked)


class GraphStore:
    """Objects and links with the five operations of a graph store; every method returns DataFrames, nothing is mutated."""

    def __init__(self, objects: DataFrame, links: DataFrame, mode: str = "merge"):
        self.objects, self.links, self.mode = objects, links, mode

    def with_objects(self, incoming: DataFrame) -> GraphStore:
        return GraphStore(upsert_objects(self.objects, incoming, self.mode), self.links, self.mode)

    def with_links(self, incoming: DataFrame) -> GraphStore:
        return GraphStore(self.objects, upsert_links(self.links, incoming, self.objects), self.mode)

    def get(self, object_type: str, ids: DataFrame | list[str] | None = None) -> DataFrame:
        return get_objects(self.objects, object_type, ids)

    def neighbors(self, seeds: DataFrame, link_type: str | None = None, max_hops: int = 2) -> DataFrame:
        from .graph import adjacency, neighbors

        return neighbors(adjacency(self.links), seeds, link_type=link_type, max_hops=max_hops, objects=self.objects)

    def query(self, sql: str) -> DataFrame:
        """SQL over the views `objects` and `links`."""
        return self.objects.sparkSession.sql(sql, objects=self.objects, links=self.links) if "{objects}" in sql or "{links}" in sql else self._viewed(sql)

    def _viewed(self, sql: str) -> DataFrame:
        self.objects.createOrReplaceTempView("objects")
        self.links.createOrReplaceTempView("links")
        return self.objects.sparkSession.sql(sql)
