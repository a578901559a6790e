"""From a scene to the ontology it follows: types and properties by what its nodes have, links by its edges and keywords.

Profiles, modes and owners are DataFrame aggregations over nodes and edges; what comes to the driver is a row for each type,
property and relation, the size of an ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontolith.operators import infer
from ontolith.plans.ontology import LinkType, ObjectType, Ontology, Property
from ontolith.sources.files import SCENE

#: As scenes are read elsewhere, but with the kinds of property values.
KINDS = SCENE.replace("props:map<string,string>", "props:map<string,variant>")


def prop_labels(read: DataFrame) -> DataFrame:
    """(path, label) from a scene's propMap, {concept: [[paths], label]}; of several labels of a path the first counts."""
    specs = read.select(F.posexplode(F.map_entries("propMap")).alias("ord", "spec")).where(F.size("spec.value") == 2)
    paths = specs.select("ord", F.explode(F.from_json(F.col("spec.value")[0], "array<string>")).alias("path"), F.col("spec.value")[1].alias("label"))
    return paths.where("path is not null").groupBy("path").agg(F.min_by("label", "ord").alias("label"))


def _concepts(read: DataFrame) -> DataFrame:
    """(rel, path_ord, path, label) of the propMap."""
    specs = read.select(F.explode(F.map_entries("propMap")).alias("spec"))
    paths = specs.select(F.col("spec.key").alias("rel"), F.get("spec.value", F.lit(1)).alias("label"), F.posexplode(F.from_json(F.get("spec.value", F.lit(0)), "array<string>")).alias("path_ord", "path"))
    return paths.where("path is not null")


def _values(nodes: DataFrame) -> DataFrame:
    """(object_type, prop, value, kind, ord): the properties of each node, its id and name among them."""
    fields = [F.struct(F.lit(name).alias("prop"), F.col(f"n.{name}").alias("value"), F.lit("string").alias("kind")) for name in ("id", "name")]

    def stated(entry):
        of = F.schema_of_variant(entry["value"])
        kind = F.when(of == "BOOLEAN", "bool").when(of == "STRING", "string").when(of.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(of != "VOID", "other")
        return F.struct(entry["key"].alias("prop"), F.try_variant_get(entry["value"], "$", "string").alias("value"), kind.alias("kind"))

    own = F.filter(F.array(*fields), lambda f: f["value"].isNotNull())
    props = F.coalesce(F.transform(F.map_entries("n.props"), stated), F.array().cast("array<struct<prop:string,value:string,kind:string>>"))
    each = nodes.select(F.col("n.type").alias("object_type"), "ord", F.posexplode(F.concat(own, props)).alias("at", "p"))
    return each.select("object_type", "p.prop", "p.value", "p.kind", (F.col("ord") * (1 << 20) + F.col("at")).alias("ord"))


def convert(spark: SparkSession, path: str, namespace: str, version: str = "0.1.0") -> Ontology:
    """The ontology of a scene file, checked.

    Links in the order of the relation keywords: with edges, the pair of types that occurs most; without, the type itself that
    owns the mapped property. A keyword that is the name of a property is none. Types in their order, those that some link
    has."""
    read = spark.read.schema(KINDS).json(path, multiLine=True)
    nodes = read.select(F.posexplode("nodes").alias("ord", "n")).where(F.coalesce("n.type", F.lit("")) != "").select(F.col("ord").cast("long").alias("ord"), "n")
    types = read.select(F.posexplode(F.map_entries("types")).alias("ord", "t")).select("ord", F.col("t.key").alias("object_type"), F.coalesce("t.value.label", "t.key").alias("label"))
    values, counts = _values(nodes), nodes.groupBy(F.col("n.type").alias("object_type")).agg(F.count(F.lit(1)).alias("instances"))
    profile = infer.property_profile(values, counts)
    known = nodes.where(F.coalesce("n.id", F.lit("")) != "").select(F.col("n.id").alias("id"), F.col("n.type").alias("object_type")).join(types.select("object_type"), "object_type", "left_semi")
    edges = read.select(F.posexplode("edges").alias("ord", "e")).select(F.col("e.rel").alias("rel"), F.col("e.source").alias("source_id"), F.col("e.target").alias("target_id"), F.coalesce("e.label", F.lit("")).alias("label"), "ord")
    by_edges = {r["rel"]: r for r in infer.link_types(edges, known).collect()}
    concepts = _concepts(read)
    owners = {r["rel"]: r["owner"] for r in infer.edgeless_owners(concepts, profile, counts, types).collect()}
    concept_labels = {r["rel"]: r["label"] for r in concepts.select("rel", "label").distinct().collect()}
    rels = [r[0] for r in read.select(F.posexplode(F.map_keys("relKeywords")).alias("ord", "rel")).orderBy("ord").select("rel").collect()]
    props = profile.join(prop_labels(read).withColumnRenamed("path", "prop"), "prop", "left").orderBy("prop_ord").collect()
    names = {r["prop"] for r in props}

    links = []
    for rel in rels:
        if rel in names:
            continue
        if rel in by_edges:
            r = by_edges[rel]
            links.append(LinkType(rel, r["display_name"], r["source_type"], r["target_type"], r["cardinality"]))
        elif rel in owners:
            links.append(LinkType(rel, concept_labels.get(rel) or rel, owners[rel], owners[rel], "MANY_TO_MANY"))
    used = {t for x in links for t in (x.source_type, x.target_type)}
    keys = {r["object_type"]: r["primary_key"] for r in infer.primary_keys(profile).collect()}
    made = []
    for t in types.orderBy("ord").collect():
        if t["object_type"] in used:
            own = [Property(r["prop"], r["label"] or r["prop"], r["data_type"], r["required"]) for r in props if r["object_type"] == t["object_type"]]
            key = keys.get(t["object_type"])
            made.append(ObjectType(t["object_type"], t["label"], own, [key] if key else []))
    scene_id = read.select("id").first()
    out = Ontology(namespace, version, made, links, metadata={"source_scene": (scene_id and scene_id[0]) or "", "source_file": str(path)})
    out.validate(spark)
    return out
