"""The ontology: types, properties, links and actions; YAML, catalogue tables, validation and RDF export."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: The types of properties and their Spark and XSD types.
SPARK_TYPES = {"STRING": S.StringType(), "DOUBLE": S.DoubleType(), "INT64": S.LongType(), "BOOL": S.BooleanType(), "TIMESTAMP": S.TimestampType(), "JSON": S.StringType()}
XSD = {"STRING": "string", "DOUBLE": "double", "INT64": "long", "BOOL": "boolean", "TIMESTAMP": "dateTime", "JSON": "string"}
CARDINALITIES = ("ONE_TO_ONE", "ONE_TO_MANY", "MANY_TO_MANY")
#: The forms of names.
TYPE_NAME, MEMBER_NAME, PRECONDITION = r"^[A-Z][A-Za-z0-9]*$", r"^[a-z][A-Za-z0-9_]*$", r"^[a-z0-9_.:-]+$"
NAMESPACE, VERSION = r"^[a-z][a-z0-9_.]*$", r"^\d+\.\d+\.\d+$"
BASE_IRI = "https://example.org/ontology/{namespace}#"
RDF, RDFS, OWL, SH, XSD_IRI = (
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/ns/shacl#", "http://www.w3.org/2001/XMLSchema#",
)


class OntologyError(ValueError):
    pass


def _named(value: str, pattern: str, what: str) -> None:
    if not re.match(pattern, value or ""):
        raise OntologyError(f"{what} {value!r} must match {pattern}")


@dataclass
class Property:
    api_name: str
    display_name: str = ""
    data_type: str = "STRING"
    required: bool = False
    description: str = ""
    enum_values: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        _named(self.api_name, MEMBER_NAME, "property")
        if self.data_type not in XSD:
            raise OntologyError(f"property {self.api_name!r} has unknown data_type {self.data_type!r}")


@dataclass
class ObjectType:
    api_name: str
    display_name: str = ""
    properties: list[Property] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    parent: str = ""
    description: str = ""

    def __post_init__(self) -> None:
        _named(self.api_name, TYPE_NAME, "object type")
        self.properties = [p if isinstance(p, Property) else Property(**p) for p in self.properties]


@dataclass
class LinkType:
    api_name: str
    display_name: str = ""
    source_type: str = ""
    target_type: str = ""
    cardinality: str = "MANY_TO_MANY"
    properties: list[Property] = field(default_factory=list)

    def __post_init__(self) -> None:
        _named(self.api_name, MEMBER_NAME, "link type")
        if self.cardinality not in CARDINALITIES:
            raise OntologyError(f"link type {self.api_name!r} has unknown cardinality {self.cardinality!r}")
        self.properties = [p if isinstance(p, Property) else Property(**p) for p in self.properties]


@dataclass
class ActionType:
    api_name: str
    display_name: str = ""
    target_types: list[str] = field(default_factory=list)
    parameters: list[Property] = field(default_factory=list)
    preconditions: list[str] = field(default_factory=list)
    approval_policy: str = "none"  # none, single or two_level by convention; not checked
    rollback_handler: str = ""

    def __post_init__(self) -> None:
        _named(self.api_name, MEMBER_NAME, "action type")
        self.parameters = [p if isinstance(p, Property) else Property(**p) for p in self.parameters]


@dataclass
class Ontology:
    namespace: str
    version: str = "0.1.0"
    object_types: list[ObjectType] = field(default_factory=list)
    link_types: list[LinkType] = field(default_factory=list)
    action_types: list[ActionType] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        _named(self.namespace, NAMESPACE, "namespace")
        _named(self.version, VERSION, "version")
        for name, kind in (("object_types", ObjectType), ("link_types", LinkType), ("action_types", ActionType)):
            setattr(self, name, [x if isinstance(x, kind) else kind(**x) for x in getattr(self, name)])

    @classmethod
    def load(cls, path: str | Path) -> Ontology:
        import yaml

        return cls(**yaml.safe_load(Path(path).read_text(encoding="utf-8")))

    def to_yaml(self) -> str:
        import yaml

        class Indented(yaml.SafeDumper):
            def increase_indent(self, flow: bool = False, indentless: bool = False):  # noqa: ARG002
                return super().increase_indent(flow, False)

        return yaml.dump(asdict(self), Dumper=Indented, allow_unicode=True, sort_keys=False)

    def dump(self, path: str | Path) -> None:
        Path(path).write_text(self.to_yaml(), encoding="utf-8")

    def struct_type(self, object_type: str) -> S.StructType:
        """The Spark schema of an object type, labels and enumerations as metadata."""
        own = next(o for o in self.object_types if o.api_name == object_type)
        return S.StructType([S.StructField(p.api_name, SPARK_TYPES[p.data_type], not p.required, {"display_name": p.display_name, "description": p.description, "enum": p.enum_values}) for p in own.properties])

    def catalog(self, spark: SparkSession) -> dict[str, DataFrame]:
        """object_types, properties, link_types, action_types as DataFrames with ordinals."""
        props = [(kind, owner.api_name, k, p.api_name, p.display_name, p.data_type, p.required, p.description, p.enum_values) for kind, owners in (("object", self.object_types), ("link", self.link_types)) for owner in owners for k, p in enumerate(owner.properties)]
        props += [("action", a.api_name, k, p.api_name, p.display_name, p.data_type, p.required, p.description, p.enum_values) for a in self.action_types for k, p in enumerate(a.parameters)]
        objects = [(k, o.api_name, o.display_name, o.primary_key, o.parent, o.description) for k, o in enumerate(self.object_types)]
        links = [(k, x.api_name, x.display_name, x.source_type, x.target_type, x.cardinality) for k, x in enumerate(self.link_types)]
        actions = [(k, a.api_name, a.display_name, a.target_types, a.preconditions, a.approval_policy, a.rollback_handler) for k, a in enumerate(self.action_types)]
        return {
            "object_types": spark.createDataFrame(objects, "ord int, api_name string, display_name string, primary_key array<string>, parent string, description string"),
            "properties": spark.createDataFrame(props, "owner_kind string, owner string, ord int, api_name string, display_name string, data_type string, required boolean, description string, enum_values array<string>"),
            "link_types": spark.createDataFrame(links, "ord int, api_name string, display_name string, source_type string, target_type string, cardinality string"),
            "action_types": spark.createDataFrame(actions, "ord int, api_name string, display_name string, target_types array<string>, preconditions array<string>, approval_policy string, rollback_handler string"),
        }

    def validate(self, spark: SparkSession) -> None:
        """Raises one error that lists all problems."""
        found = [r["problem"] for r in problems(self.catalog(spark)).orderBy("problem").collect()]
        if found:
            raise OntologyError(f"ontology {self.namespace!r} v{self.version} has {len(found)} problem(s):\n" + "\n".join(f"  - {p}" for p in found))

    def prompt_view(self) -> str:
        """What a provider is told: names, enumerations, keys and endpoints, as JSON."""
        objects = [{"name": o.api_name, "key": o.primary_key, "properties": [{"name": p.api_name, "type": p.data_type, **({"enum": p.enum_values} if p.enum_values else {})} for p in o.properties]} for o in self.object_types]
        links = [{"name": x.api_name, "source": x.source_type, "target": x.target_type} for x in self.link_types]
        return json.dumps({"object_types": objects, "link_types": links}, ensure_ascii=False)


def parent_cycles(types: DataFrame) -> DataFrame:
    """(api_name, chain) of every type whose parents lead into a cycle: chain is the way to the first repeat, joined by ' -> '.
    One join a step; a chain has at most as many steps as there are types."""
    up = types.where(F.coalesce("parent", F.lit("")) != "").select(F.col("api_name").alias("at"), "parent").distinct()
    walk = up.select(F.col("at").alias("api_name"), F.array("at").alias("chain"), "parent")
    out = None
    for _ in range(types.count() + 1):
        repeat = F.array_contains("chain", F.col("parent"))
        done = walk.where(repeat).select("api_name", F.array_join(F.concat("chain", F.array("parent")), " -> ").alias("chain"))
        out = done if out is None else out.unionByName(done)
        walk = walk.where(~repeat).join(up.toDF("next", "next_parent"), F.col("parent") == F.col("next")).select("api_name", F.concat("chain", F.array("parent")).alias("chain"), F.col("next_parent").alias("parent"))
        if walk.isEmpty():
            break
    return out


def problems(catalog: dict[str, DataFrame]) -> DataFrame:
    """(problem): every fault of a catalogue as a row; a union of relational checks."""
    objects, props, links, actions = (catalog[k] for k in ("object_types", "properties", "link_types", "action_types"))
    known = objects.select(F.col("api_name").alias("known")).distinct()
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    out = []
    for df, what in ((objects, "object type"), (links, "link type"), (actions, "action type")):
        out.append(df.groupBy("api_name").count().where("count > 1").select(F.concat(F.lit(f"duplicate {what} "), quoted(F.col("api_name"))).alias("problem")))
    for end in ("source_type", "target_type"):
        lost = links.join(known, F.col(end) == F.col("known"), "left_anti")
        out.append(lost.select(F.concat(F.lit("link type "), quoted(F.col("api_name")), F.lit(f": {end} "), quoted(F.col(end)), F.lit(" is not known"))))
    lost = actions.select("api_name", F.explode("target_types").alias("target")).join(known, F.col("target") == F.col("known"), "left_anti")
    out.append(lost.select(F.concat(F.lit("action type "), quoted(F.col("api_name")), F.lit(": target_type "), quoted(F.col("target")), F.lit(" is not known"))))
    odd = actions.select("api_name", F.explode("preconditions").alias("p")).where(~F.col("p").rlike(PRECONDITION))
    out.append(odd.select(F.concat(F.lit("action type "), quoted(F.col("api_name")), F.lit(": precondition "), quoted(F.col("p")), F.lit(" has a wrong form"))))
    lost = objects.where("parent != ''").join(known, F.col("parent") == F.col("known"), "left_anti")
    out.append(lost.select(F.concat(F.lit("object type "), quoted(F.col("api_name")), F.lit(": parent "), quoted(F.col("parent")), F.lit(" is not known"))))
    cycles = parent_cycles(objects)
    out.append(cycles.select(F.concat(F.lit("parent cycle: "), "chain")))
    owner = F.concat("owner_kind", F.lit(" type "), quoted(F.col("owner")))
    out.append(props.groupBy("owner_kind", "owner", "api_name").count().where("count > 1").select(F.concat(owner, F.lit(": duplicate property "), quoted(F.col("api_name")))))
    out.append(props.where((F.size("enum_values") > 0) & (F.col("data_type") != "STRING")).select(F.concat(owner, F.lit(": property "), quoted(F.col("api_name")), F.lit(" has enum_values but is "), "data_type")))
    keys = objects.select(F.col("api_name").alias("owner"), F.explode("primary_key").alias("key"))
    own = props.where("owner_kind = 'object'").select("owner", F.col("api_name").alias("key"), "data_type", "required").dropDuplicates(["owner", "key"])
    joined = keys.join(own, ["owner", "key"], "left")
    fault = (
        F.when(F.col("data_type").isNull(), " is no property")
        .when(~F.col("required"), " is not required")
        .when(F.col("data_type").isin("TIMESTAMP", "JSON"), F.concat(F.lit(" cannot be "), "data_type"))
    )
    out.append(joined.select(F.concat(F.lit("object type "), quoted(F.col("owner")), F.lit(": primary_key "), quoted(F.col("key")), fault)).where(fault.isNotNull()))
    total = out[0]
    for part in out[1:]:
        total = total.union(part)
    return total


def _iri(value: object) -> object:
    return F.concat(F.lit("<"), value, F.lit(">"))


def triples(catalog: dict[str, DataFrame], namespace: str) -> DataFrame:
    """(s, p, o, literal) of the classes, datatype properties and object properties."""
    base = BASE_IRI.format(namespace=namespace)
    objects, props, links = catalog["object_types"], catalog["properties"].where("owner_kind = 'object'"), catalog["link_types"]
    cls = F.concat(F.lit(base), "api_name")
    prop = F.concat(F.lit(base), "owner", F.lit("."), "api_name")

    def rows(df: DataFrame, s, p: str, o, literal: bool = False) -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"))

    parts = [
        rows(objects, cls, f"{RDF}type", F.lit(f"{OWL}Class")),
        rows(objects, cls, f"{RDFS}label", F.col("display_name"), True),
        rows(objects.where("description != ''"), cls, f"{RDFS}comment", F.col("description"), True),
        rows(objects.where("parent != ''"), cls, f"{RDFS}subClassOf", F.concat(F.lit(base), "parent")),
        rows(props, prop, f"{RDF}type", F.lit(f"{OWL}DatatypeProperty")),
        rows(props, prop, f"{RDFS}domain", F.concat(F.lit(base), "owner")),
        rows(props, prop, f"{RDFS}range", _xsd()),
        rows(props, prop, f"{RDFS}label", F.col("display_name"), True),
        rows(props.where("description != ''"), prop, f"{RDFS}comment", F.col("description"), True),
        rows(links, cls, f"{RDF}type", F.lit(f"{OWL}ObjectProperty")),
        rows(links, cls, f"{RDFS}domain", F.concat(F.lit(base), "source_type")),
        rows(links, cls, f"{RDFS}range", F.concat(F.lit(base), "target_type")),
        rows(links, cls, f"{RDFS}label", F.col("display_name"), True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def _xsd():
    out = F.lit(f"{XSD_IRI}string")
    for kind, xsd in XSD.items():
        out = F.when(F.col("data_type") == kind, f"{XSD_IRI}{xsd}").otherwise(out)
    return out


def shapes(catalog: dict[str, DataFrame], namespace: str) -> DataFrame:
    """(s, p, o, literal) of a node shape for each object type and a property shape for each of its properties."""
    base = BASE_IRI.format(namespace=namespace)
    objects, props = catalog["object_types"], catalog["properties"].where("owner_kind = 'object'")
    cls, path = F.concat(F.lit(base), "api_name"), F.concat(F.lit(base), "owner", F.lit("."), "api_name")
    shape, prop_shape = F.concat(cls, F.lit("Shape")), F.concat(path, F.lit("Shape"))

    def rows(df: DataFrame, s, p: str, o, literal: bool = False) -> DataFrame:
        return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(literal).alias("literal"))

    parts = [
        rows(objects, shape, f"{RDF}type", F.lit(f"{SH}NodeShape")),
        rows(objects, shape, f"{SH}targetClass", cls),
        rows(objects, shape, f"{RDFS}label", F.concat("display_name", F.lit(" node shape")), True),
        rows(props, F.concat(F.lit(base), "owner", F.lit("Shape")), f"{SH}property", prop_shape),
        rows(props, prop_shape, f"{RDF}type", F.lit(f"{SH}PropertyShape")),
        rows(props, prop_shape, f"{SH}path", path),
        rows(props, prop_shape, f"{SH}datatype", _xsd()),
        rows(props.where("required"), prop_shape, f"{SH}minCount", F.lit("1"), True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def n_triples(graph: DataFrame) -> DataFrame:
    """(value): one N-Triples line for each triple, which is also Turtle."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    target = F.when(F.col("literal"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(_iri(F.col("o")))
    return graph.select(F.concat_ws(" ", _iri(F.col("s")), _iri(F.col("p")), target, F.lit(".")).alias("value"))


def json_ld(graph: DataFrame) -> DataFrame:
    """(value): one JSON-LD node for each subject."""
    value = F.when(F.col("literal"), F.to_json(F.struct(F.col("o").alias("@value")))).otherwise(F.to_json(F.struct(F.col("o").alias("@id"))))
    by_p = graph.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("v"))
    entry = F.concat(F.lit('"'), "p", F.lit('":['), "v", F.lit("]"))
    return by_p.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("e")).select(F.concat(F.lit('{"@id":"'), "s", F.lit('",'), "e", F.lit("}")).alias("value"))


def check_instances(objects: DataFrame, catalog: dict[str, DataFrame]) -> DataFrame:
    """(object_type, id, prop, message) for each object that lacks a required property or has a value of another type.
    objects: object_type, id, properties map<string,string>. Objects without a known type conform."""
    props = catalog["properties"].where("owner_kind = 'object'").select(F.col("owner").alias("object_type"), F.col("api_name").alias("prop"), "data_type", "required")
    value = F.element_at("properties", F.col("prop"))
    fits = (
        F.when(F.col("data_type") == "DOUBLE", value.try_cast("double").isNotNull())
        .when(F.col("data_type") == "INT64", value.try_cast("long").isNotNull())
        .when(F.col("data_type") == "BOOL", value.try_cast("boolean").isNotNull())
        .when(F.col("data_type") == "TIMESTAMP", value.try_cast("timestamp").isNotNull())
        .otherwise(True)
    )
    message = F.when(value.isNull() & F.col("required"), "less than 1 value").when(value.isNotNull() & ~fits, F.concat(F.lit("value is not "), "data_type"))
    return objects.join(props, "object_type").select("object_type", "id", "prop", message.alias("message")).where("message is not null")
