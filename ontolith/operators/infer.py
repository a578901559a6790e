"""Schema inference from instance data: property profiles, types, keys, link types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontolith.functions.scoring import DATE_LIKE, data_type

PROFILE = "object_type string, prop string, value string, kind string, ord long"


def property_profile(values: DataFrame, counts: DataFrame) -> DataFrame:
    """(object_type, prop, prop_ord, n, data_type, required) of each property.

    values: object_type, prop, value string, kind ('bool', 'number', 'string' or null), ord. counts: object_type, instances.
    A property is required if every instance has it; null values count as had.
    """
    stated = F.col("value").isNotNull()
    each = values.groupBy("object_type", "prop").agg(
        F.min("ord").alias("prop_ord"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(stated).alias("stated"),
        F.coalesce(F.bool_and(F.when(stated, F.col("kind") == "bool")), F.lit(False)).alias("all_bool"),
        F.coalesce(F.bool_and(F.when(stated, F.col("kind") == "number")), F.lit(False)).alias("all_numbers"),
        F.coalesce(F.bool_and(F.when(stated, (F.col("kind") == "string") & F.trim("value").rlike(DATE_LIKE))), F.lit(False)).alias("all_dates"),
    )
    kind = data_type(F.col("prop"), F.col("stated"), F.col("all_bool"), F.col("all_numbers"), F.col("all_dates"))
    joined = each.join(counts, "object_type")
    return joined.select("object_type", "prop", "prop_ord", "n", kind.alias("data_type"), ((F.col("instances") > 0) & (F.col("n") >= F.col("instances"))).alias("required"))


def primary_keys(profile: DataFrame) -> DataFrame:
    """(object_type, primary_key): id if there is one, else the first required property, else null."""
    choice = F.when(F.col("prop") == "id", F.struct(F.lit(0).cast("long").alias("o"), F.col("prop"))).when(F.col("required"), F.struct((F.col("prop_ord") + 1).alias("o"), F.col("prop")))
    return profile.groupBy("object_type").agg(F.min(choice).alias("c")).select("object_type", F.col("c.prop").alias("primary_key"))


def link_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rel, source_type, target_type, cardinality, display_name) of each relation with edges.

    The pair of types that occurs most, ties to the first seen; many-to-many if a target has two edges or more. edges: rel,
    source_id, target_id, label, ord. nodes: id, object_type.
    """
    kinds = nodes.select("id", "object_type").distinct()
    typed = edges.join(kinds.toDF("source_id", "source_type"), "source_id").join(kinds.toDF("target_id", "target_type"), "target_id")
    first = F.min("ord").alias("first")

    def most(*by: str) -> DataFrame:
        order = Window.partitionBy("rel").orderBy(F.desc("c"), "first")
        return typed.groupBy("rel", *by).agg(F.count(F.lit(1)).alias("c"), first).withColumn("r", F.row_number().over(order)).where("r = 1").select("rel", *by)

    fan = typed.groupBy("rel", "target_id").agg(F.count(F.lit(1)).alias("c")).groupBy("rel").agg(F.max("c").alias("most_in"))
    labels = most("label").withColumnRenamed("label", "display_name")
    cardinality = F.when(F.col("most_in") >= 2, "MANY_TO_MANY").otherwise("ONE_TO_MANY").alias("cardinality")
    return most("source_type", "target_type").join(fan, "rel").join(labels, "rel").select("rel", "source_type", "target_type", cardinality, F.coalesce("display_name", F.lit("")).alias("display_name"))


def edgeless_owners(paths: DataFrame, profile: DataFrame, counts: DataFrame, types: DataFrame) -> DataFrame:
    """(rel, owner) of keywords without edges: of the first property path that some type has, the type with the most instances,
    ties to the type that is declared first. paths: rel, path_ord, path. types: object_type, ord."""
    owned = paths.join(profile.select("object_type", F.col("prop").alias("path")), "path").join(types.select("object_type", F.col("ord").alias("type_ord")), "object_type")
    sized = owned.join(counts, "object_type", "left")
    order = Window.partitionBy("rel").orderBy("path_ord", F.desc(F.coalesce("instances", F.lit(0))), "type_ord")
    return sized.withColumn("r", F.row_number().over(order)).where("r = 1").select("rel", F.col("object_type").alias("owner"))
