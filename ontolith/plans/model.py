"""The driver tables as a typed object graph.

Objects: Region, Nation, Customer, Supplier, Part, Order, with ids R-, N-, C-, S-, P-, O- and the key. Links: inRegion, inNation,
placedBy. `ord` is a fixed ordinal: the key of the source, above a base for each kind (keys are below 10^15).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the ordinals of each kind of link begin.
BASE = {"inRegion": 1 * 10**15, "customerInNation": 2 * 10**15, "supplierInNation": 3 * 10**15, "placedBy": 4 * 10**15}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _objects(df: DataFrame, kind: str, letter: str, key: str, name: str, props: dict[str, str]) -> DataFrame:
    pairs = [x for k, c in props.items() for x in (F.lit(k), F.col(c).cast("string"))]
    return df.select(F.lit(kind).alias("object_type"), F.concat(F.lit(f"{letter}-"), F.col(key)).alias("id"), F.col(name).alias("name"), F.create_map(*pairs).alias("properties"), F.col(key).cast("long").alias("ord"))


def objects(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """object_type, id, name, properties, ord of the named kinds, or of all."""
    made = {
        "Region": lambda: _objects(table(spark, sf_dir, "region"), "Region", "R", "r_regionkey", "r_name", {"name": "r_name"}),
        "Nation": lambda: _objects(table(spark, sf_dir, "nation"), "Nation", "N", "n_nationkey", "n_name", {"name": "n_name"}),
        "Customer": lambda: _objects(table(spark, sf_dir, "customer"), "Customer", "C", "c_custkey", "c_name", {"name": "c_name", "segment": "c_mktsegment"}),
        "Supplier": lambda: _objects(table(spark, sf_dir, "supplier"), "Supplier", "S", "s_suppkey", "s_name", {"name": "s_name"}),
        "Part": lambda: _objects(table(spark, sf_dir, "part"), "Part", "P", "p_partkey", "p_name", {"name": "p_name", "brand": "p_brand", "type": "p_type"}),
        "Order": lambda: _objects(table(spark, sf_dir, "orders").withColumn("name", F.concat(F.lit("Order "), "o_orderkey")), "Order", "O", "o_orderkey", "name", {"status": "o_orderstatus", "priority": "o_orderpriority"}),
    }
    return reduce(DataFrame.unionByName, [made[k]() for k in kinds or made])


def links(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """link_type, source_id, target_id, ord of the named kinds (keys of BASE), or of all."""

    def made(kind: str) -> DataFrame:
        name, source, s, target, t = {
            "inRegion": ("nation", "N", "n_nationkey", "R", "n_regionkey"),
            "customerInNation": ("customer", "C", "c_custkey", "N", "c_nationkey"),
            "supplierInNation": ("supplier", "S", "s_suppkey", "N", "s_nationkey"),
            "placedBy": ("orders", "O", "o_orderkey", "C", "o_custkey"),
        }[kind]
        df = table(spark, sf_dir, name).select(F.col(s).cast("long").alias("s"), F.col(t).cast("long").alias("t"))
        link_type = "inNation" if kind.endswith("InNation") else kind
        return df.select(F.lit(link_type).alias("link_type"), F.concat(F.lit(f"{source}-"), "s").alias("source_id"), F.concat(F.lit(f"{target}-"), "t").alias("target_id"), (F.col("s") + BASE[kind]).alias("ord"))

    return reduce(DataFrame.unionByName, [made(k) for k in kinds or BASE])


LINK_SQL = {
    "inRegion": "select 'inRegion' as link_type, 'N-' || n_nationkey as source_id, 'R-' || n_regionkey as target_id, 1000000000000000 + n_nationkey as ord from nation",
    "customerInNation": "select 'inNation' as link_type, 'C-' || c_custkey as source_id, 'N-' || c_nationkey as target_id, 2000000000000000 + c_custkey as ord from customer",
    "supplierInNation": "select 'inNation' as link_type, 'S-' || s_suppkey as source_id, 'N-' || s_nationkey as target_id, 3000000000000000 + s_suppkey as ord from supplier",
    "placedBy": "select 'placedBy' as link_type, 'O-' || o_orderkey as source_id, 'C-' || o_custkey as target_id, 4000000000000000 + o_orderkey as ord from orders",
}
OBJECT_SQL = {
    "Region": "select 'Region' as object_type, 'R-' || r_regionkey as id, r_name as name, r_regionkey::bigint as ord, 1 as keys from region",
    "Nation": "select 'Nation', 'N-' || n_nationkey, n_name, n_nationkey::bigint, 1 from nation",
    "Customer": "select 'Customer', 'C-' || c_custkey, c_name, c_custkey, 2 from customer",
    "Supplier": "select 'Supplier', 'S-' || s_suppkey, s_name, s_suppkey, 1 from supplier",
    "Part": "select 'Part', 'P-' || p_partkey, p_name, p_partkey, 3 from part",
    "Order": "select 'Order', 'O-' || o_orderkey, 'Order ' || o_orderkey, o_orderkey, 2 from orders",
}
ALL_OBJECTS_SQL = " union all ".join(OBJECT_SQL.values())
EDGES_SQL = "select source_id as id, target_id as other, link_type, 'out' as direction, ord from l union all select target_id, source_id, link_type, 'in', ord from l"


def links_sql(*kinds: str) -> str:
    return " union all ".join(LINK_SQL[k] for k in kinds)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, vec): a question for each label, the mean of its vectors."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    mean = each.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).select(F.col("label").alias("question_id"), F.col("v.x").alias("vec"))


def vector_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, object_type, text, prov, vec, ord): embeddings as objects, their label as the type."""
    label = F.concat(F.lit("T"), "label")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("object_type"), F.concat(F.lit("vector "), "vec_id", F.lit(" of "), label).alias("text"), F.lit("store:embeddings").alias("prov"), F.col("embedding").cast("array<double>").alias("vec"), F.col("vec_id").alias("ord"))


def vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near: vector i -> vector (7 i + 1) mod n."""
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    n = v.agg(F.count(F.lit(1)).alias("n"))
    return v.join(F.broadcast(n)).select(F.lit("near").alias("link_type"), F.col("vec_id").alias("source_id"), ((F.col("vec_id") * 7 + 1) % F.col("n")).alias("target_id"), F.col("vec_id").alias("ord"))


CENTROIDS_SQL = "select label as question_id, list(x order by k) as vec from (select label, k, avg(x::double) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as k from embeddings) group by label, k) group by label"
#: hits (question_id, id, score, rank) of 24 recalled vectors, seeds of the linked type, their neighbours and the fused evidence.
HYBRID_SQL = f"""
    q as ({CENTROIDS_SQL}),
    scored as (select question_id, vec_id as id, label, list_cosine_similarity(vec, embedding::double[]) as score from q, embeddings),
    hits as (select * from (select *, row_number() over (partition by question_id order by score desc, id) as rank from scored) where rank <= 24),
    seeds as (select * from (select question_id, id, label, score, row_number() over (partition by question_id order by score desc, id) as seed_rank from hits where label = question_id) where seed_rank <= 8),
    l as (select 'near' as link_type, vec_id as source_id, (7 * vec_id + 1) % (select count(*) from embeddings) as target_id, vec_id as ord from embeddings),
    e as ({EDGES_SQL}),
    h1 as (select seed, other as id, row_number() over (partition by seed order by way, other) as r from (select s.id as seed, e.other, min((e.ord, e.direction)) as way from (select distinct id from seeds) s join e on s.id = e.id where e.other <> s.id group by all)),
    h2 as (select seed, other as id, row_number() over (partition by seed order by way, other) as r from (select h1.seed, e.other, min((h1.r, e.ord, e.direction)) as way from h1 join e on h1.id = e.id where e.other <> h1.seed and not exists (select 1 from h1 x where x.seed = h1.seed and x.id = e.other) group by all)),
    near as (select seed, id, row_number() over (partition by seed order by hop, r) as rank from (select seed, id, 1 as hop, r from h1 union all select seed, id, 2, r from h2)),
    found as (select s.question_id, n.id, min((s.seed_rank, n.rank, s.id)) as by_ from seeds s join near n on n.seed = s.id and n.rank <= 5 group by all),
    candidates as (
        select s.question_id, s.id, 'store:embeddings' as prov, least(s.score * 0.6 + case when f.id is not null then 0.25 else 0.0 end * 0.4, 1.0) as score, seed_rank, null as by_ from seeds s left join found f using (question_id, id)
        union all select f.question_id, f.id, 'graph:' || f.by_[3], 0.25 * 0.4, null, f.by_ from found f anti join seeds s using (question_id, id)
    ),
    evidence as (
        select c.*, n from (select *, row_number() over (partition by question_id order by score desc, seed_rank nulls last, by_[1], by_[2], id) as n from candidates) c where n <= 24
    )
"""
