"""The registered queries of the object-graph engine, each over its whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontolith.functions import scoring, vectors
from ontolith.functions import text as T
from ontolith.operators import evaluate, evidence, govern, graph, infer, resolve, retrieve, scene, store
from ontolith.plans import evaluation
from ontolith.plans import ontology as O
from ontolith.plans.model import ALL_OBJECTS_SQL, HYBRID_SQL, LINK_SQL, centroids, links, links_sql, objects, table, vector_links, vector_objects
from ontolith.plans.scratch import Scratch
from ontolith.sources.files import clean_lines
from ontolith.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def joined_map(c) -> object:
    """A map as k=v;k=v in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")


# ---- store


@query("select 'C-' || c_custkey as id, c_name as name, c_mktsegment as segment from customer")
def get_objects(spark, d):
    found = store.get_objects(objects(spark, d), "Customer")
    return found.select("id", "name", F.element_at("properties", "segment").alias("segment"))


@query("select 'C-' || c_custkey as id, c_name as name from customer where c_custkey in (select o_custkey from orders)")
def get_objects_by_ids(spark, d):
    ids = links(spark, d, "placedBy").select(F.col("target_id").alias("id"))
    return store.get_objects(objects(spark, d, "Customer"), "Customer", ids).select("id", "name")


LINE_ORDER = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _line_objects(spark, d):
    """Each line as a write to its order: properties that later lines change, one that only some lines set."""
    line = table(spark, d, "lineitem")
    props = F.map_filter(
        F.create_map(F.lit("status"), F.col("l_linestatus"), F.lit("shipped"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("returned"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string"))),
        lambda _, v: v.isNotNull(),
    )
    return line.select(F.lit("Order").alias("object_type"), F.concat(F.lit("O-"), "l_orderkey").alias("id"), props.alias("properties"), F.concat(F.lit("line:"), "l_partkey").alias("prov"), F.struct(*LINE_ORDER).alias("ord"))


_ORDERED = "row_number() over (partition by l_orderkey order by " + ", ".join(LINE_ORDER) + ")"


@query(f"""
    with w as (select *, {_ORDERED} as o from lineitem),
    m as (select l_orderkey, arg_max(l_linestatus, o) as status, arg_max(strftime(l_shipdate, '%Y-%m-%d'), o) as shipped,
        arg_max(l_partkey, o) filter (l_returnflag = 'R') as returned, arg_max(l_partkey, o) as part from w group by 1)
    select 'O-' || l_orderkey as id, case when returned is null then '' else 'returned=' || returned || ';' end || 'shipped=' || shipped || ';status=' || status as properties, 'line:' || part as prov from m
""")
def upsert_objects_merge(spark, d):
    return store.upsert_objects(None, _line_objects(spark, d)).select("id", joined_map("properties").alias("properties"), "prov")


@query(f"""
    with w as (select *, {_ORDERED} as o, count(*) over (partition by l_orderkey) as n from lineitem)
    select 'O-' || l_orderkey as id, case when l_returnflag = 'R' then 'returned=' || l_partkey || ';' else '' end || 'shipped=' || strftime(l_shipdate, '%Y-%m-%d') || ';status=' || l_linestatus as properties from w where o = n
""")
def upsert_objects_replace(spark, d):
    return store.upsert_objects(None, _line_objects(spark, d), mode="replace").select("id", joined_map("properties").alias("properties"))


@query("""
    with w as (select l_partkey, l_suppkey, l_linestatus, row_number() over (partition by l_partkey, l_suppkey order by l_shipdate, l_linenumber, l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax) as o from lineitem)
    select 'P-' || l_partkey as source_id, 'S-' || l_suppkey as target_id, 'status=' || arg_max(l_linestatus, o) as properties from w group by l_partkey, l_suppkey
""")
def upsert_links_merge(spark, d):
    line = table(spark, d, "lineitem")
    place = F.struct("l_shipdate", "l_linenumber", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("ord")
    writes = line.select(F.lit("suppliedBy").alias("link_type"), F.concat(F.lit("P-"), "l_partkey").alias("source_id"), F.concat(F.lit("S-"), "l_suppkey").alias("target_id"), F.create_map(F.lit("status"), F.col("l_linestatus")).alias("properties"), F.lit("").alias("prov"), place)
    known = objects(spark, d, "Part", "Supplier")
    return store.upsert_links(None, writes, known).select("source_id", "target_id", joined_map("properties").alias("properties"))


@query("select 'O-' || o_orderkey as source_id, 'C-' || o_custkey as target_id from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0)")
def dangling_links(spark, d):
    active = table(spark, d, "customer").where("c_acctbal >= 0").select(F.concat(F.lit("C-"), "c_custkey").alias("id"))
    return store.dangling(links(spark, d, "placedBy"), objects(spark, d, "Order").select("id").unionByName(active)).select("source_id", "target_id")


# ---- graph


@query(f"""
    with l as ({links_sql("inRegion", "customerInNation", "supplierInNation")}),
    h1 as (select target_id as seed, source_id as id, row_number() over (partition by target_id order by ord) as r from l where link_type = 'inRegion'),
    h2 as (select h1.seed, l.source_id as id, row_number() over (partition by h1.seed order by h1.r, l.ord) as r from h1 join l on l.target_id = h1.id and l.link_type = 'inNation')
    select seed, id, hop, row_number() over (partition by seed order by hop, r)::integer as rank from (select seed, id, 1 as hop, r from h1 union all select seed, id, 2, r from h2)
""")
def neighbors_bfs_2hop(spark, d):
    known = objects(spark, d, "Region", "Nation", "Customer", "Supplier")
    edges = graph.adjacency(links(spark, d, "inRegion", "customerInNation", "supplierInNation"))
    return graph.neighbors(edges, objects(spark, d, "Region"), objects=known)


@query("select 'C-' || o_custkey as seed, 'O-' || o_orderkey as id, 1 as hop, row_number() over (partition by o_custkey order by o_orderkey)::integer as rank from orders")
def neighbors_link_filter(spark, d):
    edges = graph.adjacency(links(spark, d, "placedBy", "customerInNation"))
    return graph.neighbors(edges, objects(spark, d, "Customer"), link_type="placedBy", objects=objects(spark, d, "Order", "Customer", "Nation"))


@query(f"""
    with l as ({links_sql("inRegion", "customerInNation", "supplierInNation")}),
    a as (select target_id as seed, source_id as mid, ord as o1 from l where link_type = 'inRegion'),
    b as (select seed, mid, o1, source_id as far, ord as o2 from a join l on l.target_id = a.mid and l.link_type = 'inNation')
    select seed, o1::varchar as path, 1 as length, 1 as depth, mid as node, 'inRegion' as link_type from a
    union all select seed, o1 || '-' || o2, 2, 1, mid, 'inRegion' from b
    union all select seed, o1 || '-' || o2, 2, 2, far, 'inNation' from b
""")
def path_hops_trail(spark, d):
    edges = graph.adjacency(links(spark, d, "inRegion", "customerInNation", "supplierInNation"))
    return graph.trails(edges, objects(spark, d, "Region"), 2).drop("ord")


@query(f"""
    with r as ({LINK_SQL["inRegion"]}), s as ({LINK_SQL["supplierInNation"]}),
    found as (
        select source_id, target_id, link_type, true as hit, (substr(target_id, 3)::bigint, ord, -1::bigint) as place from r
        union all select s.source_id, s.target_id, s.link_type, false, (substr(r.target_id, 3)::bigint, r.ord, s.ord) from s join r on s.target_id = r.source_id
    )
    select source_id, target_id, link_type, hit, row_number() over (order by not hit, link_type, place, source_id, target_id)::integer as rank from found
""")
def two_hop_edges(spark, d):
    edges = graph.adjacency(links(spark, d, "inRegion", "supplierInNation"))
    return graph.two_hop_edges(edges, objects(spark, d, "Region"), ["inRegion"])


@query(f"""
    with l as ({links_sql("inRegion", "customerInNation")}), f as (select 'N-' || n_nationkey as focus from nation),
    e as (select focus, link_type, source_id, target_id from f join l on source_id = focus or target_id = focus)
    select focus, 'edge' as kind, null as id, source_id, target_id, link_type from e
    union all select focus, 'node', id, null, null, null from (select focus, unnest([source_id, target_id]) as id from e union select focus, focus from f)
""")
def ego_graph(spark, d):
    known = objects(spark, d, "Region", "Nation", "Customer")
    return graph.ego_graph(known, links(spark, d, "inRegion", "customerInNation"), objects(spark, d, "Nation"))


@query(f"""
    with o as ({ALL_OBJECTS_SQL}), l as ({links_sql("inRegion", "customerInNation", "supplierInNation", "placedBy")}),
    ends as (select ord, source_id as id from l union all select ord, target_id from l),
    c as (select object_type, count(distinct ends.ord) as links from ends join o using (id) group by 1),
    f as (select object_type, string_agg(id, ',' order by k) as first_three from (select object_type, id, row_number() over (partition by object_type order by ord, id) as k from o) where k <= 3 group by 1)
    select object_type, count(*) as objects, max(keys)::bigint as prop_keys, any_value(first_three) as first_three, coalesce(any_value(links), 0) as links
    from o join f using (object_type) left join c using (object_type) group by object_type
""")
def type_cards(spark, d):
    known = links(spark, d, "inRegion", "customerInNation", "supplierInNation", "placedBy")
    return graph.incident_counts(objects(spark, d), known)


# ---- resolution


@query("""
    with w as (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as o from lineitem)
    select l_orderkey, l_linenumber, arg_min('part:' || l_partkey, o) as prov, coalesce(string_agg('part:' || l_partkey, ',' order by o) filter (o > 1), '') as absorbed,
        'flag=' || arg_max(l_returnflag, o) || ';status=' || arg_max(l_linestatus, o) as properties
    from w group by 1, 2
""")
def resolve_by_key(spark, d):
    line = table(spark, d, "lineitem")
    place = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("ord")
    props = F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus")).alias("properties")
    records = line.select("l_orderkey", "l_linenumber", place, props, F.concat(F.lit("part:"), "l_partkey").alias("prov"))
    merged = resolve.merge_by_key(records, ["l_orderkey", "l_linenumber"])
    return merged.select("l_orderkey", "l_linenumber", "prov", F.array_join("absorbed", ",").alias("absorbed"), joined_map("properties").alias("properties"))


#: The embeddings have no pair near the default of 0.92.
PAIR_THRESHOLD = 0.35
_PAIRS = f"""
    pairs as (select a.label, a.vec_id as a, b.vec_id as b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine
        from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= {PAIR_THRESHOLD})
"""
_CLUSTERS = f"""
    {_PAIRS}, e as (select a as u, b as v from pairs union select b, a from pairs),
    reach as (select u, v from e union select r.u, e.v from reach r join e on r.v = e.u),
    clusters as (select u as ord, least(u, min(v)) as survivor from reach group by u)
"""


def _pairs(spark, d):
    return resolve.similar_pairs(vector_objects(spark, d).select("object_type", "ord", "vec"), PAIR_THRESHOLD)


@query(f"with {_PAIRS} select 'T' || label as object_type, a, b, round(cosine, 6) as cosine from pairs")
def resolve_pairs(spark, d):
    return _pairs(spark, d).withColumn("cosine", F.round("cosine", 6))


@query(f"with recursive {_CLUSTERS} select ord, survivor from clusters")
def resolve_components(spark, d):
    return resolve.clusters(_pairs(spark, d))


@query(f"""
    with recursive {_CLUSTERS}, m as (select ord, survivor from clusters where ord <> survivor),
    l as (select vec_id as s, (7 * vec_id + 1) % (select count(*) from embeddings) as t from embeddings)
    select coalesce(x.survivor, s) as source_id, coalesce(y.survivor, t) as target_id from l left join m x on x.ord = s left join m y on y.ord = t
""")
def alias_redirect(spark, d):
    records = vector_objects(spark, d).select("ord", "id")
    aliases = resolve.alias_map(records, resolve.clusters(_pairs(spark, d)))
    return resolve.redirect(vector_links(spark, d), aliases).select("source_id", "target_id")


# ---- retrieval


@query(f"with {HYBRID_SQL} select question_id, id, rank::integer as rank, round(score, 6) as score from hits")
def vector_topk(spark, d):
    found = retrieve.vector_search(centroids(spark, d), vector_objects(spark, d), 24)
    return found.select("question_id", "id", "rank", F.round("score", 6).alias("score"))


def _linked(spark, d):
    q = table(spark, d, "embeddings").select("label").distinct()
    return q.select(F.col("label").alias("question_id"), F.concat(F.lit("T"), "label").alias("object_type"), F.lit(0).alias("ord"))


@query(f"with {HYBRID_SQL} select question_id, id, 'T' || label as object_type, rank::integer as rank from hits where label = question_id")
def type_filter_post_recall(spark, d):
    v = vector_objects(spark, d)
    hits = retrieve.vector_search(centroids(spark, d), v, 24).join(v.select("id", "object_type"), "id")
    return retrieve.of_linked_types(hits, _linked(spark, d)).select("question_id", "id", "object_type", "rank")


def _evidence(spark, d):
    v = vector_objects(spark, d)
    return retrieve.hybrid(centroids(spark, d), v, _linked(spark, d), graph.adjacency(vector_links(spark, d)), v)


def _written_evidence(spark, d):
    """Evidence that several steps read, made once."""
    return Scratch(spark, "evidence").write(_evidence(spark, d), "evidence")


@query(f"""
    with {HYBRID_SQL}
    select question_id, 'E' || n as evidence_id, id as object_id, 'T' || label as object_type, 'vector ' || id || ' of T' || label as text, prov as provenance, round(score, 6) as score
    from evidence join (select vec_id as id, label from embeddings) using (id)
""")
def hybrid_retrieve(spark, d):
    return _evidence(spark, d).withColumn("score", F.round("score", 6))


@query(f"""
    with recursive {HYBRID_SQL},
    heads as (select * from (select label, vec_id as id, row_number() over (partition by label order by vec_id) as k from embeddings) where k <= 8),
    hl as (select distinct id from heads),
    g1 as (select seed, other as id, row_number() over (partition by seed order by way, other) as r from (select s.id as seed, e.other, min((e.ord, e.direction)) as way from hl s join e on s.id = e.id where e.other <> s.id group by all)),
    g2 as (select seed, other as id, row_number() over (partition by seed order by way, other) as r from (select g1.seed, e.other, min((g1.r, e.ord, e.direction)) as way from g1 join e on g1.id = e.id where e.other <> g1.seed and not exists (select 1 from g1 x where x.seed = g1.seed and x.id = e.other) group by all)),
    g as (select seed, id, row_number() over (partition by seed order by hop, r) as rank from (select seed, id, 1 as hop, r from g1 union all select seed, id, 2, r from g2)),
    five as (select seed, list(id order by rank) as near from g where rank <= 5 group by 1),
    steps as (select label, k, heads.id, coalesce(near, []) as near from heads left join five on five.seed = heads.id),
    w as (
        select label, 0::bigint as k, []::bigint[] as seen, []::varchar[] as provs from (select distinct label from heads)
        union all
        select w.label, s.k, case when list_contains(seen, s.id) then seen else list_concat(seen, [s.id], list_filter(s.near, lambda x: x <> s.id and not list_contains(seen, x))) end,
            case when list_contains(seen, s.id) then provs else list_concat(provs, ['graph:T' || w.label], list_transform(list_filter(s.near, lambda x: x <> s.id and not list_contains(seen, x)), lambda x: 'graph:' || s.id)) end
        from w join steps s on s.label = w.label and s.k = w.k + 1
    ),
    done as (select label, unnest(seen) as id, unnest(provs) as prov, generate_subscripts(seen, 1) as n from (select label, arg_max(seen, k) as seen, arg_max(provs, k) as provs from w group by 1))
    select d.label as question_id, 'E' || n as evidence_id, d.id as object_id, 'T' || v.label as object_type, 'vector ' || d.id || ' of T' || v.label as text, prov as provenance, 0.1::double as score
    from done d join embeddings v on v.vec_id = d.id where n <= 24
""")
def degraded_retrieve(spark, d):
    v = vector_objects(spark, d)
    return retrieve.graph_only(_linked(spark, d), v, graph.adjacency(vector_links(spark, d))).withColumn("score", F.round("score", 6))


_TOP = "strength as (select *, case when score >= 2 / 3.0 then 'high' when score >= 1 / 3.0 then 'medium' else 'low' end as strength from evidence)"


@query(f"""
    with {HYBRID_SQL}, {_TOP}
    select question_id, 'src:E' || n as source_id, 'urn:ontolith:evidence:E' || n as url, 'object:' || id as locator, 'other' as source_type,
        '2024-01-31' as publication_date, '2024-01-31' as accessed_at, strength, 'vector ' || id || ' of T' || label as excerpt
    from strength join (select vec_id as id, label from embeddings) using (id)
""")
def ledger_projection(spark, d):
    return evidence.ledger_evidence(_evidence(spark, d).withColumn("object_id", F.col("object_id").cast("string")), "2024-01-31")


def _claims(spark, d, found):
    """The template provider's claims: each of the first five pieces of evidence, and one of none that is known."""
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    first = found.withColumn("pos", number).where("pos <= 5")
    replies = first.select("question_id", "pos", "text", F.array("evidence_id", F.lit("E99")).alias("evidence_ids"), F.when(F.col("pos") == 5, "low").otherwise("0.9").alias("confidence"))
    lost = first.where("pos = 1").select("question_id", F.lit(0).alias("pos"), F.lit("nothing known").alias("text"), F.array(F.lit("E99")).alias("evidence_ids"), F.lit("1").alias("confidence"))
    return evidence.claims(replies.unionByName(lost), found.withColumn("object_id", F.col("object_id").cast("string")))


@query(f"""
    with {HYBRID_SQL}
    select question_id, 'claim:' || n as claim_id, 'vector ' || id || ' of T' || label as text, case when n = 5 then 0.5 else 0.9 end::double as confidence, 'supported' as status, 'E' || n as evidence_ids, 'entity:' || id as entities
    from evidence join (select vec_id as id, label from embeddings) using (id) where n <= 5
""")
def claims_from_evidence(spark, d):
    found = _claims(spark, d, _written_evidence(spark, d))
    return found.withColumn("evidence_ids", F.array_join("evidence_ids", ",")).withColumn("entities", F.array_join("entities", ","))


@query(f"""
    with {HYBRID_SQL}, t as (select question_id, n, 'vector ' || id || ' of T' || label as text from evidence join (select vec_id as id, label from embeddings) using (id)),
    a as (select question_id, count(*) as c, string_agg(text || '[E' || n || ']。', chr(10) order by n) filter (n <= 3) as e, string_agg('主张' || n || '：' || text || '[C' || n || ']。', chr(10) order by n) filter (n <= 2) as k from t group by 1)
    select question_id, '针对该问题，根据 Context Pack 中的证据作答：' || chr(10) || e || chr(10) || k || chr(10) || '综上，共引用 ' || c || ' 条证据支撑上述结论。' as text from a
""")
def template_answer(spark, d):
    found = _written_evidence(spark, d)
    return evidence.template_answer(found, _claims(spark, d, found))


@query(f"""
    with {HYBRID_SQL}, c as (select question_id, count(*) as e, count(*) filter (n <= 5) as k from evidence group by 1)
    select question_id, '共 ' || k || ' 条主张，其中 0 条置信度低于 0.5；证据覆盖 ' || e || ' 条，可能未覆盖问题的全部方面。' as uncertainty from c
""")
def uncertainty_rule(spark, d):
    found = _written_evidence(spark, d)
    return evidence.uncertainty(_claims(spark, d, found), found)


# ---- text


@query("""
    with s as (select doc_id, text, length(text) as n, case when regexp_matches(text, '^\\s*$') then [] when length(text) <= 1200 then [0] else range(0, length(text) - 120, 1080) end as starts from documents where text is not null),
    c as (select doc_id, text, unnest(starts) as start, unnest(range(len(starts))) as chunk from s)
    select doc_id, chunk::integer as chunk, length(substr(text, start + 1, 1200))::integer as n, md5(substr(text, start + 1, 1200)) as md5 from c
""")
def sliding_chunks(spark, d):
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(T.sliding_chunks(F.col("text"), 1200)).alias("chunk", "text"))
    return pieces.select("doc_id", "chunk", F.char_length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("md5"))


_PARTS = r"""
    parts as (select conv_id, turn, unnest(regexp_extract_all(text, '([^。！？!?\n]+)([。！？!?\n]|$)', 1)) as f, unnest(regexp_extract_all(text, '([^。！？!?\n]+)([。！？!?\n]|$)', 2)) as t,
        unnest(range(len(regexp_extract_all(text, '([^。！？!?\n]+)([。！？!?\n]|$)', 0)))) as k from {table})
"""


@query(f"with {_PARTS.format(table='conversations')} select conv_id, turn, (row_number() over (partition by conv_id, turn order by k) - 1)::integer as pos, f as fragment, t as terminator from parts where not regexp_matches(f, '^\\s*$')")
def sentence_split(spark, d):
    found = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    return found.select("conv_id", "turn", "pos", "s.fragment", "s.terminator")


#: Answers with citations, made from the turns: every second turn cites, the last sentence refers to what is not there.
_ANSWER_SQL = "answers as (select conv_id, turn, text || case when turn % 2 = 0 then '[E1]' else '' end || '! 综上 none? See [E9] and [C7] and [E9]. Bare' || '!' as text from conversations)"


def _answers(spark, d):
    turns = table(spark, d, "conversations")
    return turns.select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 2 == 0, "[E1]").otherwise(""), F.lit("! 综上 none? See [E9] and [C7] and [E9]. Bare!")).alias("text"))


@query(f"""
    with {_ANSWER_SQL}, m as (select conv_id, turn, unnest(regexp_extract_all(text, '\\[([EC])(\\d+)\\]', 0)) as marker, unnest(range(len(regexp_extract_all(text, '\\[([EC])(\\d+)\\]', 0)))) as k from answers),
    f as (select conv_id, turn, marker, min(k) as k from m group by all)
    select conv_id, turn, (row_number() over (partition by conv_id, turn order by k) - 1)::integer as pos, marker, case when marker[2] = 'E' then 'E' || regexp_extract(marker, '\\d+') end as evidence_id, case when marker[2] = 'C' then 'claim:' || regexp_extract(marker, '\\d+') end as claim_id from f
""")
def parse_citations(spark, d):
    found = _answers(spark, d).select("conv_id", "turn", F.posexplode(T.citations(F.col("text"))).alias("pos", "c"))
    return found.select("conv_id", "turn", "pos", "c.*")


def _question(df):
    return df.withColumn("question_id", F.concat_ws(":", "conv_id", "turn")).drop("conv_id", "turn")


@query(f"""
    with {_ANSWER_SQL}, {_PARTS.format(table="answers")},
    bare as (select conv_id, turn, 'unsupported' as kind, '' as marker, '' as ref_id, regexp_replace(f, '^\\s+|\\s+$', '', 'g') as sentence from parts where not regexp_matches(f, '^\\s*$') and t not in ('?', '？')
        and not regexp_matches(f, '\\[[EC]\\d+\\]') and not regexp_matches(regexp_replace(f, '^\\s+', ''), '^(根据现有证据|综上|如下|针对该问题)'))
    select conv_id || ':' || turn as question_id, kind, marker, ref_id, sentence from bare
    union all select conv_id || ':' || turn, 'dangling', m, r, '' from answers, (values ('[E9]', 'E9'), ('[C7]', 'claim:7')) v(m, r)
""")
def citation_violations(spark, d):
    answers = _question(_answers(spark, d))
    known = answers.select("question_id", F.lit("E1").alias("evidence_id"))
    claims = answers.select("question_id", F.lit("claim:1").alias("claim_id"))
    return evidence.violations(answers, known, claims).drop("ord")


_GRAMS = "list_distinct(list_concat(list_transform(range(1, greatest(length({c}), 1)), lambda i: substr({c}, i, 2)), list_filter(list_transform(range(1, length({c}) + 1), lambda i: substr({c}, i, 1)), lambda x: x <> '')))"


@query(f"""
    with b as (select item_id, text, lead(text) over (order by item_id) as other from benchmark),
    g as (select item_id, {_GRAMS.format(c="text")} as x, {_GRAMS.format(c="other")} as y from b where other is not null)
    select item_id, round(len(list_intersect(x, y)) / len(x)::double, 6) as overlap from g where len(x) > 0
""")
def ngram_overlap(spark, d):
    b = table(spark, d, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    pairs = b.join(other, "item_id")
    return pairs.select("item_id", F.round(T.overlap_ratio(T.ngrams(F.col("text")), T.ngrams(F.col("other"))), 6).alias("overlap"))


#: The CRC-32 of a string, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(hex(encode({s})))::bigint // 2), lambda i: ('0x' || substr(hex(encode({s})), 2 * i + 1, 2))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query(rf"""
    with c as (select doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[\s\x0B\x85\p{{Z}}]', '', 'g'), '(?s).') as chars from documents),
    p as (select doc_id, unnest(chars) as a, unnest(chars[2:] || [null]) as b from c),
    grams as (select distinct doc_id, unnest([a, a || b]) as gram from p),
    codes as (select gram, {_CRC32.format(s="gram")} % 384 as term from (select distinct gram from grams where gram is not null)),
    t as (select distinct doc_id, term from grams join codes using (gram))
    select documents.doc_id, count(term)::integer as n, coalesce(string_agg(term::varchar, ',' order by term), '') as terms from documents left join t using (doc_id) group by 1
""")
def hash_embed(spark, d):
    terms = table(spark, d, "documents").select("doc_id", vectors.hashed_terms(F.col("text")).alias("terms"))
    return terms.select("doc_id", F.size("terms").alias("n"), F.array_join("terms", ",").alias("terms"))


@query(r"""
    with l as (select doc_id as page, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) as raw, unnest(range(len(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')))) as line_no from documents),
    s as (select page, line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') as line from l),
    k as (select * from s where not regexp_matches(line, '^\d{1,3}/153$')),
    last as (select page, max(line_no) as last from k where line <> '' group by 1)
    select page, line_no::integer as line_no, line, case when regexp_matches(line, '^第[一二三四五六七八九十]+部分$') then chr(10) || '## ' || line || chr(10)
        when regexp_matches(line, '^第.{1,3}章(\s*·\s*.*)?$') then chr(10) || '### ' || line || chr(10) when regexp_matches(line, '^(\d{1,2}\.\d{1,2})\s*(\S.*)$') and length(regexp_extract(line, '^(\d{1,2}\.\d{1,2})\s*(\S.*)$', 2)) > 4
        then chr(10) || '#### ' || regexp_extract(line, '^(\d{1,2}\.\d{1,2})\s*(\S.*)$', 1) || ' ' || regexp_extract(line, '^(\d{1,2}\.\d{1,2})\s*(\S.*)$', 2) || chr(10) else line end as markdown
    from k join last using (page) where line_no <= last
""")
def page_lines(spark, d):
    return clean_lines(table(spark, d, "documents"), "doc_id", "text", pages=153)


# ---- metrics


@query(f"with {HYBRID_SQL}, g as (select label, count(*) as n from embeddings group by 1) select question_id, round(count(*) filter (h.label = question_id and rank <= 8) / any_value(n)::double, 6) as recall from hits h join g on g.label = question_id group by question_id")
def recall_at_k(spark, d):
    hits = retrieve.vector_search(centroids(spark, d), vector_objects(spark, d), 24)
    got = hits.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("got"))
    golden = table(spark, d, "embeddings").groupBy(F.col("label").alias("question_id")).agg(F.collect_list("vec_id").alias("golden"))
    return got.join(golden, "question_id").select("question_id", F.round(evaluate.recall_at_k(F.col("got"), F.col("golden"), 8), 6).alias("recall"))


@query(f"with {_ANSWER_SQL} select conv_id, turn, case when regexp_matches(text, '\\[E1\\]') then round(1 / 3.0, 6) else 0.0 end::double as correctness from answers")
def citation_correctness(spark, d):
    markers = F.transform(T.citations(F.col("text")), lambda c: F.coalesce(c["evidence_id"], c["claim_id"]))
    return _answers(spark, d).select("conv_id", "turn", F.round(evaluate.citation_correctness(markers, F.array(F.lit("E1"), F.lit("claim:1"))), 6).alias("correctness"))


@query(f"""
    with {_ANSWER_SQL}, {_PARTS.format(table="answers")},
    s as (select conv_id, turn, regexp_replace(f, '^\\s+|\\s+$', '', 'g') as s from parts where not regexp_matches(f, '^\\s*$') and t not in ('?', '？') and not regexp_matches(regexp_replace(f, '^\\s+', ''), '^(根据现有证据|综上|如下|针对该问题)'))
    select conv_id, turn, count(*)::integer as assertions, round(count(*) filter (not regexp_matches(s, '\\[[EC]\\d+\\]')) / count(*)::double, 6) as rate from s group by 1, 2
""")
def hallucination_rate(spark, d):
    said = T.assertions(F.col("text"))
    rate = evaluate.hallucination_rate(F.col("said"), T.cited(F.col("said")))
    return _answers(spark, d).select("conv_id", "turn", said.alias("said")).select("conv_id", "turn", F.size("said").alias("assertions"), F.round(rate, 6).alias("rate"))


KEYWORDS = ("the", "que", "und", "para", "")


@query("select doc_id, round((contains(text, 'the')::int + contains(text, 'que')::int + contains(text, 'und')::int + contains(text, 'para')::int) / 5.0, 6)::double as coverage from documents where text is not null")
def keyword_coverage(spark, d):
    keywords = F.array(*[F.lit(k) for k in KEYWORDS])
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(evaluate.keyword_coverage(F.col("text"), keywords), 6).alias("coverage"))


_PUNCT = r"[\\s，。；：、｜|,.;:!?！？（）()【】\\[\\]\"''“”‘’]"


@query(rf"""
    with t as (select conv_id, turn, regexp_replace(regexp_replace(text, '\[([EC])(\d+)\]', '', 'g'), '[\s，。；：、｜|,.;:!?！？（）()【】\[\]"''“”‘’]', '', 'g') as c from conversations),
    p as (select a.conv_id, a.turn, a.c as claim, b.c as e from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn - 1),
    v as (select conv_id, case when claim <> '' and (contains(e, claim) or len(list_intersect({_GRAMS.format(c="claim")}, {_GRAMS.format(c="e")})) / len({_GRAMS.format(c="claim")})::double >= 0.7) then 1.0 else 0.0 end as value from p)
    select conv_id, round(avg(value), 6)::double as faithfulness, 0::bigint as judge_failures from v group by 1
""")
def faithfulness(spark, d):
    """Whether each turn follows from the one before it."""
    turns = table(spark, d, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.array("text").alias("evidence"))
    verdicts = T.entailment(turns.join(before, ["conv_id", "turn"]), "text", "evidence")
    return evaluate.faithfulness(verdicts, ["conv_id"]).withColumn("faithfulness", F.round("faithfulness", 6))


@query("select event_type, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, count(value) as n from events group by 1")
def metric_summary(spark, d):
    found = evaluate.summarise(table(spark, d, "events"), ["event_type"])
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")], "n")


_VALUES_SQL = """
    m as (select lang as target, 'keyword_coverage' as metric, avg((contains(text, 'the')::int + contains(text, 'que')::int + contains(text, 'und')::int + contains(text, 'para')::int) / 5.0) as mean from documents where text is not null group by 1
        union all select lang, 'hallucination_rate', avg(case when contains(text, '!') then 1.0 else 0.0 end) from documents where text is not null group by 1),
    o as (select target, row_number() over (order by target) as target_ord from (select distinct target from m))
"""


def _summaries(spark, d):
    """Two metrics of documents, with the language in the place of the system under test."""
    docs = table(spark, d, "documents").where("text is not null")
    keywords = F.array(*[F.lit(k) for k in KEYWORDS])
    wide = docs.select(F.col("lang").alias("target"), evaluate.keyword_coverage(F.col("text"), keywords).alias("keyword_coverage"), F.when(F.col("text").contains("!"), 1.0).otherwise(0.0).alias("hallucination_rate"))
    found = evaluate.summarise(wide.unpivot(["target"], ["keyword_coverage", "hallucination_rate"], "metric", "value"), ["target", "metric"])
    order = found.select("target").distinct().select("target", F.row_number().over(Window.orderBy("target")).alias("target_ord"))
    return found.join(order, "target")


@query(f"""
    with {_VALUES_SQL}, r as (select metric, target, mean, row_number() over w as rank, lead(mean) over w as second from m join o using (target) window w as (partition by metric order by case when metric = 'hallucination_rate' then mean else -mean end, target_ord))
    select metric, case when metric = 'hallucination_rate' then 'lower' else 'higher' end as direction, target as winner, round(mean - second, 6)::double as delta from r where rank = 1 and second is not null
""")
def metric_winner(spark, d):
    return evaluate.winners(_summaries(spark, d)).withColumn("delta", F.round("delta", 6))


@query(f"with {_VALUES_SQL} select metric, round(max(mean) filter (target = 'de'), 6)::double as de, round(max(mean) filter (target = 'en'), 6)::double as en, round(max(mean) filter (target = 'es'), 6)::double as es, round(max(mean) filter (target = 'fr'), 6)::double as fr from m group by 1")
def metric_matrix(spark, d):
    return evaluate.matrix(_summaries(spark, d).withColumn("mean", F.round("mean", 6)), ["de", "en", "es", "fr"])


# ---- schema


def _values(spark, d):
    """Property values of orders, parts and events: (object_type, prop, value, kind, ord)."""
    o = table(spark, d, "orders")
    rows = [
        (o, "Order", "orderDate", F.date_format("o_orderdate", "yyyy-MM-dd"), "string"),
        (o, "Order", "total", F.col("o_totalprice").cast("string"), "number"),
        (o, "Order", "day", F.date_format("o_orderdate", "yyyy-MM-dd"), "string"),
        (o, "Order", "flagged", F.when(F.col("o_orderstatus") == "F", "true"), "bool"),
        (table(spark, d, "part"), "Part", "price", F.lit(None).cast("string"), None),
        (table(spark, d, "part"), "Part", "id", F.col("p_partkey").cast("string"), "string"),
        (table(spark, d, "events").where("event_type = 'click'"), "Event", "score", F.col("event_type"), "string"),
        (table(spark, d, "events"), "Event", "kind", F.col("event_type"), "string"),
    ]
    out = None
    for k, (df, kind, prop, value, of) in enumerate(rows):
        part = df.select(F.lit(kind).alias("object_type"), F.lit(prop).alias("prop"), value.alias("value"), F.lit(of).cast("string").alias("kind"), F.lit(k).cast("long").alias("ord"))
        out = part if out is None else out.unionByName(part)
    return out


def _counts(spark, d):
    one = lambda name, kind: table(spark, d, name).agg(F.count(F.lit(1)).alias("instances")).select(F.lit(kind).alias("object_type"), "instances")
    return one("orders", "Order").unionByName(one("part", "Part")).unionByName(one("events", "Event"))


_PROFILE = """
    select * from (values ('Order', 'orderDate', 0, (select count(*) from orders), 'TIMESTAMP', true), ('Order', 'total', 1, (select count(*) from orders), 'DOUBLE', true),
        ('Order', 'day', 2, (select count(*) from orders), case when (select bool_and(regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^\\d{4}-\\d{2}-\\d{2}$')) from orders) then 'TIMESTAMP' else 'STRING' end, true),
        ('Order', 'flagged', 3, (select count(*) from orders), case when (select count(*) from orders where o_orderstatus = 'F') > 0 then 'BOOL' else 'STRING' end, true),
        ('Part', 'price', 4, (select count(*) from part), 'DOUBLE', true), ('Part', 'id', 5, (select count(*) from part), 'STRING', true),
        ('Event', 'score', 6, (select count(*) from events where event_type = 'click'), 'DOUBLE', (select count(*) from events where event_type <> 'click') = 0),
        ('Event', 'kind', 7, (select count(*) from events), 'STRING', true)) v(object_type, prop, prop_ord, n, data_type, required)
"""


@query(f"select object_type, prop, prop_ord::bigint as prop_ord, n, data_type, required from ({_PROFILE})")
def infer_types(spark, d):
    return infer.property_profile(_values(spark, d), _counts(spark, d))


@query(f"with p as ({_PROFILE}) select object_type, case when bool_or(prop = 'id') then 'id' else arg_min(prop, prop_ord) filter (required) end as primary_key from p group by 1")
def primary_keys(spark, d):
    return infer.primary_keys(infer.property_profile(_values(spark, d), _counts(spark, d)))


@query(f"""
    with l as ({links_sql("inRegion", "customerInNation", "supplierInNation", "placedBy")}),
    t as (select link_type as rel, {{kind}}(source_id) as s, {{kind}}(target_id) as t, target_id, ord from l),
    c as (select rel, s, t, count(*) as c, min(ord) as first from t group by 1, 2, 3),
    f as (select rel, max(c) as m from (select rel, target_id, count(*) as c from t group by 1, 2) group by 1)
    select rel, s as source_type, t as target_type, case when m >= 2 then 'MANY_TO_MANY' else 'ONE_TO_MANY' end as cardinality, rel || ' label' as display_name
    from (select *, row_number() over (partition by rel order by c desc, first) as r from c) join f using (rel) where r = 1
""".replace("{kind}(source_id)", "case source_id[1] when 'N' then 'Nation' when 'C' then 'Customer' when 'S' then 'Supplier' when 'O' then 'Order' end").replace("{kind}(target_id)", "case target_id[1] when 'R' then 'Region' when 'N' then 'Nation' when 'C' then 'Customer' end"))
def link_pair_mode(spark, d):
    edges = links(spark, d, "inRegion", "customerInNation", "supplierInNation", "placedBy")
    edges = edges.select(F.col("link_type").alias("rel"), "source_id", "target_id", F.concat("link_type", F.lit(" label")).alias("label"), "ord")
    return infer.link_types(edges, objects(spark, d, "Region", "Nation", "Customer", "Supplier", "Order"))


#: A catalogue with faults of every kind.
FAULTY = O.Ontology(
    "shop.faulty",
    object_types=[
        O.ObjectType("Region", "Region", [O.Property("name", "Name", required=True), O.Property("name", "Again")], ["name"], description="Where"),
        O.ObjectType("Nation", "Nation", [O.Property("since", "Since", "TIMESTAMP", True), O.Property("level", "Level", "DOUBLE", enum_values=["a"])], ["since", "code", "level"], parent="Area"),
        O.ObjectType("Area", "Area", parent="Zone"),
        O.ObjectType("Zone", "Zone", parent="Area"),
        O.ObjectType("Zone", "Zone"),
        O.ObjectType("Lost", "Lost", parent="Nowhere"),
    ],
    link_types=[O.LinkType("inRegion", "in", "Nation", "Region"), O.LinkType("inWorld", "in", "Region", "World")],
    action_types=[O.ActionType("close", "Close", ["Shop"], preconditions=["Bad Rule"])],
)
SOUND = O.Ontology(
    "shop.sound",
    object_types=[
        O.ObjectType("Customer", "Customer", [O.Property("name", "Name", required=True), O.Property("balance", "Balance", "DOUBLE", True), O.Property("segment", "Segment", description="Market")], ["name"]),
        O.ObjectType("Vip", "Vip", parent="Customer", description="Large"),
        O.ObjectType("Event", "Event", [O.Property("value", "Value", "INT64", True), O.Property("at", "At", "TIMESTAMP", True), O.Property("user", "User", required=True)], ["user"]),
    ],
    link_types=[O.LinkType("raised", "raised", "Customer", "Event")],
)


@query("""
    select unnest(['duplicate object type ''Zone''', 'link type ''inWorld'': target_type ''World'' is not known', 'action type ''close'': target_type ''Shop'' is not known', 'action type ''close'': precondition ''Bad Rule'' has a wrong form',
        'object type ''Lost'': parent ''Nowhere'' is not known', 'parent cycle: Nation -> Area -> Zone -> Area', 'parent cycle: Area -> Zone -> Area', 'parent cycle: Zone -> Area -> Zone', 'object type ''Region'': duplicate property ''name''',
        'object type ''Nation'': property ''level'' has enum_values but is DOUBLE', 'object type ''Nation'': primary_key ''since'' cannot be TIMESTAMP', 'object type ''Nation'': primary_key ''code'' is no property', 'object type ''Nation'': primary_key ''level'' is not required']) as problem
""")
def ontology_problems(spark, d):
    return O.problems(FAULTY.catalog(spark))


@query("""
    with recursive t(api_name, parent) as (values ('Nation', 'Area'), ('Area', 'Zone'), ('Zone', 'Area'), ('Lost', 'Nowhere')),
    w(api_name, chain, parent) as (select api_name, [api_name], parent from t union all select w.api_name, list_append(chain, w.parent), t.parent from w join t on t.api_name = w.parent where not list_contains(chain, w.parent))
    select api_name, array_to_string(list_append(chain, parent), ' -> ') as chain from w where list_contains(chain, parent)
""")
def parent_cycles(spark, d):
    return O.parent_cycles(FAULTY.catalog(spark)["object_types"])


_IRI = "'https://example.org/ontology/shop.sound#' || "
_RDF, _RDFS, _OWL = f"'{O.RDF}' || ", f"'{O.RDFS}' || ", f"'{O.OWL}' || "
_SOUND_SQL = """
    o(n, d, p) as (values ('Customer', '', ''), ('Vip', 'Large', 'Customer'), ('Event', '', '')),
    p(o, n, l, t, d, r) as (values ('Customer', 'name', 'Name', 'string', '', true), ('Customer', 'balance', 'Balance', 'double', '', true), ('Customer', 'segment', 'Segment', 'string', 'Market', false),
        ('Event', 'value', 'Value', 'long', '', true), ('Event', 'at', 'At', 'dateTime', '', true), ('Event', 'user', 'User', 'string', '', true))
"""


@query(f"""
    with {_SOUND_SQL}
    select {_IRI} n as s, {_RDF} 'type' as p, {_OWL} 'Class' as o, false as literal from o
    union all select {_IRI} n, {_RDFS} 'label', n, true from o
    union all select {_IRI} n, {_RDFS} 'comment', d, true from o where d <> ''
    union all select {_IRI} n, {_RDFS} 'subClassOf', {_IRI} p, false from o where p <> ''
    union all select {_IRI} o || '.' || n, {_RDF} 'type', {_OWL} 'DatatypeProperty', false from p
    union all select {_IRI} o || '.' || n, {_RDFS} 'domain', {_IRI} o, false from p
    union all select {_IRI} o || '.' || n, {_RDFS} 'range', '{O.XSD_IRI}' || t, false from p
    union all select {_IRI} o || '.' || n, {_RDFS} 'label', l, true from p
    union all select {_IRI} o || '.' || n, {_RDFS} 'comment', d, true from p where d <> ''
    union all select {_IRI} 'raised', p, o, l from (values ('{O.RDF}type', '{O.OWL}ObjectProperty', false), ('{O.RDFS}domain', 'https://example.org/ontology/shop.sound#Customer', false), ('{O.RDFS}range', 'https://example.org/ontology/shop.sound#Event', false), ('{O.RDFS}label', 'raised', true)) v(p, o, l)
""")
def owl_triples(spark, d):
    return O.triples(SOUND.catalog(spark), SOUND.namespace)


@query(f"""
    with {_SOUND_SQL}
    select {_IRI} n || 'Shape' as s, {_RDF} 'type' as p, '{O.SH}NodeShape' as o, false as literal from o
    union all select {_IRI} n || 'Shape', '{O.SH}targetClass', {_IRI} n, false from o
    union all select {_IRI} n || 'Shape', {_RDFS} 'label', n || ' node shape', true from o
    union all select {_IRI} o || 'Shape', '{O.SH}property', {_IRI} o || '.' || n || 'Shape', false from p
    union all select {_IRI} o || '.' || n || 'Shape', {_RDF} 'type', '{O.SH}PropertyShape', false from p
    union all select {_IRI} o || '.' || n || 'Shape', '{O.SH}path', {_IRI} o || '.' || n, false from p
    union all select {_IRI} o || '.' || n || 'Shape', '{O.SH}datatype', '{O.XSD_IRI}' || t, false from p
    union all select {_IRI} o || '.' || n || 'Shape', '{O.SH}minCount', '1', true from p where r
""")
def shacl_shapes(spark, d):
    return O.shapes(SOUND.catalog(spark), SOUND.namespace)


@query("""
    select 'Customer' as object_type, 'C-' || c_custkey as id, 'balance' as prop, 'less than 1 value' as message from customer where c_acctbal < 0
    union all select 'Event', 'E-' || event_id, 'value', 'value is not INT64' from events where event_type = 'error'
    union all select 'Event', 'E-' || event_id, 'user', 'less than 1 value' from events where user_id % 10 = 0
""")
def instance_check(spark, d):
    """Customers in debt have no balance, errors a value that is no number, every tenth user is not stated."""
    c = table(spark, d, "customer").select(F.lit("Customer").alias("object_type"), F.concat(F.lit("C-"), "c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("balance"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string"))).alias("properties"))
    value = F.when(F.col("event_type") == "error", "none").otherwise(F.floor("value").cast("string"))
    e = table(spark, d, "events").select(F.lit("Event").alias("object_type"), F.concat(F.lit("E-"), "event_id").alias("id"), F.create_map(F.lit("value"), value, F.lit("at"), F.col("ts").cast("string"), F.lit("user"), F.when(F.col("user_id") % 10 != 0, F.col("user_id").cast("string"))).alias("properties"))
    return O.check_instances(c.unionByName(e), SOUND.catalog(spark))


# ---- scenes


def _scene(spark, d):
    nodes = objects(spark, d, "Region", "Nation", "Supplier")
    known = links(spark, d, "inRegion", "supplierInNation").withColumn("label", F.when(F.col("link_type") == "inRegion", "lies in").otherwise("works in"))
    return nodes, known


@query("""
    with q as (select 'Q' || n_nationkey as question_id, 'Which Suppliers are in ' || n_name || ' and not in ' || lower(r_name) || '?' as question from nation join region on n_regionkey = r_regionkey),
    s as (select 'R-' || r_regionkey as id, r_name as name, r_regionkey::bigint as ord from region union all select 'N-' || n_nationkey, n_name, n_nationkey from nation union all select 'S-' || s_suppkey, s_name, s_suppkey from supplier)
    select question_id, 'seed' as kind, id as value, ord from q join s on contains(lower(question), lower(id)) or contains(lower(question), lower(name))
    union all select question_id, 'rel', 'inNation', 0 from q union all select question_id, 'type', 'Supplier', 1 from q
""")
def question_resolve(spark, d):
    nodes, _ = _scene(spark, d)
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    questions = n.select(F.concat(F.lit("Q"), "n_nationkey").alias("question_id"), F.concat(F.lit("Which Suppliers are in "), "n_name", F.lit(" and not in "), F.lower("r_name"), F.lit("?")).alias("question"))
    keywords = spark.createDataFrame([("inNation", "suppliers", 0), ("inNation", "are in", 0), ("inRegion", "lies", 1)], "rel string, keyword string, ord long")
    types = spark.createDataFrame([("Region", "Regions", 0), ("Supplier", "Suppliers", 1)], "object_type string, label string, ord long")
    return scene.resolve(questions, nodes, keywords, types)


@query("""
    with e as (select 'NATION_' || n_nationkey || '(N-' || n_nationkey || ') lies in ' || r_name || '(R-' || r_regionkey || ')' as part, row_number() over (order by r_regionkey, n_nationkey) as k from nation join region on n_regionkey = r_regionkey)
    select string_agg(part, '；' order by k) || '。' as answer, count(*) as parts from e where k <= 14
""")
def scene_answer(spark, d):
    nodes, known = _scene(spark, d)
    found = graph.two_hop_edges(graph.adjacency(known), objects(spark, d, "Region"), ["inRegion"])
    return scene.answer(found, nodes, known, rels=["inRegion"], seeds=[], prop_map={})


@query("""
    select 'upper' as mode, 'N-' || n_nationkey as id from nation where upper(n_name) like '%NATION_1%'
    union all select 'any', 'S-' || s_suppkey from supplier where contains(lower(s_name || 'S-' || s_suppkey || 'Supplier'), '00001')
    union all select 'first', 'R-' || min(r_regionkey) from region where contains(r_name, 'A')
""")
def object_search(spark, d):
    upper = scene.search_objects(objects(spark, d, "Nation"), "nation_1", "upper").select(F.lit("upper").alias("mode"), "id")
    anyhow = scene.search_objects(objects(spark, d, "Supplier"), "00001", "any").select(F.lit("any").alias("mode"), "id")
    first = scene.search_objects(objects(spark, d, "Region"), "A", "first").select(F.lit("first").alias("mode"), "id")
    return upper.unionByName(anyhow).unionByName(first)


@query()
def scene_evaluation(spark, d):
    """Both targets over the tables as a scene: which nations lie in a region, and which region a nation lies in."""
    nodes, known = _scene(spark, d)
    text = F.concat_ws("｜", "object_type", "name")
    runtime = evaluation.Runtime.of("tables", nodes.withColumn("text", text), known, spark.createDataFrame([("Region", "region", 0), ("Nation", "nation", 1), ("Supplier", "supplier", 2)], "object_type string, label string, ord long"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    by_region = n.groupBy("r_regionkey", "r_name").agg(F.array_sort(F.collect_list(F.concat(F.lit("N-"), "n_nationkey"))).alias("golden"))
    items = by_region.select(F.concat(F.lit("R"), "r_regionkey").alias("item_id"), F.concat(F.lit("Which nation lies in "), "r_name").alias("question"), "golden", F.array("r_name").alias("keywords"), F.col("r_regionkey").alias("ord"))
    one = n.select(F.concat(F.lit("N"), "n_nationkey").alias("item_id"), F.concat(F.lit("Which region has "), "n_name").alias("question"), F.array(F.concat(F.lit("R-"), "r_regionkey")).alias("golden"), F.array("r_name").alias("keywords"), (F.col("n_nationkey") + 100).alias("ord"))
    _, summaries, _, _ = evaluation.run(items.unionByName(one), {"constrained": evaluation.constrained(runtime), "plain": evaluation.plain(runtime)})
    return evaluate.matrix(summaries.withColumn("mean", F.round("mean", 6)), ["constrained", "plain"])




def _pack_fields(packs):
    """What a pack says, read back from its JSON."""
    kind = "struct<pack_id:string,question:string,rewrites:array<string>,object_refs:array<struct<object_id:string>>,evidence:array<struct<id:string,object_id:string>>,claims:array<struct<claim_id:string,evidence_ids:array<string>>>,uncertainty:string,created_at:string>"
    read = packs.select("question_id", F.from_json("pack", kind).alias("p"))
    ids = F.array_join(F.transform("p.evidence", lambda e: F.concat(e["id"], F.lit("="), e["object_id"])), ",")
    claims = F.array_join(F.transform("p.claims", lambda c: F.concat(c["claim_id"], F.lit("="), F.array_join(c["evidence_ids"], "+"))), ",")
    return read.select("question_id", "p.pack_id", "p.question", F.array_join("p.rewrites", "|").alias("rewrites"), F.size("p.object_refs").alias("refs"), ids.alias("evidence"), claims.alias("claims"), "p.uncertainty", "p.created_at")


@query(f"""
    with {HYBRID_SQL}, listed as (select question_id, string_agg('E' || n || '=' || id, ',' order by n) as evidence, count(*)::integer as refs, string_agg('claim:' || n || '=E' || n, ',' order by n) filter (n <= 5) as claims, count(*) filter (n <= 5) as k from evidence group by 1)
    select question_id, 'pack_' || substr(sha256('What is near T' || question_id || '|2024-01-31'), 1, 12) as pack_id, 'What is near T' || question_id as question,
        'What is near T' || question_id || case when question_id % 3 = 0 then '' else '|Vectors near T' || question_id || '|Neighbours of it' end as rewrites, refs, evidence, claims,
        '共 ' || k || ' 条主张，其中 0 条置信度低于 0.5；证据覆盖 ' || refs || ' 条，可能未覆盖问题的全部方面。' as uncertainty, '2024-01-31' as created_at from listed
""")
def context_packs(spark, d):
    """Rewrites from replies, evidence, claims and uncertainty of each question in one pack."""
    found = _written_evidence(spark, d)
    questions = found.select("question_id").distinct().withColumn("question", F.concat(F.lit("What is near T"), "question_id"))
    reply = F.when(F.col("question_id") % 3 == 0, "no list").otherwise(F.concat(F.lit('```json\n[" Vectors near T'), F.col("question_id"), F.lit('", "", "Neighbours of it", "one too many"]\n```')))
    rewritten = questions.join(scene.rewrites(questions.withColumn("reply", reply)).select("question_id", "rewrites"), "question_id")
    return _pack_fields(evaluation.context_pack(rewritten, found, _claims(spark, d, found), "2024-01-31"))


# ---- governance


def _proposals(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "pending_approval").when(F.col("o_orderstatus") == "F", "executed").otherwise("draft")
    return o.select(F.concat(F.lit("ACT-"), "o_orderkey").alias("proposal_id"), F.concat(F.lit("C-"), "o_custkey").alias("object_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


_STATUS = "case o_orderstatus when 'P' then 'pending_approval' when 'F' then 'executed' else 'draft' end"


@query(f"""
    select 'ACT-' || o_orderkey as proposal_id, 'C-' || o_custkey as object_id, {_STATUS} as status, case o_orderstatus when 'P' then '待审批' when 'F' then '已执行' else '草稿' end as status_label,
        case o_orderstatus when 'P' then '主管 / 开发/治理人员' else '—' end as approver from orders order by o_orderdate desc, 'ACT-' || o_orderkey limit 20
""")
def governance_recent(spark, d):
    return govern.recent_proposals(_proposals(spark, d)).select("proposal_id", "object_id", "status", "status_label", "approver")


@query("select 'AUD-' || event_id as event_id, 'U-' || user_id as actor, case when event_type = 'error' then '—' else 'O-' || event_id end as object_id from events order by ts desc, 'AUD-' || event_id limit 50")
def audit_recent(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("AUD-"), "event_id").alias("event_id"), F.concat(F.lit("U-"), "user_id").alias("actor"), F.when(F.col("event_type") != "error", F.concat(F.lit("O-"), "event_id")).alias("object_id"), F.col("ts").alias("created_at"))
    return govern.recent_audit(rows).drop("created_at")


@query("""
    with k as (select 'O-' || l_orderkey || ':ship' || l_returnflag || ':v' || l_linenumber || ':' || l_linestatus as idempotency_key,
        row_number() over (partition by l_orderkey, l_returnflag, l_linenumber, l_linestatus order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) as r, l_shipdate from lineitem)
    select idempotency_key, 'ACT-' || strftime(any_value(l_shipdate) filter (r = 1), '%Y%m%d') || '-' || substr(sha256(idempotency_key), 1, 24) as proposal_id, count(*) - 1 as conflicts from k group by 1
""")
def proposal_submit(spark, d):
    line = table(spark, d, "lineitem")
    place = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("ord")
    requests = line.select(place, F.concat(F.lit("O-"), "l_orderkey").alias("object_id"), F.concat(F.lit("ship"), "l_returnflag").alias("capability"), F.col("l_linenumber").alias("version"), F.col("l_linestatus").alias("option_id"), F.lit("Ship").alias("title"), F.lit("U-1").alias("requested_by"), F.col("l_shipdate").alias("created_at"))
    made, _, conflicts = govern.submit(None, requests)
    return made.join(conflicts, "idempotency_key", "left").select("idempotency_key", "proposal_id", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))


def _decisions(spark, d):
    e = table(spark, d, "events")
    role = F.when(F.col("user_id") % 3 == 0, "supervisor").when(F.col("user_id") % 3 == 1, "developer_governance").otherwise("employee")
    decision = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("noted")
    return e.select(F.concat(F.lit("ACT-"), F.floor(F.col("event_id") / 3)).alias("proposal_id"), decision.alias("decision"), F.concat(F.lit("U-"), "user_id").alias("approver"), role.alias("role"), F.lit("").alias("comment"), F.col("ts").alias("decided_at"), F.col("event_id").alias("ord"))


_DECIDED = "d as (select 'ACT-' || (event_id // 3) as proposal_id, case event_type when 'purchase' then 'approved' else 'rejected' end as decision, ts, event_id from events where event_type in ('purchase', 'error') and user_id % 3 <> 2)"


@query(f"""
    with {_DECIDED}, l as (select proposal_id, arg_max(decision, (ts, event_id)) as decision, count(*) as approvals from d group by 1)
    select 'ACT-' || o_orderkey as proposal_id, coalesce(decision, {_STATUS}) as status, coalesce(approvals, 0) as approvals from orders left join l on l.proposal_id = 'ACT-' || o_orderkey
""")
def proposal_decide(spark, d):
    after, approvals, _ = govern.decide(_proposals(spark, d), _decisions(spark, d))
    n = approvals.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("approvals"))
    return after.join(n, "proposal_id", "left").select("proposal_id", "status", F.coalesce("approvals", F.lit(0)).alias("approvals"))


@query(f"with {_DECIDED} select d.proposal_id as correlation_id, case decision when 'approved' then 'ACTION_PROPOSAL_APPROVED' else 'ACTION_PROPOSAL_REJECTED' end as event_type, count(*) as n from d join orders on d.proposal_id = 'ACT-' || o_orderkey group by 1, 2")
def decision_audit(spark, d):
    _, _, audit = govern.decide(_proposals(spark, d), _decisions(spark, d))
    return audit.groupBy("correlation_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select role, verb, allowed from (values ('业务员工', [true, true, false, false]), ('主管', [true, true, true, false]), ('本体建设者', [true, true, false, false]), ('开发/治理人员', [true, true, true, true])) m(role, may), (values ('读取', 1), ('提案', 2), ('审批', 3), ('执行', 4)) v(verb, k), (select unnest([1])) , lateral (select may[k] as allowed)")
def access_matrix(spark, d):
    return govern.access_matrix(spark).drop("scope")


@query("""
    with o as (select o_custkey, arg_max(o_orderpriority, o_orderkey) filter (o_orderstatus <> 'O') as role from orders group by 1)
    select 'U-' || c_custkey as open_id, c_name as name, case when c_custkey = 1 then 'admin' else coalesce(role, 'user') end as role from customer left join o on o_custkey = c_custkey
""")
def upsert_users(spark, d):
    stored = table(spark, d, "customer").select(F.concat(F.lit("U-"), "c_custkey").alias("open_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("role"), F.lit(-1).cast("long").alias("ord"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    incoming = table(spark, d, "orders").join(known, "o_custkey", "left_semi").select(F.concat(F.lit("U-"), "o_custkey").alias("open_id"), F.lit(None).cast("string").alias("name"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("role"), F.col("o_orderkey").alias("ord"))
    return govern.upsert_users(stored, incoming, owner="U-1").drop("ord")


@query("select (select count(*) from orders where o_orderstatus = 'P') as pending, count(*) filter (n_regionkey <> 0) as online, count(*) as connectors from nation")
def overview_counters(spark, d):
    connectors = table(spark, d, "nation").select(F.when(F.col("n_regionkey") != 0, "在线").otherwise("离线").alias("status"))
    return govern.overview(_proposals(spark, d), connectors)


@query("select event_id, least(1.0, greatest(0.0, case when event_type = 'error' then 0.5 else value / 20 end))::double as confidence, case when (case when event_type = 'error' then 0.5 else value / 20 end) >= 0.5 then 'supported' else 'unverified' end as status from events")
def claim_status(spark, d):
    raw = F.when(F.col("event_type") == "error", "not a number").otherwise((F.col("value") / 20).cast("string"))
    e = table(spark, d, "events").select("event_id", scoring.confidence(raw).alias("confidence"))
    return e.withColumn("status", scoring.claim_status(F.col("confidence")))


# ---- streams


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    return streams.event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows_stream(spark, d):
    """The same by Structured Streaming, run to the end of what is there."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    scratch = Scratch(spark, "windows")
    counted = streams.event_windows(stream)

    def last(batch, number):
        batch.write.mode("overwrite").parquet(scratch.path("counts"))  # complete mode: each batch has the whole result

    options = {"checkpointLocation": scratch.path("progress")}
    counted.writeStream.outputMode("complete").foreachBatch(last).options(**options).trigger(availableNow=True).start().awaitTermination()
    read = scratch.read("counts", counted)
    return read.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.round("total", 4))


@query("""
    with p as (select user_id, value > 5 as hot, row_number() over (partition by user_id order by ts, event_id) as k from events),
    g as (select user_id, k, k - row_number() over (partition by user_id order by k) as island from p where hot)
    select user_id, min(k)::integer as first, max(k)::integer as last, count(*) as n from g group by user_id, island having count(*) >= 6
""")
def sustained_alarms(spark, d):
    return streams.sustained(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value > 5", 6)


from ontolith.plans import path_queries  # noqa: E402, F401 -- registers more queries, which use what stands above
