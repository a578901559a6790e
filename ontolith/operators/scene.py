"""Keyword question answering over a scene: nodes (id, object_type, name, ord, properties), links (link_type, label, source_id,
target_id, ord), keywords (rel, keyword), types (object_type, label)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontolith.functions import text as T
from ontolith.plans.scratch import Scratch

from .graph import adjacency, two_hop_edges

#: Fixed values of answers.
MOST_PARTS, FALLBACK_EDGES, EDGES_FOR_FACTS = 14, 5, 6
NOT_FOUND = "未在本体中找到与该问题直接相关的对象或关系。"


#: A term is looked for by so many of its first characters.
KEY = 3


def _grams(text: Column) -> Column:
    """The distinct runs of up to KEY characters, and the empty one."""
    chars = T.characters(text)
    runs = [chars]
    for _ in range(1, KEY):
        runs.append(F.filter(F.zip_with(runs[-1], F.slice(chars, len(runs) + 1, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b)), lambda x: x.isNotNull()))
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs))


def _mentions(questions: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Questions against a vocabulary by substring: a text that holds a term has the term's first characters among its runs, so the
    two are joined by these, and what meets is verified. Spark may broadcast the smaller side; nothing is compared pair by pair."""
    keyed = terms.where(F.col(term).isNotNull()).withColumn("gram", F.substring(term, 1, KEY))
    own = questions.where(F.col(text).isNotNull()).withColumn("gram", F.explode(_grams(F.col(text))))
    return own.join(keyed, "gram").where(F.col(text).contains(F.col(term))).drop("gram")


def resolve(questions: DataFrame, nodes: DataFrame, keywords: DataFrame, types: DataFrame, mode: str = "lower") -> DataFrame:
    """(question_id, kind 'seed' | 'rel' | 'type', value, ord): nodes whose id or name the question holds, relations one of whose
    keywords it holds, types whose label it holds. mode 'lower' compares ids and names without case; 'exact' names with it,
    and keywords as written or in lower case."""
    q = questions.select("question_id", "question", F.lower("question").alias("q"))
    n = nodes.select("id", "ord", F.lower("id").alias("low_id"), F.lower("name").alias("low_name"), "name")
    k = keywords.select("rel", "ord", "keyword", F.lower("keyword").alias("low"))
    ids = _mentions(q, "q", n, "low_id").select("question_id", "id", "ord")
    if mode == "lower":
        seeds = ids.unionByName(_mentions(q, "q", n, "low_name").select("question_id", "id", "ord"))
        rels = _mentions(q, "question", k, "low")
    else:
        seeds = ids.unionByName(_mentions(q, "question", n, "name").select("question_id", "id", "ord"))
        rels = _mentions(q, "question", k, "keyword").unionByName(_mentions(q, "q", k, "low"))
    kinds = _mentions(q, "question", types.select("object_type", "label", "ord"), "label")
    found = seeds.select("question_id", F.lit("seed").alias("kind"), F.col("id").alias("value"), "ord")
    found = found.unionByName(rels.select("question_id", F.lit("rel").alias("kind"), F.col("rel").alias("value"), "ord"))
    found = found.unionByName(kinds.select("question_id", F.lit("type").alias("kind"), F.col("object_type").alias("value"), "ord"))
    return found.groupBy("question_id", "kind", "value").agg(F.min("ord").alias("ord"))


def linked_entities(questions: DataFrame, nodes: DataFrame, types: DataFrame, most: int = 4) -> DataFrame:
    """(question_id, name, object_type, ord): names of nodes in the question, then labels of types; each pair once, first four."""
    q = questions.select("question_id", "question")
    named = nodes.where(F.coalesce("name", F.lit("")) != "").select("name", "object_type", F.lit(0).alias("g"), "ord")
    labelled = types.where(F.coalesce("label", F.lit("")) != "").select(F.col("label").alias("name"), "object_type", F.lit(1).alias("g"), "ord")
    hits = _mentions(q, "question", named.unionByName(labelled), "name")
    once = hits.groupBy("question_id", "name", "object_type").agg(F.min(F.struct("g", "ord")).alias("at"))
    order = Window.partitionBy("question_id").orderBy("at", "object_type")
    return once.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most).drop("at")


def evidence_lines(found: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The three lines of each link: ends with names and label, then the properties of either end."""
    facts = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    own = nodes.select("id", "name", facts.alias("facts"))
    named = found.join(links.select("source_id", "target_id", "link_type", "label").distinct(), ["source_id", "target_id", "link_type"])
    named = named.join(own.toDF("source_id", "source_name", "source_facts"), "source_id").join(own.toDF("target_id", "target_name", "target_facts"), "target_id")
    text = F.concat_ws(
        "\n",
        F.format_string("%s(%s) --%s--> %s(%s)", "source_id", "source_name", "label", "target_id", "target_name"),
        F.format_string("    %s 属性: %s", "source_name", "source_facts"),
        F.format_string("    %s 属性: %s", "target_name", "target_facts"),
    )
    return named.select(*[c for c in ("question_id",) if c in found.columns], "source_id", "target_id", "link_type", "rank", text.alias("text"))


def starts(questions: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question_id, id, ord) where traversal starts: the seeds of a question; if it has none, all nodes of the types that it
    names; if it names none, all nodes."""
    seeds = resolved.where("kind = 'seed'").select("question_id", F.col("value").alias("id"), "ord")
    open_ = questions.select("question_id").join(seeds, "question_id", "left_anti")
    hints = resolved.where("kind = 'type'").select("question_id", F.col("value").alias("object_type"))
    every = nodes.select("object_type").distinct().withColumn("k", F.lit(0))
    rest = open_.join(hints, "question_id", "left_anti").withColumn("k", F.lit(0)).join(every, "k").select("question_id", "object_type")
    typed = open_.join(hints, "question_id").unionByName(rest)
    return seeds.unionByName(typed.join(nodes.select("object_type", "id", "ord"), "object_type").select("question_id", "id", "ord"))


def answers(questions: DataFrame, found: DataFrame, nodes: DataFrame, links: DataFrame, rels: DataFrame, seeds: DataFrame, prop_map: dict[str, tuple[list[str], str]]) -> DataFrame:
    """The deterministic answer (question_id, answer, parts) of each question from its links in rank order.

    Hits, or the first five links if there is none, a sentence each; then, for each asked relation that has properties mapped,
    those properties of the seeds and of the ends of the first six links. At most 14 parts; a fixed text if there is none.
    found: question_id, source_id, target_id, link_type, hit, rank. rels and seeds: question_id, value, ord."""
    spark, by = found.sparkSession, Window.partitionBy("question_id")
    some = F.coalesce(F.max(F.col("hit").cast("int")).over(by), F.lit(0)) == 1
    use = found.withColumn("some", some).where(F.col("hit") | (~F.col("some") & (F.col("rank") <= FALLBACK_EDGES)))
    labels = links.groupBy("source_id", "target_id", "link_type").agg(F.max_by("label", "ord").alias("label"))
    names = nodes.select("id", "name")
    used = use.join(labels, ["source_id", "target_id", "link_type"]).join(names.toDF("source_id", "source_name"), "source_id").join(names.toDF("target_id", "target_name"), "target_id")
    zero = F.lit(0).cast("long")
    said = used.select("question_id", F.lit(0).alias("g"), F.col("rank").cast("long").alias("a"), zero.alias("b"), zero.alias("c"), F.format_string("%s(%s) %s %s(%s)", "source_name", "source_id", "label", "target_name", "target_id").alias("part"))
    mapped = [(rel, j, path, label) for rel, (paths, label) in prop_map.items() for j, path in enumerate(paths)]
    if mapped:
        specs = rels.select("question_id", F.col("value").alias("rel"), F.col("ord").alias("r")).join(F.broadcast(spark.createDataFrame(mapped, "rel string, j int, path string, fact string")), "rel")
        first = use.withColumn("n", F.row_number().over(by.orderBy("rank"))).where(F.col("n") <= EDGES_FOR_FACTS)
        ends = first.select("question_id", F.posexplode(F.array("source_id", "target_id")).alias("e", "id"), "n").select("question_id", "id", F.struct(F.lit(1).alias("g"), (F.col("n") * 2 + F.col("e")).cast("long").alias("k")).alias("at"))
        ends = ends.unionByName(seeds.select("question_id", F.col("value").alias("id"), F.struct(F.lit(0).alias("g"), F.col("ord").cast("long").alias("k")).alias("at")))
        places = ends.groupBy("question_id", "id").agg(F.min("at").alias("at"))
        facts = places.join(specs, "question_id").join(nodes.select("id", "name", "properties"), "id").where(F.map_contains_key("properties", F.col("path")))
        value = F.element_at("properties", F.col("path")).alias("value")
        once = facts.groupBy("question_id", "id", "name", "path").agg(F.min(F.struct("r", "at", "j", "fact", value)).alias("m"))
        place = F.dense_rank().over(by.orderBy("m.at")).cast("long")
        said = said.unionByName(once.select("question_id", F.lit(1).alias("g"), F.col("m.r").cast("long").alias("a"), place.alias("b"), F.col("m.j").cast("long").alias("c"), F.format_string("%s(%s) 的 %s为 %s", "name", "id", "m.fact", "m.value").alias("part")))
    kept = said.withColumn("n", F.row_number().over(by.orderBy("g", "a", "b", "c", "part"))).where(F.col("n") <= MOST_PARTS)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "；")
    made = kept.groupBy("question_id").agg(F.concat(joined, F.lit("。")).alias("answer"), F.count(F.lit(1)).alias("parts"))
    return questions.select("question_id").join(made, "question_id", "left").select("question_id", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"), F.coalesce("parts", F.lit(0)).cast("long").alias("parts"))


def answer(found: DataFrame, nodes: DataFrame, links: DataFrame, *, rels: list[str], seeds: list[str], prop_map: dict[str, tuple[list[str], str]]) -> DataFrame:
    """answers() for one question: (answer, parts)."""
    spark = found.sparkSession
    listed = lambda values: spark.createDataFrame([(0, v, k) for k, v in enumerate(values)], "question_id int, value string, ord long")
    one = spark.createDataFrame([(0,)], "question_id int")
    return answers(one, found.withColumn("question_id", F.lit(0)), nodes, links, listed(rels), listed(seeds), prop_map).drop("question_id")


def answer_questions(
    questions: DataFrame, nodes: DataFrame, links: DataFrame, keywords: DataFrame, types: DataFrame, prop_map: dict[str, tuple[list[str], str]], *, mode: str = "lower",
    replies: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """From question to answer: resolve, traverse, answer. (question_id, engine, answer).

    replies: (question_id, question, evidence) -> with reply, a provider's answer; where it is null or empty, and without
    replies, the deterministic answer stands. mode: see resolve(); 'exact' also keeps the order in which links are found."""
    resolved = Scratch(questions.sparkSession, "question").write(resolve(questions, nodes, keywords, types, mode), "resolved")
    named = lambda kind: resolved.where(F.col("kind") == kind).select("question_id", "value", "ord")
    rels = named("rel")
    asked = rels.select("question_id", F.col("value").alias("link_type"))
    found = two_hop_edges(adjacency(links), starts(questions, resolved, nodes), asked, by=["question_id"], order="type" if mode == "lower" else "found")
    said = answers(questions, found, nodes, links, rels, named("seed"), prop_map).drop("parts")
    if replies is None:
        return said.select("question_id", F.lit("deterministic").alias("engine"), "answer")
    lines = evidence_lines(found, nodes, links).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("evidence"))
    prompts = questions.select("question_id", "question").join(lines, "question_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    own = replies(prompts).select("question_id", F.nullif("reply", F.lit("")).alias("reply"))
    joined = said.join(own, "question_id", "left")
    return joined.select("question_id", F.when(F.col("reply").isNull(), "deterministic").otherwise("provider").alias("engine"), F.coalesce("reply", "answer").alias("answer"))


def linked_from_replies(replies: DataFrame, object_types: DataFrame | list[str]) -> DataFrame:
    """(question_id, name, object_type, ord) from a provider's replies (question_id, reply): a JSON array of {name, object_type},
    in a code fence or not. What is no array gives nothing; items without a name or of unknown type are dropped; a pair counts
    once, at its first place."""
    items = replies.select("question_id", F.posexplode(F.try_variant_get(T.payload(F.coalesce("reply", F.lit(""))), "$", "array<variant>")).alias("ord", "item"))
    said = lambda key: F.coalesce(T.strip(F.try_variant_get("item", f"$.{key}", "string")), F.lit(""))
    each = items.select("question_id", "ord", said("name").alias("name"), said("object_type").alias("object_type")).where("name != ''")
    known = each.where(F.col("object_type").isin(object_types)) if isinstance(object_types, list) else each.join(object_types.select("object_type").distinct(), "object_type", "left_semi")
    return known.groupBy("question_id", "name", "object_type").agg(F.min("ord").alias("ord"))


#: Fixed value: so many rewrites of a question are taken.
MOST_REWRITES = 2


def rewrites(replies: DataFrame) -> DataFrame:
    """(question_id, rewrites, main) from a provider's replies (question_id, question, reply): the question itself, then up to two
    rewrites that say something, from a JSON array; main is the first rewrite, or the question if there is none."""
    items = F.try_variant_get(T.payload(F.coalesce("reply", F.lit(""))), "$", "array<variant>")
    more = F.filter(F.transform(items, lambda x: T.strip(F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))), lambda x: x != "")
    listed = F.concat(F.array("question"), F.coalesce(F.slice(more, 1, MOST_REWRITES), F.array().cast("array<string>")))
    return replies.select("question_id", listed.alias("rewrites")).withColumn("main", F.coalesce(F.get("rewrites", F.lit(1)), F.get("rewrites", F.lit(0))))


def search_objects(objects: DataFrame, query: str, mode: str = "first") -> DataFrame:
    """first: the first object whose id is the query (without case) or whose name holds it. upper: all whose id equals the upper-cased
    query or whose upper-cased name holds it. any: all whose name, id or type name, lower-cased, hold the lower-cased query."""
    if mode == "first":
        return objects.where((F.lower("id") == query.lower()) | F.col("name").contains(query)).orderBy("ord", "id").limit(1)
    if mode == "upper":
        return objects.where((F.upper("id") == query.upper()) | F.upper("name").contains(query.upper()))
    return objects.where(F.lower(F.concat("name", "id", "object_type")).contains(query.lower()))
