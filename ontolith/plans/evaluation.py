"""Side-by-side evaluation over a scene: graph-constrained retrieval with claims against plain vector retrieval."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontolith.functions import text as T
from ontolith.functions import vectors
from ontolith.functions.scoring import TOP_K
from ontolith.operators import evaluate, evidence, graph, retrieve, scene
from ontolith.plans.scratch import Scratch

#: Fixed value: the closing sentence of the plain target's answers.
CHUNKS_CLOSE = "综上，以上内容来自 %d 个检索片段。"
MOST_CLAIMS = 5


@dataclass
class Runtime:
    """A scene ready for questions: nodes (id, object_type, name, text, prov, vec, ord), links, types (object_type, label, ord)."""

    nodes: DataFrame
    links: DataFrame
    types: DataFrame

    @classmethod
    def of(cls, scene_id: str, nodes: DataFrame, links: DataFrame, types: DataFrame) -> Runtime:
        embedded = nodes.select("id", "object_type", "name", "text", F.lit(f"scene:{scene_id}").alias("prov"), vectors.dense(vectors.hashed_terms(F.col("text"))).alias("vec"), "ord")
        return cls(Scratch(nodes.sparkSession, "runtime").write(embedded, "nodes"), links, types)


def _asked(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").alias("question_id"), "question", vectors.dense(vectors.hashed_terms(F.col("question"))).alias("vec"))


def _replies(found: DataFrame) -> DataFrame:
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    return found.withColumn("pos", number).where(F.col("pos") <= MOST_CLAIMS).select("question_id", "pos", "text", F.array("evidence_id").alias("evidence_ids"), F.lit("0.9").alias("confidence"))


def context_pack(questions: DataFrame, found: DataFrame, claims: DataFrame, as_of: str) -> DataFrame:
    """One JSON pack a question: id (a hash of question and date), question, rewrites, object refs, evidence, claims,
    uncertainty, created_at. questions: question_id, question, and rewrites (the question first) if there are any."""
    if "rewrites" not in questions.columns:
        questions = questions.withColumn("rewrites", F.array("question"))
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    refs = F.struct("object_id", "object_type")
    body = F.struct(F.col("evidence_id").alias("id"), "object_id", "text", "score", "provenance")
    listed = lambda pairs: F.transform(F.array_sort(F.collect_list(pairs)), lambda x: x["v"])
    e = found.withColumn("n", number).groupBy("question_id").agg(listed(F.struct("n", body.alias("v"))).alias("evidence"), F.array_distinct(listed(F.struct("n", refs.alias("v")))).alias("object_refs"))
    place = F.regexp_extract("claim_id", r"(\d+)", 1).cast("int")
    claim = F.struct("claim_id", "text", "status", "entities", "evidence_ids", "confidence")
    c = claims.withColumn("n", place).groupBy("question_id").agg(listed(F.struct("n", claim.alias("v"))).alias("claims"))
    joined = questions.join(e, "question_id", "left").join(c, "question_id", "left").join(evidence.uncertainty(claims, found), "question_id", "left")
    pack_id = F.concat(F.lit("pack_"), F.substring(F.sha2(F.concat_ws("|", "question", F.lit(as_of)), 256), 1, 12))
    fields = F.struct(pack_id.alias("pack_id"), "question", "rewrites", "object_refs", "evidence", "claims", "uncertainty", F.lit(as_of).alias("created_at"))
    return joined.select("question_id", F.to_json(fields).alias("pack"))


def constrained(runtime: Runtime) -> Callable[[DataFrame], DataFrame]:
    """The target that links entities, retrieves over vectors and graph, makes claims and cites both."""

    def answer(items: DataFrame) -> DataFrame:
        asked = _asked(items)
        linked = scene.linked_entities(asked, runtime.nodes, runtime.types)
        found = retrieve.hybrid(asked, runtime.nodes, linked, graph.adjacency(runtime.links), runtime.nodes)
        found = Scratch(items.sparkSession, "target").write(found, "evidence")
        claims = evidence.claims(_replies(found), found)
        legal = found.select("question_id", F.col("evidence_id").alias("ref")).unionByName(claims.select("question_id", F.col("claim_id").alias("ref")))
        return _answers(evidence.template_answer(found, claims), found, legal, claims.select("question_id", F.col("text").alias("claim")))

    return answer


def plain(runtime: Runtime, k: int = TOP_K) -> Callable[[DataFrame], DataFrame]:
    """The target that takes the k nearest texts and nothing else."""

    def answer(items: DataFrame) -> DataFrame:
        hits = retrieve.vector_search(_asked(items), runtime.nodes, k).join(runtime.nodes.select("id", "text"), "id")
        found = hits.select("question_id", F.concat(F.lit("E"), "rank").alias("evidence_id"), F.col("id").alias("object_id"), "text", "rank")
        line = F.when(F.col("rank") <= 3, F.struct("rank", F.concat("text", F.lit("["), "evidence_id", F.lit("]。")).alias("s")))
        lines = found.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]).alias("lines"), F.count(F.lit(1)).alias("n"))
        said = lines.select("question_id", F.array_join(F.concat("lines", F.array(F.format_string(CHUNKS_CLOSE, "n"))), "\n").alias("text"))
        claims = said.select("question_id", F.explode(T.assertions(F.col("text"))).alias("claim"))
        return _answers(said, found, found.select("question_id", F.col("evidence_id").alias("ref")), claims)

    return answer


def _answers(said: DataFrame, found: DataFrame, legal: DataFrame, claims: DataFrame) -> DataFrame:
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    got = found.withColumn("n", number).groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "object_id"))), lambda x: x["object_id"]).alias("retrieved"), F.collect_list("text").alias("evidence_texts")
    )
    refs = legal.groupBy("question_id").agg(F.collect_set("ref").alias("legal"))
    made = claims.groupBy("question_id").agg(F.collect_list("claim").alias("claims"))
    cites = F.transform(T.citations(F.col("text")), lambda c: F.coalesce(c["evidence_id"], c["claim_id"]))
    joined = said.join(got, "question_id").join(refs, "question_id").join(made, "question_id", "left")
    return joined.select(F.col("question_id").alias("item_id"), "text", "retrieved", cites.alias("citations"), "legal", "evidence_texts", F.coalesce("claims", F.array().cast("array<string>")).alias("claims"))


def run(items: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], k: int = TOP_K, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, list[tuple[str, str]]]:
    """(metrics by item, summaries, winners, failed targets). items: item_id, question, golden, keywords, ord."""
    scratch = Scratch(items.sparkSession, "evaluation")
    answers, failures = evaluate.run_targets(items, targets, limit)
    if answers is None:
        raise ValueError(f"no target could answer: {failures}")
    answers = scratch.write(answers, "answers")
    each = answers.select("item_id", "target", "evidence_texts", F.explode("claims").alias("claim"))
    verdicts = T.entailment(each, "claim", "evidence_texts").select("item_id", "target", "entailed")
    values = scratch.write(evaluate.item_metrics(answers, items, verdicts, k), "values")
    order = items.sparkSession.createDataFrame([(name, n) for n, name in enumerate(targets)], "target string, target_ord int")
    summaries = evaluate.summarise(values, ["target", "metric"]).join(order, "target")
    return values, summaries, evaluate.winners(summaries), failures
