"""Claims, ledgers and citation checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontolith.functions import text as T
from ontolith.functions.scoring import claim_status, confidence, evidence_url, strength

#: The wording of rule-based statements and template answers.
UNCERTAINTY = "共 %d 条主张，其中 %d 条置信度低于 0.5；证据覆盖 %d 条，可能未覆盖问题的全部方面。"
ANSWER_OPENS, ANSWER_CLAIM, ANSWER_CLOSES = "针对该问题，根据 Context Pack 中的证据作答：", "主张", "综上，共引用 %d 条证据支撑上述结论。"


def claims(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (question_id, claim_id, text, confidence, status, evidence_ids, entities) from a provider's claims.

    replies: question_id, pos, text, evidence_ids array<string> or null, confidence string. evidence: question_id, evidence_id,
    object_id. Unknown evidence ids go; a claim without text, ids or entities goes; what stays is numbered claim:1, ... .
    """
    known = evidence.select("question_id", "evidence_id", "object_id")
    refs = replies.where(T.strip(F.coalesce("text", F.lit(""))) != "").select("question_id", "pos", F.posexplode("evidence_ids").alias("at", "evidence_id"))
    found = refs.join(known, ["question_id", "evidence_id"])
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    ids = F.array_sort(F.collect_list(F.struct("at", "evidence_id")))
    # entities in the order of the evidence, each once
    entity = F.array_sort(F.collect_list(F.when(F.coalesce("object_id", F.lit("")) != "", F.struct(number.alias("n"), F.concat(F.lit("entity:"), "object_id").alias("e")))))
    per = found.groupBy("question_id", "pos").agg(F.transform(ids, lambda x: x["evidence_id"]).alias("evidence_ids"), F.array_distinct(F.transform(entity, lambda x: x["e"])).alias("entities"))
    kept = replies.drop("evidence_ids").join(per.where(F.size("entities") > 0), ["question_id", "pos"])
    order = Window.partitionBy("question_id").orderBy("pos")
    out = kept.withColumn("confidence", confidence(F.col("confidence"))).withColumn("n", F.row_number().over(order))
    return out.select("question_id", F.concat(F.lit("claim:"), F.col("n")).alias("claim_id"), T.strip(F.col("text")).alias("text"), "confidence", claim_status(F.col("confidence")).alias("status"), "evidence_ids", "entities")


def ledger_evidence(evidence: DataFrame, on_date: Column | str) -> DataFrame:
    """Evidence as ledger rows: question_id, source_id, url, locator, source_type, publication_date, accessed_at, strength,
    excerpt."""
    on_date = F.lit(on_date) if isinstance(on_date, str) else on_date
    located = F.when(F.coalesce("object_id", F.lit("")) != "", F.concat(F.lit("object:"), "object_id")).otherwise(F.col("evidence_id"))
    return evidence.select(
        "question_id",
        F.concat(F.lit("src:"), "evidence_id").alias("source_id"),
        evidence_url(F.col("provenance"), F.col("evidence_id")).alias("url"),
        located.alias("locator"),
        F.lit("other").alias("source_type"),
        on_date.alias("publication_date"),
        on_date.alias("accessed_at"),
        strength(F.col("score")).alias("strength"),
        F.col("text").alias("excerpt"),
    )


def ledger(claims_: DataFrame, evidence: DataFrame, on_date: str) -> DataFrame:
    """One JSON ledger a question: its claims with their evidence rows, evidence_ids left out."""
    rows = ledger_evidence(evidence, on_date).withColumn("evidence_id", F.expr("substring(source_id, 5)"))
    body = F.struct(*[c for c in rows.columns if c not in ("question_id", "evidence_id")])
    each = claims_.select("question_id", "claim_id", F.posexplode(F.array_distinct("evidence_ids")).alias("at", "evidence_id")).join(rows, ["question_id", "evidence_id"])
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    own = each.groupBy("question_id", "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), body.alias("e")))), lambda x: x["e"]).alias("evidence"))
    claim = F.struct("claim_id", "text", "status", "entities", "evidence", "confidence")
    place = F.regexp_extract("claim_id", r"(\d+)", 1).cast("int")
    return claims_.join(own, ["question_id", "claim_id"]).groupBy("question_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("n"), claim.alias("c")))), lambda x: x["c"])).alias("claims"))


def uncertainty(claims_: DataFrame, evidence: DataFrame) -> DataFrame:
    """The rule-based statement of uncertainty of each question that has evidence."""
    c = claims_.groupBy("question_id").agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status") == "unverified").alias("unverified"))
    e = evidence.groupBy("question_id").agg(F.count(F.lit(1)).alias("evidence"))
    both = e.join(c, "question_id", "left").fillna(0, ["claims", "unverified"])
    said = F.format_string(UNCERTAINTY, "claims", "unverified", "evidence")
    return both.select("question_id", said.alias("uncertainty"))


def violations(answers: DataFrame, evidence: DataFrame, claims_: DataFrame) -> DataFrame:
    """What strict checking finds in answers (question_id, text): (question_id, ord, kind, marker, ref_id, sentence). First
    citations that refer to nothing, in order, then sentences without support."""
    cites = answers.select("question_id", F.posexplode(T.citations(F.col("text"))).alias("at", "c")).select("question_id", "at", "c.marker", F.coalesce("c.evidence_id", "c.claim_id").alias("ref_id"))
    known = evidence.select("question_id", F.col("evidence_id").alias("ref_id")).unionByName(claims_.select("question_id", F.col("claim_id").alias("ref_id")))
    loose = cites.join(known.distinct(), ["question_id", "ref_id"], "left_anti")
    bare = answers.select("question_id", F.posexplode(T.unsupported(F.col("text"))).alias("at", "sentence"))
    none = F.lit("")
    at = lambda part: F.struct(F.lit(part).alias("part"), F.col("at").alias("at")).alias("at")
    return loose.select("question_id", at(0), F.lit("dangling").alias("kind"), "marker", "ref_id", none.alias("sentence")).unionByName(
        bare.select("question_id", at(1), F.lit("unsupported").alias("kind"), none.alias("marker"), none.alias("ref_id"), "sentence")
    ).withColumnRenamed("at", "ord")


def template_answer(evidence: DataFrame, claims_: DataFrame) -> DataFrame:
    """The deterministic answer of a question: three pieces of evidence, two claims and a closing sentence, all cited."""
    number = F.regexp_extract("evidence_id", r"(\d+)", 1).cast("int")
    e = evidence.withColumn("n", number).groupBy("question_id").agg(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", F.concat("text", F.lit("["), "evidence_id", F.lit("]。")).alias("s"))))).alias("e"), F.count(F.lit(1)).alias("all"))
    place = F.regexp_extract("claim_id", r"(\d+)", 1).cast("int")
    c = claims_.withColumn("n", place).where("n <= 2").groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit(ANSWER_CLAIM), "n", F.lit("："), "text", F.lit("[C"), "n", F.lit("]。")).alias("s")))).alias("c"))
    lines = F.concat(
        F.array(F.lit(ANSWER_OPENS)),
        F.transform("e", lambda x: x["s"]),
        F.coalesce(F.transform("c", lambda x: x["s"]), F.array().cast("array<string>")),
        F.array(F.format_string(ANSWER_CLOSES, "all")),
    )
    return e.join(c, "question_id", "left").select("question_id", F.array_join(lines, "\n").alias("text"))
