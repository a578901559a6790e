"""Governance: proposals, approvals, audit and access.

Tables: proposals (proposal_id, object_id, capability, title, status, requested_by, idempotency_key, version, created_at), audit
(event_id, correlation_id, actor, event_type, object_id, summary, created_at), approvals (proposal_id, approver, role,
decision, comment, decided_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontolith.functions.scoring import APPROVER_ROLES, ROLES, VERBS, status_label

#: How many rows the governance centre shows.
PROPOSALS, AUDIT_ROWS = 20, 50


def recent_proposals(proposals: DataFrame, most: int = PROPOSALS) -> DataFrame:
    approver = F.when(F.col("status") == "pending_approval", "主管 / 开发/治理人员").otherwise("—")
    newest = proposals.orderBy(F.desc("created_at"), "proposal_id").limit(most)
    return newest.withColumn("status_label", status_label(F.col("status"))).withColumn("approver", approver).withColumn("risk", F.lit("高"))


def recent_audit(audit: DataFrame, most: int = AUDIT_ROWS) -> DataFrame:
    return audit.orderBy(F.desc("created_at"), "event_id").limit(most).withColumn("object_id", F.coalesce("object_id", F.lit("—")))


def with_demo(stored: DataFrame, demo: DataFrame, logged_in: bool = True) -> DataFrame:
    """Stored rows before demo rows; none of the stored for who is not logged in."""
    stored = stored if logged_in else stored.limit(0)
    return stored.withColumn("part", F.lit(0)).unionByName(demo.withColumn("part", F.lit(1)), allowMissingColumns=True)


def idempotency_key(object_id: Column, capability: Column, version: Column, option: Column) -> Column:
    return F.concat_ws(":", object_id, capability, F.concat(F.lit("v"), version.cast("string")), option)


def submit(stored: DataFrame | None, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New proposals, their audit rows, and (idempotency_key, conflicts): for each key the requests in conflict.

    requests: ord, object_id, capability, version, option_id, title, requested_by, created_at. Of the requests with one key the
    first by ord (then by the other columns) makes the proposal; the others, and all whose key is stored, are conflicts.
    Proposal and event ids are hashes of the key, so that a rerun gives the same.
    """
    key = idempotency_key(F.col("object_id"), F.col("capability"), F.col("version"), F.col("option_id"))
    row = F.struct("ord", *[c for c in requests.columns if c != "ord"])
    first = requests.select(key.alias("idempotency_key"), row.alias("row")).groupBy("idempotency_key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
    if stored is None:
        first = first.withColumn("known", F.lit(False))
    else:
        known = stored.select("idempotency_key", F.lit(True).alias("known")).distinct()
        first = first.join(known, "idempotency_key", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    conflicts = first.select("idempotency_key", (F.col("n") - F.when(F.col("known"), 0).otherwise(1)).alias("conflicts")).where("conflicts > 0")
    fresh = first.where(~F.col("known")).select("idempotency_key", *[F.col("row")[c].alias(c) for c in requests.columns])
    stamp = F.date_format("created_at", "yyyyMMdd")
    number = F.concat(F.lit("ACT-"), stamp, F.lit("-"), F.substring(F.sha2("idempotency_key", 256), 1, 24))
    proposals = fresh.withColumn("proposal_id", number).withColumn("status", F.lit("pending_approval"))
    audit = proposals.select(
        F.concat(F.lit("AUD-"), F.sha2(F.concat(F.lit("created:"), "idempotency_key"), 256)).alias("event_id"),
        F.col("proposal_id").alias("correlation_id"), F.col("requested_by").alias("actor"), F.lit("ACTION_PROPOSAL_CREATED").alias("event_type"), "object_id",
        F.concat("title", F.lit(" 已提交审批")).alias("summary"), "created_at",
    )
    return proposals, audit, conflicts


def decide(proposals: DataFrame, decisions: DataFrame, only_pending: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposals after the decisions, the approvals and the audit rows.

    decisions: proposal_id, decision, approver, role, comment, decided_at, ord. Only approver roles may decide; decisions on unknown
    proposals have no effect; the last decision stands. only_pending leaves proposals alone that are no longer pending.
    """
    allowed = decisions.where(F.col("role").isin(*APPROVER_ROLES) & F.col("decision").isin("approved", "rejected"))
    target = proposals.where(F.col("status") == "pending_approval") if only_pending else proposals
    valid = allowed.join(target.select("proposal_id", "object_id"), "proposal_id")
    last = valid.groupBy("proposal_id").agg(F.max_by("decision", F.struct("decided_at", "ord")).alias("decided"))
    after = proposals.join(last, "proposal_id", "left").withColumn("status", F.coalesce("decided", "status")).drop("decided")
    approvals = valid.select("proposal_id", "approver", "role", "decision", "comment", "decided_at")
    approved = F.col("decision") == "approved"
    audit = valid.select(
        F.concat(F.lit("AUD-"), F.sha2(F.concat_ws(":", F.lit("decided"), "proposal_id", F.col("ord").cast("string")), 256)).alias("event_id"),
        F.col("proposal_id").alias("correlation_id"), F.col("approver").alias("actor"), F.when(approved, "ACTION_PROPOSAL_APPROVED").otherwise("ACTION_PROPOSAL_REJECTED").alias("event_type"), "object_id",
        F.concat(F.lit("提案 "), "proposal_id", F.when(approved, " 已批准").otherwise(" 已拒绝")).alias("summary"), F.col("decided_at").alias("created_at"),
    )
    return after, approvals, audit


def access_matrix(spark: SparkSession) -> DataFrame:
    """(role, verb, allowed, scope)."""
    rows = [(role, verb, can, scope) for role, (scope, may) in ROLES.items() for verb, can in zip(VERBS, may, strict=True)]
    return spark.createDataFrame(rows, "role string, verb string, allowed boolean, scope string")


def upsert_users(stored: DataFrame, incoming: DataFrame, owner: str | None = None) -> DataFrame:
    """Users by open_id: what an incoming row leaves null stays; the owner is an admin. Both have open_id, name, email, role, ord."""
    fields = [c for c in stored.columns if c not in ("open_id", "ord")]
    merged = stored.unionByName(incoming).groupBy("open_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c) for c in fields], F.max("ord").alias("ord"))
    return merged.withColumn("role", F.when(F.col("open_id") == owner, "admin").otherwise(F.coalesce("role", F.lit("user")))) if "role" in fields else merged


def overview(proposals: DataFrame, connectors: DataFrame) -> DataFrame:
    """(pending, online, connectors)."""
    p = proposals.agg(F.count_if(F.col("status") == "pending_approval").alias("pending"))
    c = connectors.agg(F.count_if(F.col("status") == "在线").alias("online"), F.count(F.lit(1)).alias("connectors"))
    return p.withColumn("k", F.lit(1)).join(c.withColumn("k", F.lit(1)), "k").drop("k")


#: The checks of a simulation and their outcomes.
CHECKS = (("对象版本", "通过"), ("跨系统影响", "通过"), ("权限策略", "需审批"), ("回滚计划", "已生成"))


def simulate(options: DataFrame, asked: DataFrame) -> DataFrame:
    """The checks of each option asked for: (option_id, title, check, status, k); unknown options give no row. options: option_id,
    title. asked: option_id."""
    checks = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(name).alias("check"), F.lit(status).alias("status")) for k, (name, status) in enumerate(CHECKS)])).alias("c")
    return options.join(asked.select("option_id").distinct(), "option_id", "left_semi").select("option_id", "title", checks).select("option_id", "title", "c.check", "c.status", "c.k")


def user_by_open_id(users: DataFrame, open_id: str) -> DataFrame:
    return users.where(F.col("open_id") == open_id).limit(1)


def capabilities(connectors: DataFrame, kind: str | None = None) -> DataFrame:
    """A row for each capability of a connector: connector_id, name, kind. connectors: connector_id, capabilities
    array<struct<name, kind>>."""
    rows = connectors.select("connector_id", F.explode("capabilities").alias("c")).select("connector_id", "c.name", "c.kind")
    return rows if kind is None else rows.where(F.col("kind") == kind)


def mapped(mappings: DataFrame, external: DataFrame, least: float = 0.0) -> DataFrame:
    """The objects of external ids: (system, external_id, object_id, confidence), the most certain mapping of each, ties to the
    smaller object id. mappings: system, external_id, object_id, confidence, status; only active ones count."""
    active = mappings.where((F.col("status") == "active") & (F.col("confidence") >= least)).join(external.select("system", "external_id").distinct(), ["system", "external_id"], "left_semi")
    best = active.groupBy("system", "external_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "object_id", "confidence")).alias("m"))
    return best.select("system", "external_id", "m.object_id", "m.confidence")


def decided_by_client(events: DataFrame) -> DataFrame:
    """Proposals that a client keeps: (proposal_id, status, ord), newest first by ord. events: ord, kind 'create' or 'decide',
    proposal_id, status. The last decision stands; decisions on unknown proposals have no effect."""
    made = events.where("kind = 'create'").groupBy("proposal_id").agg(F.max(F.struct("ord", "status")).alias("m"))
    last = events.where("kind = 'decide'").groupBy("proposal_id").agg(F.max_by("status", "ord").alias("decided"))
    return made.join(last, "proposal_id", "left").select("proposal_id", F.coalesce("decided", "m.status").alias("status"), "m.ord")
