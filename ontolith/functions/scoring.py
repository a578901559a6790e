"""Scores, statuses and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of evidence fusion.
VECTOR_WEIGHT, GRAPH_WEIGHT, GRAPH_BONUS = 0.6, 0.4, 0.25
TOP_K, RECALL_FACTOR, NEIGHBORS_PER_SEED, MOST_EVIDENCE = 8, 3, 5, 24
UNCERTAIN = 0.5

#: Proposal states and their labels.
STATUS_LABELS = {"draft": "草稿", "simulated": "已模拟", "pending_approval": "待审批", "approved": "已批准", "rejected": "已拒绝", "executed": "已执行", "rolled_back": "已回滚"}
#: What each role may do.
VERBS = ("读取", "提案", "审批", "执行")
ROLES = {
    "业务员工": ("授权业务对象与只读工具", (True, True, False, False)),
    "主管": ("所属组织对象与审批队列", (True, True, True, False)),
    "本体建设者": ("Ontology Schema、映射与版本", (True, True, False, False)),
    "开发/治理人员": ("连接器、策略、白名单与受控执行", (True, True, True, True)),
}
APPROVER_ROLES = ("supervisor", "developer_governance")


def fused(vector_score: Column, adjacent: Column) -> Column:
    """min(0.6 score + 0.4 bonus, 1); the bonus is for objects next to a seed."""
    bonus = F.when(adjacent, F.lit(GRAPH_BONUS)).otherwise(F.lit(0.0))
    return F.least(vector_score * VECTOR_WEIGHT + bonus * GRAPH_WEIGHT, F.lit(1.0))


def confidence(value: Column) -> Column:
    """A number from 0 to 1; what is none counts as 0.5, NaN as 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(UNCERTAIN))))


def claim_status(confidence_: Column) -> Column:
    return F.when(confidence_ >= UNCERTAIN, "supported").otherwise("unverified")


def strength(score: Column) -> Column:
    return F.when(score >= 2 / 3, "high").when(score >= 1 / 3, "medium").otherwise("low")


def status_label(status: Column) -> Column:
    out = F.when(F.lit(False), "")
    for key, label in STATUS_LABELS.items():
        out = out.when(status == key, label)
    return out


def evidence_url(provenance: Column, evidence_id: Column) -> Column:
    """The provenance if it has a scheme, else a URN of the evidence."""
    return F.when(F.coalesce(provenance, F.lit("")).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), provenance).otherwise(F.concat(F.lit("urn:ontolith:evidence:"), evidence_id))


#: Property names that are numbers when no value says otherwise.
NUMERIC_NAMES = ("amount", "risk", "score", "balance", "value", "price", "cost", "count", "total", "rate")
DATE_LIKE = r"^\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$"


def data_type(name: Column, n: Column, all_bool: Column, all_numbers: Column, all_dates: Column) -> Column:
    """The type of a property from its name and its n values that are not null, in this order of precedence."""
    some = n > 0
    return (
        F.when(some & all_bool, "BOOL")
        .when(F.lower(name).contains("date") | F.lower(name).contains("time"), "TIMESTAMP")
        .when(some & all_numbers, "DOUBLE")
        .when(some & all_dates, "TIMESTAMP")
        .when(name.isin(*NUMERIC_NAMES), "DOUBLE")
        .otherwise("STRING")
    )
