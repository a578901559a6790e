"""Retrieval and answer metrics, summaries, comparison and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ontolith.functions import text as T

#: Metrics in the order of reports, and the one where less is better.
METRICS = ("recall_at_k", "faithfulness", "citation_correctness", "hallucination_rate", "keyword_coverage")
LOWER_IS_BETTER = ("hallucination_rate",)
JUDGE_FAILURE = 0.5


def recall_at_k(retrieved: Column, golden: Column, k: int) -> Column:
    """Distinct golden ids among the first k retrieved, by the count of distinct golden ids; 0 without any or with k <= 0."""
    if k <= 0:
        return F.lit(0.0)
    hits = F.size(F.array_intersect(F.slice(retrieved, F.lit(1), F.lit(k)), golden))
    return F.coalesce(F.try_divide(hits, F.size(F.array_distinct(golden))), F.lit(0.0))


def citation_correctness(cited: Column, legal: Column) -> Column:
    """Citations that refer to something, repeated ones counted each time; 0 without any."""
    return F.coalesce(F.try_divide(F.size(F.filter(cited, lambda c: F.array_contains(legal, c))), F.size(cited)), F.lit(0.0))


def hallucination_rate(sentences: Column, cited: Column) -> Column:
    """Assertions without a citation; 0 without any assertion."""
    return F.coalesce(F.try_divide(F.size(F.filter(sentences, lambda s: ~F.array_contains(cited, s))), F.size(sentences)), F.lit(0.0))


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """Keywords that the text holds; an empty one counts in the denominator only."""
    return F.coalesce(F.try_divide(F.size(F.filter(keywords, lambda k: (k != "") & text.contains(k))), F.size(keywords)), F.lit(0.0))


def faithfulness(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """verdicts: keys and entailed boolean, null where the judge failed: (keys, faithfulness, judge_failures)."""
    value = F.when(F.col("entailed").isNull(), JUDGE_FAILURE).when(F.col("entailed"), 1.0).otherwise(0.0)
    return verdicts.groupBy(*keys).agg(F.avg(value).alias("faithfulness"), F.count_if(F.col("entailed").isNull()).alias("judge_failures"))


def summarise(values: DataFrame, keys: list[str]) -> DataFrame:
    """values: keys, value -> mean, p50, p95 (exact, interpolated) and n."""
    return values.groupBy(*keys).agg(
        F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.percentile("value", 0.5), F.lit(0.0)).alias("p50"),
        F.coalesce(F.percentile("value", 0.95), F.lit(0.0)).alias("p95"),
        F.count("value").alias("n"),
    )


def winners(summaries: DataFrame) -> DataFrame:
    """(metric, direction, winner, delta to the second) from (target, target_ord, metric, mean), for metrics of two targets or
    more; ties to the target that comes first."""
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    better = F.when(lower, F.col("mean")).otherwise(-F.col("mean"))
    order = Window.partitionBy("metric").orderBy(better, "target_ord")
    ranked = summaries.withColumn("rank", F.row_number().over(order)).withColumn("second", F.lead("mean").over(order))
    best = ranked.where("rank = 1 and second is not null")
    return best.select("metric", F.when(lower, "lower").otherwise("higher").alias("direction"), F.col("target").alias("winner"), (F.col("mean") - F.col("second")).alias("delta"))


def matrix(summaries: DataFrame, targets: list[str]) -> DataFrame:
    """One row a metric, one column a target; null where a target has no such metric."""
    return summaries.groupBy("metric").pivot("target", targets).agg(F.first("mean"))


def item_metrics(answers: DataFrame, items: DataFrame, verdicts: DataFrame, k: int = 8) -> DataFrame:
    """Long rows (item_id, target, metric, value). answers: item_id, target, text, retrieved, citations, legal. items: item_id,
    golden, keywords. Keyword coverage only where there are keywords; faithfulness 0 without claims."""
    judged = faithfulness(verdicts, ["item_id", "target"])
    joined = answers.join(items, "item_id").join(judged, ["item_id", "target"], "left")
    said = T.assertions(F.col("text"))
    wide = joined.select(
        "item_id",
        "target",
        recall_at_k(F.col("retrieved"), F.col("golden"), k).alias("recall_at_k"),
        F.coalesce("faithfulness", F.lit(0.0)).alias("faithfulness"),
        citation_correctness(F.col("citations"), F.col("legal")).alias("citation_correctness"),
        hallucination_rate(said, T.cited(said)).alias("hallucination_rate"),
        F.when(F.size("keywords") > 0, keyword_coverage(F.col("text"), F.col("keywords"))).alias("keyword_coverage"),
    )
    return wide.unpivot(["item_id", "target"], list(METRICS), "metric", "value").where("value is not null")


def run_targets(items: DataFrame, targets: dict[str, Callable[[DataFrame], DataFrame]], limit: int | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The answers of each target to the items (the first `limit` by ord), and the targets that failed to plan with the error.
    A target takes the items and returns item_id, text, retrieved, citations, legal; rows that it marks with a non-null
    `error` are failures of single items and are dropped from the answers."""
    chosen = items if limit is None else items.where(F.col("ord") <= limit)
    answers, failures = None, []
    for name, target in targets.items():
        try:
            got = target(chosen).withColumn("target", F.lit(name))
        except Exception as error:  # noqa: BLE001 -- a failing target is recorded, the run goes on
            failures.append((name, f"{type(error).__name__}: {error}"))
            continue
        answers = got if answers is None else answers.unionByName(got, allowMissingColumns=True)
    if answers is not None and "error" in answers.columns:
        answers = answers.where("error is null").drop("error")
    return answers, failures


def item_failures(answers: DataFrame) -> DataFrame:
    """(item_id, target, error) of the items whose target failed; the others are answers. See answered()."""
    return answers.where("error is not null").select("item_id", "target", "error")


def answered(items: DataFrame, name: str, ask: Callable[[str], str]) -> DataFrame:
    """items (item_id, question) with target, text and error: a target that is a Python callable, asked item by item. An item
    for which it raises has the error 'Type: message' and no text; the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for question in batch["question"]:
                try:
                    got.append((ask(question), None))
                except Exception as error:  # noqa: BLE001 -- a failing item is recorded, the run goes on
                    got.append((None, f"{type(error).__name__}: {error}"))
            yield batch[["item_id"]].assign(target=name, text=[t for t, _ in got], error=[e for _, e in got])

    kind = dict(items.dtypes)["item_id"]
    return items.select("item_id", "question").mapInPandas(run, f"item_id {kind}, target string, text string, error string")


def report(summaries: DataFrame, comparison: DataFrame, title: str) -> tuple[str, str]:
    """The same matrix and winners as Markdown and HTML. The tables have a row for each metric and target."""
    cells: dict[str, dict[str, str]] = {}
    targets: list[str] = []
    for r in summaries.orderBy("target_ord", "metric").collect():
        cells.setdefault(r["metric"], {})[r["target"]] = f"{r['mean']:.3f}"
        if r["target"] not in targets:
            targets.append(r["target"])
    best = {r["metric"]: (r["winner"], f"{r['delta']:+.3f}") for r in comparison.collect()}
    header = ["metric", *targets, "winner", "delta"]
    rows = [[m, *[cells[m].get(t, "–") for t in targets], *best.get(m, ("–", "–"))] for m in [*METRICS, *sorted(set(cells) - set(METRICS))] if m in cells]
    markdown = [f"# {title}", "", "| " + " | ".join(header) + " |", "|" + "---|" * len(header), *["| " + " | ".join(r) + " |" for r in rows], ""]
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{escape(c)}</{tag}>" for c in cells) + "</tr>"
    html = [f"<h1>{escape(title)}</h1>", "<table>", row(header, "th"), *[row(r, "td") for r in rows], "</table>"]
    return "\n".join(markdown), "\n".join(html)
