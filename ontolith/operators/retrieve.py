"""Vector search and ontology-constrained hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ontolith.functions.scoring import MOST_EVIDENCE, NEIGHBORS_PER_SEED, RECALL_FACTOR, TOP_K, fused

from ontolith.plans.scratch import Scratch

from .graph import neighbors

#: A question set of up to this many vectors goes to all tasks at once; a greater one meets the vectors block by block.
QUESTION_BLOCK = 1024
#: Vectors that a block of questions meets in one task.
VECTOR_BLOCK = 1 << 16


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, -k)[-k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def vector_search(questions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors with the highest cosine for each question: (question_id, id, score, rank); ties to the smaller id.

    questions: question_id, vec. vectors: id, vec. Each task keeps its own k best of each question, so that what is
    shuffled is questions x tasks x k rows and not questions x vectors. Questions up to QUESTION_BLOCK go to the driver and to
    all tasks; of more, blocks meet blocks of vectors.
    """
    spark = vectors.sparkSession
    q = questions.select("question_id", F.col("vec").cast("array<double>").alias("vec"))
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    kinds = f"question_id {dict(q.dtypes)['question_id']}, id {dict(v.dtypes)['id']}, score double"
    some = q.limit(QUESTION_BLOCK + 1).collect()
    if not some:
        found = spark.createDataFrame([], kinds)
    elif len(some) <= QUESTION_BLOCK:
        found = v.mapInPandas(_searcher([r[0] for r in some], _unit([r[1] for r in some]), k), kinds)
    else:
        found = _in_blocks(q, v, k, kinds)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searcher(names: list, q: np.ndarray, k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, object), np.empty(0))] * len(names)
        for batch in batches:
            if not len(batch):
                continue
            ids, scores = batch["id"].to_numpy(), _unit(batch["vec"].tolist()) @ q.T
            for j, (known, old) in enumerate(kept):
                own = _best(ids, scores[:, j], k)
                both, values = (np.concatenate([known, ids[own]]), np.concatenate([old, scores[own, j]])) if len(old) else (ids[own], scores[own, j])
                at = _best(both, values, k)
                kept[j] = both[at], values[at]
        for name, (ids, values) in zip(names, kept, strict=True):
            if len(values):
                yield pd.DataFrame({"question_id": name, "id": ids, "score": values})

    return search


def _in_blocks(q: DataFrame, v: DataFrame, k: int, kinds: str) -> DataFrame:
    blocks, parts = (max(1, -(-df.count() // size)) for df, size in ((q, QUESTION_BLOCK), (v, VECTOR_BLOCK)))
    deal = lambda df, name, own, other, n, m: df.select(
        F.pmod(F.xxhash64(name), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), name, "vec"
    )

    def search(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame(columns=["question_id", "id", "score"])
        return pd.concat(_searcher(asked["question_id"].tolist(), _unit(asked["vec"].tolist()), k)(iter([own])))

    asked, held = deal(q, "question_id", "block", "part", blocks, parts), deal(v, "id", "part", "block", parts, blocks)
    return asked.groupBy("block", "part").cogroup(held.groupBy("block", "part")).applyInPandas(search, kinds)


def nearest(edges: DataFrame, seeds: DataFrame, objects: DataFrame, most: int = NEIGHBORS_PER_SEED) -> DataFrame:
    """The first `most` neighbours of each seed within two hops. The second hop is only taken for seeds that the first one
    leaves short."""
    seeds = seeds.select("id").distinct()
    one = Scratch(edges.sparkSession, "nearest").write(neighbors(edges, seeds, max_hops=1, objects=objects).where(F.col("rank") <= most), "one")
    full = one.where(F.col("rank") == most).select("seed")
    short = seeds.join(full, seeds["id"] == full["seed"], "left_anti")
    return one.join(full, "seed", "left_semi").unionByName(neighbors(edges, short, objects=objects).where(F.col("rank") <= most))


def of_linked_types(hits: DataFrame, linked: DataFrame) -> DataFrame:
    """Hits whose object_type is among the question's linked types; a question without linked types keeps all. This comes
    after recall: hits of other types have taken their places."""
    allowed = linked.select("question_id", "object_type").distinct()
    asked = allowed.select("question_id").distinct()
    return hits.join(allowed, ["question_id", "object_type"], "left_semi").unionByName(hits.join(asked, "question_id", "left_anti"))


def hybrid(questions: DataFrame, vectors: DataFrame, linked: DataFrame, edges: DataFrame, objects: DataFrame, *, top_k: int = TOP_K, most: int = MOST_EVIDENCE) -> DataFrame:
    """Evidence for each question: (question_id, evidence_id, object_id, object_type, text, provenance, score).

    Recall 3k by vector, keep linked types, take k seeds, add up to 5 neighbours within two hops of each, fuse scores, number
    the best E1, E2, ... . questions: question_id, vec. vectors: id, vec, object_type, text, prov. linked: question_id,
    object_type. edges: an adjacency. objects: id, object_type, text.
    """
    recalled = vector_search(questions, vectors, top_k * RECALL_FACTOR).drop("rank")
    meta = vectors.select("id", "object_type", "text", "prov")
    hits = of_linked_types(recalled.join(meta, "id"), linked)
    by_score = Window.partitionBy("question_id").orderBy(F.desc("score"), "id")
    seeds = hits.withColumn("seed_rank", F.row_number().over(by_score)).where(F.col("seed_rank") <= top_k)

    near = nearest(edges, seeds, objects)
    found = seeds.select("question_id", "seed_rank", F.col("id").alias("seed")).join(near, "seed")
    first = found.groupBy("question_id", "id").agg(F.min(F.struct("seed_rank", "rank", "seed")).alias("by"))
    added = first.join(objects.select("id", "object_type", "text"), "id").select(
        "question_id", "id", "object_type", "text", F.concat(F.lit("graph:"), F.col("by.seed").cast("string")).alias("prov"),
        F.lit(0.0).alias("score"), F.lit(None).cast("int").alias("seed_rank"), F.col("by.seed_rank").alias("by_seed"), F.col("by.rank").alias("by_rank"),
    )
    kept = added.join(seeds.select("question_id", "id"), ["question_id", "id"], "left_anti").withColumn("adjacent", F.lit(True))
    expansion = first.select("question_id", "id", F.lit(True).alias("adjacent"))
    own = seeds.join(expansion, ["question_id", "id"], "left").select(
        "question_id", "id", "object_type", "text", "prov", "score", "seed_rank", F.lit(None).cast("int").alias("by_seed"), F.lit(None).cast("int").alias("by_rank"), F.coalesce("adjacent", F.lit(False)).alias("adjacent"),
    )
    return number(own.unionByName(kept).withColumn("score", fused(F.col("score"), F.col("adjacent"))), most)


def number(candidates: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """E1, E2, ... by score; ties by order of admission: seeds first, then neighbours by their seed and rank."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.col("seed_rank").asc_nulls_last(), "by_seed", "by_rank", "id")
    ranked = candidates.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return ranked.select("question_id", F.concat(F.lit("E"), F.col("n")).alias("evidence_id"), F.col("id").alias("object_id"), "object_type", "text", F.col("prov").alias("provenance"), "score")


def graph_only(linked: DataFrame, objects: DataFrame, edges: DataFrame, *, top_k: int = TOP_K, most: int = MOST_EVIDENCE) -> DataFrame:
    """What is returned without vectors: of each linked type (question_id, object_type, ord) the first k objects and up to 5
    neighbours of each, all with the score of the graph bonus.

    An object that is a candidate already is left out together with its own expansion. That rule is sequential, over at most
    k objects a type, so it runs in a task for each question over candidates of bounded number.
    """
    by_ord = Window.partitionBy("object_type").orderBy("ord", "id")
    heads = objects.withColumn("k", F.row_number().over(by_ord)).where(F.col("k") <= top_k)
    asked = linked.select("question_id", "object_type", F.col("ord").alias("type_ord")).join(heads.select("object_type", "id", "k"), "object_type")
    near = nearest(edges, heads, objects).select("seed", F.col("id").alias("near"), "rank")
    rows = asked.join(near, F.col("id") == F.col("seed"), "left").select("question_id", "object_type", "type_ord", "k", "id", "near", "rank")
    kinds = dict(rows.dtypes)

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, out = set(), []
        for (_, _, seed), own in pdf.sort_values(["type_ord", "k", "rank"]).groupby(["type_ord", "k", "id"], sort=True):
            if seed in seen:
                continue
            seen.add(seed)
            out.append((seed, f"graph:{own['object_type'].iloc[0]}"))
            for near_id in own["near"].dropna():
                if near_id not in seen:
                    seen.add(near_id)
                    out.append((near_id, f"graph:{seed}"))
        return pd.DataFrame({"question_id": pdf["question_id"].iloc[0], "id": [i for i, _ in out], "prov": [p for _, p in out], "seed_rank": range(len(out))})

    admitted = rows.groupBy("question_id").applyInPandas(admit, f"question_id {kinds['question_id']}, id {kinds['id']}, prov string, seed_rank int")
    none = F.lit(None).cast("int")
    full = admitted.join(objects.select("id", "object_type", "text"), "id").select("*", none.alias("by_seed"), none.alias("by_rank"), fused(F.lit(0.0), F.lit(True)).alias("score"))
    return number(full, most)
