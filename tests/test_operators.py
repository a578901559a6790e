"""Hand-computed cases."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontolith.functions import providers, scoring, vectors
from ontolith.functions import text as T
from ontolith.operators import evaluate, evidence, govern, graph, infer, resolve, retrieve, scene, store
from ontolith.plans import ingest
from ontolith.plans import ontology as O
from ontolith.sources import files
from ontolith.streaming import streams


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def test_chunks(spark):
    pieces = one(spark, T.sliding_chunks(F.col("t"), 1000), t="x" * 2250)
    assert [len(p) for p in pieces] == [1000, 1000, 450]
    assert one(spark, T.sliding_chunks(F.col("t"), 10), t="  　\n") == []
    assert one(spark, T.sliding_chunks(F.col("t"), 10), t="short") == ["short"]
    got = one(spark, T.sliding_chunks(F.col("t"), 10), t="".join(chr(97 + k % 26) for k in range(30)))
    assert all(a[-1] == b[0] for a, b in zip(got, got[1:]))


def test_sentences(spark):
    text = "根据现有证据如下。甲是乙[E1]！真的吗？还有丙\n  \n尾"
    got = [(s["fragment"], s["terminator"]) for s in one(spark, T.sentences(F.col("t")), t=text)]
    assert got == [("根据现有证据如下", "。"), ("甲是乙[E1]", "！"), ("真的吗", "？"), ("还有丙", "\n"), ("尾", "")]
    assert one(spark, T.assertions(F.col("t")), t=text) == ["甲是乙[E1]", "还有丙", "尾"]
    assert one(spark, T.unsupported(F.col("t")), t=text) == ["还有丙", "尾"]


def test_citations(spark):
    got = one(spark, T.citations(F.col("t")), t="a[E2] b[C7][E2][E01]")
    assert [(c["marker"], c["evidence_id"], c["claim_id"]) for c in got] == [("[E2]", "E2", None), ("[C7]", None, "claim:7"), ("[E01]", "E01", None)]


def test_payloads(spark):
    assert one(spark, F.to_json(T.payload(F.col("t"))), t='```json\n{"a": 1}\n```') == '{"a":1}'
    assert one(spark, T.payload(F.col("t")).isNull(), t="no json")
    assert one(spark, T.object_payload(F.col("t")), t='so: {"a": {}} end') == '{"a": {}}'


def test_metrics(spark):
    assert one(spark, evaluate.recall_at_k(arr("A", "B", "C"), arr("B", "D"), 2)) == 0.5
    assert one(spark, evaluate.recall_at_k(arr("A"), arr("A"), 0)) == 0
    assert one(spark, evaluate.recall_at_k(arr("A"), arr(), 3)) == 0
    assert one(spark, evaluate.citation_correctness(arr("E1", "E9"), arr("E1", "E2"))) == 0.5
    assert one(spark, evaluate.citation_correctness(arr(), arr("E1"))) == 0
    assert one(spark, evaluate.citation_correctness(arr("E1", "E1"), arr("E1"))) == 1
    assert one(spark, evaluate.hallucination_rate(arr("a", "b", "c"), arr("a", "b"))) == pytest.approx(1 / 3)
    assert one(spark, evaluate.keyword_coverage(F.lit("abc"), arr("a", ""))) == 0.5


def test_faithfulness(spark):
    rows = spark.createDataFrame([("x", True), ("x", True), ("x", False), ("y", None)], "k string, entailed boolean")
    got = {r["k"]: (r["faithfulness"], r["judge_failures"]) for r in evaluate.faithfulness(rows, ["k"]).collect()}
    assert got["x"] == (pytest.approx(2 / 3), 0) and got["y"] == (0.5, 1)


def test_summary_and_winners(spark):
    rows = spark.createDataFrame([(1.0,), (0.5,), (0.2,), (0.0,)], "value double").withColumn("k", F.lit(1))
    s = evaluate.summarise(rows, ["k"]).first()
    assert (s["mean"], s["p50"], s["n"]) == (pytest.approx(0.425), pytest.approx(0.35), 4) and s["p95"] == pytest.approx(0.925)
    means = spark.createDataFrame([("a", 1, "recall_at_k", 1.0), ("b", 2, "recall_at_k", 0.5), ("a", 1, "hallucination_rate", 0.0), ("b", 2, "hallucination_rate", 0.5), ("a", 1, "alone", 1.0)], "target string, target_ord int, metric string, mean double")
    got = {r["metric"]: (r["winner"], r["delta"]) for r in evaluate.winners(means).collect()}
    assert got == {"recall_at_k": ("a", 0.5), "hallucination_rate": ("a", -0.5)}
    markdown, html = evaluate.report(means, evaluate.winners(means), "Run")
    assert "| recall_at_k | 1.000 | 0.500 | a | +0.500 |" in markdown and "<td>-0.500</td>" in html


def test_targets_fail_alone(spark):
    items = spark.createDataFrame([("i", 1)], "item_id string, ord int")
    answers, failures = evaluate.run_targets(items, {"good": lambda x: x.select("item_id"), "bad": lambda x: x.select("nothing")}, limit=1)
    assert answers.count() == 1 and failures[0][0] == "bad"


def test_scores(spark):
    assert one(spark, scoring.fused(F.lit(0.9), F.lit(False))) == pytest.approx(0.54)
    assert one(spark, scoring.fused(F.lit(0.8), F.lit(True))) == pytest.approx(0.58)
    assert one(spark, scoring.fused(F.lit(0.0), F.lit(True))) == pytest.approx(0.1)
    assert [one(spark, scoring.confidence(F.lit(v))) for v in ("x", "-1", "7", "NaN", "0.25")] == [0.5, 0.0, 1.0, 1.0, 0.25]
    assert [one(spark, scoring.strength(F.lit(v))) for v in (0.7, 0.4, 0.1)] == ["high", "medium", "low"]


def test_vectors(spark):
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1 / math.sqrt(2))
    assert 277 in one(spark, vectors.hashed_terms(F.lit("客 户")))
    assert one(spark, vectors.terms_cosine(vectors.hashed_terms(F.lit("ab")), vectors.hashed_terms(F.lit("ab")))) == pytest.approx(1)


OBJECTS = "object_type string, id string, properties map<string,string>, prov string, ord long"


def test_upserts(spark):
    stored = spark.createDataFrame([("A", "1", {"x": "1", "y": "1"}, "p", 1), ("B", "1", {}, "p", 2)], OBJECTS)
    new = spark.createDataFrame([("A", "1", {"y": "2"}, "q", 3), ("A", "", {"z": "1"}, "q", 4)], OBJECTS)
    merged = {(r["object_type"], r["id"]): (r["properties"], r["prov"]) for r in store.upsert_objects(stored, new).collect()}
    assert merged["A", "1"] == ({"x": "1", "y": "2"}, "q") and merged["B", "1"] == ({}, "p")
    replaced = {r["id"]: (r["object_type"], r["properties"]) for r in store.upsert_objects(stored, new, "replace").collect()}
    assert replaced == {"1": ("A", {"y": "2"})}
    with pytest.raises(ValueError):
        store.check_names(["bad name"])
    assert store.get_objects(stored, "A", []).count() == 0 and store.get_objects(stored, "A").count() == 1


def test_neighbors_order_and_trails(spark):
    links = spark.createDataFrame([("r", "a", "b", 0), ("s", "c", "a", 1), ("r", "b", "d", 2), ("r", "c", "b", 3), ("r", "d", "e", 4)], "link_type string, source_id string, target_id string, ord long")
    edges, seed = graph.adjacency(links), spark.createDataFrame([("a",)], "id string")
    got = [(r["id"], r["hop"]) for r in graph.neighbors(edges, seed).orderBy("rank").collect()]
    assert got == [("b", 1), ("c", 1), ("d", 2)]
    assert [r["id"] for r in graph.neighbors(edges, seed, link_type="r").orderBy("rank").collect()] == ["b", "d", "c"]
    assert graph.neighbors(edges, seed, max_hops=0).count() == 0
    paths = {r["path"] for r in graph.trails(edges, seed, 2).collect()}
    assert paths == {"0", "1", "0-2", "0-3", "1-3"}
    with pytest.raises(ValueError):
        graph.trails(edges, seed, 0)


def test_resolution(spark):
    vecs = spark.createDataFrame([("A", 0, [1.0, 0.0]), ("A", 1, [0.95, 0.3122]), ("A", 2, [0.8, 0.6]), ("B", 3, [1.0, 0.0]), ("A", 4, [0.0, 0.0])], "object_type string, ord long, vec array<double>")
    assert {(r["a"], r["b"]) for r in resolve.similar_pairs(vecs, 0.92).collect()} == {(0, 1), (1, 2)}
    pairs = resolve.similar_pairs(vecs, 0.92, block_rows=1)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(r["a"], r["b"]) for r in resolve.similar_pairs(vecs, 0.92).collect()}
    found = {r["ord"]: r["survivor"] for r in resolve.clusters(pairs).collect()}
    assert set(found.values()) == {0} and 3 not in found and 4 not in found
    records = spark.createDataFrame([("A", "x", {"k": "1", "l": "1"}, "p1", 0), ("A", "x", {"k": "2"}, "p2", 1), ("B", "x", {}, "p3", 2)], OBJECTS)
    merged = {r["object_type"]: (r["properties"], r["prov"], r["absorbed"]) for r in resolve.merge_by_key(records).collect()}
    assert merged == {"A": ({"k": "2", "l": "1"}, "p1", ["p2"]), "B": ({}, "p3", [])}


def test_retrieval_caps_and_ranks(spark):
    vecs = spark.createDataFrame([(k, "T", f"v{k}", "s", [1.0, k / 10], k) for k in range(8)] + [(100 + k, "U", f"n{k}", "", [-1.0, 0.0], 100 + k) for k in range(48)], "id long, object_type string, text string, prov string, vec array<double>, ord long")
    links = spark.createDataFrame([("near", k // 6, 100 + k, k) for k in range(48)], "link_type string, source_id long, target_id long, ord long")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, vec array<double>")
    linked = spark.createDataFrame([(1, "T", 0)], "question_id int, object_type string, ord int")
    got = retrieve.hybrid(q, vecs, linked, graph.adjacency(links), vecs).collect()
    assert len(got) == 24 and len({r["object_id"] for r in got if r["provenance"] == "graph:0"}) == 5
    first = next(r for r in got if r["evidence_id"] == "E1")
    assert first["object_id"] == 0 and first["score"] == pytest.approx(0.6)
    alone = retrieve.graph_only(linked, vecs, graph.adjacency(links), top_k=2).collect()
    assert {r["score"] for r in alone} == {0.1} and len(alone) == 12
    none = spark.createDataFrame([], "question_id int, object_type string, ord int")
    hits = retrieve.vector_search(q, vecs, 3).join(vecs.select("id", "object_type"), "id")
    assert retrieve.of_linked_types(hits, none).count() == 3


def test_claims_and_violations(spark):
    found = spark.createDataFrame([(1, "E1", "o1", "https://x", 0.7, "t1"), (1, "E2", "o1", "s", 0.4, "t2"), (1, "E3", "", "s", 0.1, "t3")], "question_id int, evidence_id string, object_id string, provenance string, score double, text string")
    replies = spark.createDataFrame([(1, 0, " a ", ["E2", "E1", "E9"], "0.9"), (1, 1, "", ["E1"], "1"), (1, 2, "b", None, "1"), (1, 3, "c", ["E3"], "1"), (1, 4, "d", ["E1", "E3"], "0.2")], "question_id int, pos int, text string, evidence_ids array<string>, confidence string")
    got = {r["claim_id"]: (r["text"], r["evidence_ids"], r["entities"], r["status"]) for r in evidence.claims(replies, found).collect()}
    assert got == {"claim:1": ("a", ["E2", "E1"], ["entity:o1"], "supported"), "claim:2": ("d", ["E1", "E3"], ["entity:o1"], "unverified")}
    rows = {r["source_id"]: (r["url"], r["locator"], r["strength"]) for r in evidence.ledger_evidence(found, "2024-01-01").collect()}
    assert rows["src:E1"] == ("https://x", "object:o1", "high") and rows["src:E3"] == ("urn:ontolith:evidence:E3", "E3", "low")
    assert "src:E2" in evidence.ledger(evidence.claims(replies, found), found, "2024-01-01").first()["claims"]
    answers = spark.createDataFrame([(1, "综上[E99]。甲[E1]。乙。丙[C7]。")], "question_id int, text string")
    bad = {(r["kind"], r["ref_id"], r["sentence"]) for r in evidence.violations(answers, found, evidence.claims(replies, found)).collect()}
    assert bad == {("dangling", "E99", ""), ("dangling", "claim:7", ""), ("unsupported", "", "乙")}


def test_entailment(spark):
    df = spark.createDataFrame([("甲持有乙[E1]", ["甲持有乙，丙"]), ("甲乙丙丁戊", ["己庚"]), ("", ["x"])], "c string, e array<string>")
    assert [r["entailed"] for r in T.entailment(df, "c", "e").collect()] == [True, False, False]


def test_type_inference(spark):
    rows = [("T", "flag", "true", "bool"), ("T", "amount", "1.5", "number"), ("T", "updatedAt", "2024-01-02 10:00", "string"), ("T", "createdDate", "v1", "string"), ("T", "note", "hello", "string"), ("T", "risk", None, None)]
    values = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], infer.PROFILE)
    counts = spark.createDataFrame([("T", 1)], "object_type string, instances long")
    got = {r["prop"]: r["data_type"] for r in infer.property_profile(values, counts).collect()}
    assert got == {"flag": "BOOL", "amount": "DOUBLE", "updatedAt": "TIMESTAMP", "createdDate": "TIMESTAMP", "note": "STRING", "risk": "DOUBLE"}
    paths = spark.createDataFrame([("risk", 0, "none"), ("risk", 1, "risk")], "rel string, path_ord int, path string")
    types = spark.createDataFrame([("T", 0)], "object_type string, ord int")
    assert infer.edgeless_owners(paths, infer.property_profile(values, counts), counts, types).first()["owner"] == "T"


def test_ontology_round_trip(spark, tmp_path):
    from ontolith.plans.queries import FAULTY, SOUND

    SOUND.dump(tmp_path / "o.yaml")
    assert O.Ontology.load(tmp_path / "o.yaml") == SOUND
    SOUND.validate(spark)
    with pytest.raises(O.OntologyError, match="parent cycle"):
        FAULTY.validate(spark)
    with pytest.raises(O.OntologyError):
        O.ObjectType("lower")
    assert [f.nullable for f in SOUND.struct_type("Customer")] == [False, False, True]
    lines = {r["value"] for r in O.n_triples(O.triples(SOUND.catalog(spark), SOUND.namespace)).collect()}
    assert f'<https://example.org/ontology/shop.sound#Customer> <{O.RDF}type> <{O.OWL}Class> .' in lines
    assert any('"@id"' in r["value"] for r in O.json_ld(O.triples(SOUND.catalog(spark), SOUND.namespace)).collect())
    assert '"enum"' not in SOUND.prompt_view()


def test_scene(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": "s", "types": {"A": {"label": "甲"}, "B": {}}, "relKeywords": {"owns": ["Owns"]}, "propMap": {"risk": [["risk"], "风险"]}, "nodes": [{"id": "n1", "type": "A", "name": "One", "props": {"risk": "9", "b": "2"}}, {"id": "n2", "type": "B", "name": "Two", "props": {}}], "edges": [{"source": "n1", "target": "n2", "rel": "owns", "label": "has"}]}', encoding="utf-8")
    read = files.scene(spark, str(tmp_path / "s.json"), "s")
    nodes, known, types, keywords = files.scene_nodes(read), files.scene_links(read), files.scene_types(read), files.scene_keywords(read)
    assert {r["text"] for r in nodes.collect()} == {"甲｜One｜risk=9、b=2", "B｜Two"}
    assert files.scene_counts(read).first()[1:] == (2, 1)
    with pytest.raises(ValueError):
        files.scene(spark, str(tmp_path / "s.json"), "other")
    q = spark.createDataFrame([(1, "what does one owns 甲")], "question_id int, question string")
    got = {(r["kind"], r["value"]) for r in scene.resolve(q, nodes, keywords, types).collect()}
    assert got == {("seed", "n1"), ("rel", "owns"), ("type", "A")}
    assert {(r["kind"], r["value"]) for r in scene.resolve(q, nodes, keywords, types, "exact").collect()} == {("rel", "owns"), ("type", "A")}
    assert [r["name"] for r in scene.linked_entities(q, nodes, types).collect()] == ["甲"]
    found = graph.two_hop_edges(graph.adjacency(known), nodes.where("id = 'n1'"), ["owns"])
    said = scene.answer(found, nodes, known, rels=["owns", "risk"], seeds=["n1"], prop_map={"risk": (["risk"], "风险")}).first()
    assert said["answer"] == "One(n1) has Two(n2)；One(n1) 的 风险为 9。"
    assert "--has-->" in scene.evidence_lines(found, nodes, known).first()["text"]
    none = graph.two_hop_edges(graph.adjacency(known), nodes.where("id = 'n9'"))
    assert scene.answer(none, nodes, known, rels=[], seeds=[], prop_map={}).first()["answer"] == scene.NOT_FOUND


def test_governance(spark):
    requests = spark.createDataFrame([(1, "o", "c", 1, "x", "T", "u"), (2, "o", "c", 1, "x", "T", "u"), (3, "o", "c", 2, "x", "T", "u")], "ord int, object_id string, capability string, version int, option_id string, title string, requested_by string").withColumn("created_at", F.lit("2024-01-02").cast("timestamp"))
    made, audit, conflicts = govern.submit(None, requests)
    assert {r["idempotency_key"] for r in made.collect()} == {"o:c:v1:x", "o:c:v2:x"} and audit.count() == 2 and [r["conflicts"] for r in conflicts.collect()] == [1]
    again, _, lost = govern.submit(made, requests)
    assert again.count() == 0 and sum(r["conflicts"] for r in lost.collect()) == 3
    pid = made.where("version = 1").first()["proposal_id"]
    decisions = spark.createDataFrame([(pid, "approved", "a", "supervisor", "", 1), (pid, "rejected", "b", "employee", "", 2), ("none", "approved", "a", "supervisor", "", 3)], "proposal_id string, decision string, approver string, role string, comment string, ord int").withColumn("decided_at", F.lit("2024-01-03").cast("timestamp"))
    after, approvals, trail = govern.decide(made, decisions)
    assert after.where(F.col("proposal_id") == pid).first()["status"] == "approved" and approvals.count() == 1 and trail.count() == 1
    assert govern.access_matrix(spark).where("allowed").count() == 2 + 3 + 2 + 4


def test_ingest(spark):
    docs = spark.createDataFrame([("a.md", "text a"), ("b.md", "text b")], "name string, text string")
    replies = {
        "text a": '{"objects": [{"type": "Customer", "id": "c1", "properties": {"n": "1"}}, {"type": "Account", "id": "a1"}, {"type": "Nope", "id": "x"}], "links": [{"type": "owns", "source_id": "c1", "target_id": "a1"}, {"type": "owns", "source_id": "c1", "target_id": "zz"}]}',
        "text b": '```json\n{"objects": [{"type": "Customer", "id": "c1", "properties": {"m": "2"}}], "links": []}\n```',
    }

    class Provider:
        def complete(self, prompt):
            return replies[prompt]

    objects, links, counters = ingest.run(docs, lambda c: providers.completed(c, "text", Provider()), ["Customer", "Account"], ["owns"])
    assert {r["id"]: r["properties"] for r in objects.collect()} == {"c1": {"n": "1", "m": "2"}, "a1": {}}
    assert [(r["source_id"], r["target_id"]) for r in links.collect()] == [("c1", "a1")]
    assert counters.first().asDict() == {"docs": 2, "chunks": 2, "extracted_objects": 3, "extracted_links": 2, "merged": 1, "dropped": 2}


def test_ingest_folds_and_drops(spark):
    """Records, provs and links of a run with folding, with all columns and with few."""
    said = {
        "d0": '{"objects": [{"type": "T", "id": "b", "properties": {"p": "1", "q": "1"}}, {"type": "T", "id": "a", "properties": {"p": "2"}}, {"type": "U", "id": "u"}], "links": [{"type": "l", "source_id": "a", "target_id": "u"}, {"type": "l", "source_id": "a", "target_id": "zz"}]}',
        "d1": '{"objects": [{"type": "T", "id": "b", "properties": {"p": "3"}}, {"type": "T", "id": "c"}], "links": [{"type": "l", "source_id": "b", "target_id": "u"}, {"type": "l", "source_id": "c", "target_id": "b"}]}',
    }
    docs = spark.createDataFrame([(d, d) for d in said], "name string, text string")
    replies = spark.createDataFrame(list(said.items()), "doc string, reply string")
    provider = lambda pieces: pieces.join(replies, "doc").withColumn("warnings", F.lit(0))
    vec = F.when(F.col("id").isin("a", "b"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    made = ingest.Run(docs, provider, ["T", "U"], ["l"], embed=lambda s: s.withColumn("vec", vec))
    whole = {(r["object_type"], r["id"]): (r["properties"], [json.loads(p)["source_doc"] for p in r["absorbed"]], r["merged_via"]) for r in made.objects().collect()}
    assert whole == {("T", "b"): ({"p": "2", "q": "1"}, ["d1", "d0"], "embedding"), ("T", "c"): ({}, [], ""), ("U", "u"): ({}, [], "")}
    few = {(r["object_type"], r["id"]): (r["properties"], r["records"] - 1, r["merged_via"]) for r in made.objects(provs=False).collect()}
    assert few == {k: (p, len(a), m) for k, (p, a, m) in whole.items()}
    ends = lambda df: sorted((r["source_id"], r["target_id"]) for r in df.collect())
    assert ends(made.links()) == ends(made.links(provs=False)) == [("b", "u"), ("c", "b")]
    assert made.counters().first().asDict() == {"docs": 2, "chunks": 2, "extracted_objects": 5, "extracted_links": 4, "merged": 2, "dropped": 1}


def test_similar_rows_meet_without_all_blocks(spark):
    """Rows go to the blocks in reach only, and no pair is lost: codes far apart, clusters, bags, and vectors without clusters."""
    rng = np.random.default_rng(7)
    near = rng.normal(size=(20, 8))[rng.integers(0, 20, 300)] + rng.normal(scale=0.15, size=(300, 8))
    codes = np.array([[1.0 if k >> j & 1 else -1.0 for j in range(12)] for k in range(2048)])
    for x, most in ((codes, 2048), (near, 300 * 19), ((rng.random((200, 30)) < 0.3) * 1.0, 200 * 13), (rng.normal(size=(200, 2)), 200 * 13)):
        df = spark.createDataFrame([("A", i, v.tolist()) for i, v in enumerate(x)], "object_type string, ord long, vec array<double>").repartition(3)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.92, 1)), strict=True)}
        assert {(r["a"], r["b"]) for r in resolve.similar_pairs(df, 0.92, block_rows=16).collect()} == want
        assert resolve._met(df, 0.92, 16).count() <= most  # all blocks: 2048 * 128 for the codes


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    seen = []
    pairs = resolve.similar_pairs
    monkeypatch.setattr(resolve, "similar_pairs", lambda v, *a: (seen.append(v.count()), pairs(v, *a))[1])
    vecs = [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]
    df = spark.createDataFrame([("A", f"i{i}", i, vecs[i % 3]) for i in range(900)], "object_type string, id string, ord long, vec array<double>")
    got = {r["id"]: r["survivor_id"] for r in resolve.by_embedding(df).collect()}
    assert got == {f"i{i}": f"i{i % 3}" for i in range(3, 900) if i % 3 < 2}  # zero vectors are like nothing
    assert seen == [2 + 300]


def test_providers(spark):
    class Broken:
        def complete(self, prompt):
            raise RuntimeError(prompt)

        def embed(self, texts):
            return []

    df = spark.createDataFrame([("a",)], "t string")
    got = providers.completed(df, "t", Broken()).first()
    assert got["reply"] is None and got["warnings"] == 2
    with pytest.raises(Exception, match="0 vectors"):
        providers.embedded(df, "t", Broken()).collect()
    assert isinstance(Broken(), providers.Completer)


def test_files(spark, tmp_path):
    for name in ("a.md", "b.TXT", "c.bin"):
        (tmp_path / name).write_text(f"line of {name}", encoding="utf-8")
    assert {r["name"] for r in files.documents(spark, str(tmp_path)).collect()} == {"a.md", "b.TXT"}
    assert files.skipped_documents(spark, str(tmp_path)).count() == 1
    (tmp_path / "d.yaml").write_text("scenario: s\nitems:\n  - {id: i, question: q, golden_object_ids: [a]}\n", encoding="utf-8")
    assert files.dataset(spark, str(tmp_path / "d.yaml"), "s").first()["golden"] == ["a"]
    with pytest.raises(ValueError):
        files.dataset(spark, str(tmp_path / "d.yaml"), "t")
    pages = spark.createDataFrame([(1, "ＡＢ\n12/153\n3/4\n1.2 Long title here\n第一章 起\n第1章 · 起\n第十二部分\n第一部分 甲\n第12章\n\n"), (2, "\n"), (3, "x")], "p int, t string")
    got = [r["markdown"] for r in files.clean_lines(pages, "p", "t", pages=153).where("page = 1").orderBy("line_no").collect()]
    assert got == ["AB", "3/4", "\n#### 1.2 Long title here\n", "第一章 起", "\n### 第1章 · 起\n", "\n## 第十二部分\n", "第一部分 甲", "\n### 第12章\n"]
    whole = files.joined_document(pages, files.clean_lines(pages, "p", "t", pages=153), "p").orderBy("page", "line_no").collect()
    assert [r["markdown"] for r in whole][8:] == ["", "<!-- page 1 -->", "", "", "<!-- page 2 -->", "", "x"]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one", encoding="utf-8")
    seen = []
    run = streams.ingest(streams.read_documents(spark, str(source)), lambda df, n: seen.extend(r["text"] for r in df.collect()), str(tmp_path / "cp"))
    run.awaitTermination()
    (source / "b.txt").write_text("two", encoding="utf-8")
    run = streams.ingest(streams.read_documents(spark, str(source)), lambda df, n: seen.extend(r["text"] for r in df.collect()), str(tmp_path / "cp"))
    run.awaitTermination()
    assert seen == ["one", "two"]


def test_sustained(spark, tmp_path):
    points = spark.createDataFrame([("k", t, v) for t, v in enumerate([73, 74, 75, 70, 73, 73, 73, 73])], "key string, t int, v int")
    got = [(r["first"], r["last"], r["n"]) for r in streams.sustained(points, "key", ["t"], "v > 72", 4).collect()]
    assert got == [(5, 8, 4)]
    points.select("key", F.timestamp_seconds("t").alias("ts"), (F.col("v") > 72).alias("hot")).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("key string, ts timestamp, hot boolean").parquet(str(tmp_path / "p"))
    run = streams.sustained_stream(stream, "key", "string", 3).writeStream.outputMode("append").format("memory").queryName("alarms").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("alarms").count() == 2


def test_evaluation_and_cli(spark, tmp_path, capsys):
    from ontolith import cli

    (tmp_path / "s.json").write_text('{"id": "s", "types": {"A": {"label": "账户"}, "B": {"label": "客户"}}, "nodes": [{"id": "n1", "type": "A", "name": "账户甲", "props": {"余额": "9"}}, {"id": "n2", "type": "B", "name": "客户乙", "props": {}}, {"id": "n3", "type": "B", "name": "别人", "props": {}}], "edges": [{"source": "n2", "target": "n1", "rel": "owns", "label": "持有"}]}', encoding="utf-8")
    (tmp_path / "d.yaml").write_text("scenario: s\nitems:\n  - {id: i, question: 客户乙有什么账户, golden_object_ids: [n1, n2], golden_answer_keywords: [账户甲]}\n  - {id: j, question: 别人, golden_object_ids: [n3]}\n", encoding="utf-8")
    base = ["eval", "--scene", str(tmp_path / "s.json"), "--dataset", str(tmp_path / "d.yaml"), "--out", str(tmp_path / "out")]
    assert cli.main([*base, "--scenario", "s"]) == 0
    report = (tmp_path / "out" / "s.md").read_text(encoding="utf-8")
    assert "| recall_at_k |" in report and "| keyword_coverage | 1.000" in report and "| citation_correctness | 1.000 | 1.000" in report
    assert (tmp_path / "out" / "s.html").exists()
    assert cli.main([*base, "--scenario", "s", "--targets", "none"]) == 2
    assert cli.main([*base, "--scenario", "other"]) == 2


def test_upsert_of_a_key_with_many_writes(spark, monkeypatch):
    """Gathered or aggregated, a merge is the same."""
    rows = [("T", f"k{k % 7}", {f"p{k % 3}": str(k), **({"q": "x"} if k == 5 else {})}, f"w{k}", k) for k in range(200)] + [("T", "none", None, "w", 1), ("T", "hot", {"a": "0"}, "w", 0)]
    df = spark.createDataFrame(rows, "object_type string, id string, properties map<string,string>, prov string, ord int")
    read = lambda found: {r["id"]: (r["properties"], r["prov"], r["ord"]) for r in found.collect()}
    gathered = read(store.upsert_objects(None, df))
    monkeypatch.setattr(store, "MOST_WRITES", 10)
    assert read(store.upsert_objects(None, df)) == gathered
    want = {}
    for _, i, props, prov, o in rows:
        want[i] = ({**want.get(i, ({},))[0], **(props or {})}, prov, o)
    assert gathered == want


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = __import__("numpy").random.default_rng(1)
    v = spark.createDataFrame([(k, [float(x) for x in rng.integers(-3, 4, 6)]) for k in range(300)], "id long, vec array<double>")
    q = v.where("id < 40").withColumnRenamed("id", "question_id")
    read = lambda: sorted((r["question_id"], r["rank"], r["id"], round(r["score"], 9)) for r in retrieve.vector_search(q, v, 7).collect())
    whole = read()
    monkeypatch.setattr(retrieve, "QUESTION_BLOCK", 9)
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 70)
    assert read() == whole and len(whole) == 280


def test_scene_to_ontology(spark, tmp_path):
    from ontolith.plans import scene_ontology

    (tmp_path / "s.json").write_text(
        """{"id": "s", "types": {"Firm": {"label": "Firma"}, "Person": {"label": ""}, "Lost": {"label": "L"}}, "relKeywords": {"risk": ["risky"], "owns": ["own"], "knows": ["know"], "rated": ["rating"], "none": []},
        "propMap": {"risk": [["risk"], "Risiko"], "rated": [["missing", "score"], "Bewertung"], "also": [["risk"], "later"]},
        "nodes": [{"id": "p1", "type": "Person", "name": "A", "props": {"risk": 0.5, "since": "2024-01-02", "ok": true}}, {"id": "p2", "type": "Person", "name": "B", "props": {"risk": 1, "ok": null}},
            {"id": "f1", "type": "Firm", "name": "F", "props": {"score": "high"}}],
        "edges": [{"source": "p1", "target": "f1", "rel": "owns", "label": "besitzt"}, {"source": "p2", "target": "f1", "rel": "owns", "label": "besitzt"}, {"source": "p1", "target": "p2", "rel": "knows"}]}""",
        encoding="utf-8",
    )
    made = scene_ontology.convert(spark, str(tmp_path / "s.json"), "s.ns")
    assert [(x.api_name, x.display_name, x.source_type, x.target_type, x.cardinality) for x in made.link_types] == [
        ("owns", "besitzt", "Person", "Firm", "MANY_TO_MANY"), ("knows", "", "Person", "Person", "ONE_TO_MANY"), ("rated", "Bewertung", "Firm", "Firm", "MANY_TO_MANY"),
    ]
    assert [o.api_name for o in made.object_types] == ["Firm", "Person"] and [o.primary_key for o in made.object_types] == [["id"], ["id"]]
    person = {p.api_name: (p.display_name, p.data_type, p.required) for p in made.object_types[1].properties}
    assert person == {"id": ("id", "STRING", True), "name": ("name", "STRING", True), "risk": ("Risiko", "DOUBLE", True), "since": ("since", "TIMESTAMP", False), "ok": ("ok", "BOOL", True)}


def test_event_sink(spark):
    sink = providers.TableSink()
    sink.emit({"b": 1, "a": "é"})
    sink.publish("topic", b"payload")
    assert isinstance(sink, providers.AuditSink) and isinstance(sink, providers.EventBus)
    assert [tuple(r) for r in sink.table(spark).collect()] == [(0, "audit", '{"a": "é", "b": 1}'), (1, "topic", "payload")]
    assert store.graph_name("shop.main") == "oag_shop_main"
