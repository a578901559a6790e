"""The registered queries: with SQL against DuckDB, the others against brute force over whole small tables; the pipeline."""

import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ontolith.llm import mixing, queries

from ..compare import SF, assert_same
from .test_operators import brute_edf, brute_near, clashing, documents, empty, whole_ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


def test_op1(spark):
    got = queries.op1_sharding(spark, SF).toPandas()
    docs = queries.table(spark, SF, "documents").toPandas().set_index("doc_id")["text"]
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "rows")
    sizes = got.groupby("shard")["slot"].agg(["count", "max"])
    assert sorted(got["doc_id"]) == sorted(docs.index) and sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["max"] + 1 == sizes["count"]).all()


def test_op4(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op4_minhash_near_dedup(spark, SF).collect()}
    assert got == brute_near([tuple(r) for r in docs], 2, 80)


def test_op5(spark):
    """Held-out rows: better than always answering 1, by the ranking of scores and by what is found of label 0."""
    got = queries.op5_quality(spark, SF).toPandas().merge(queries.table(spark, SF, "labels").toPandas(), on="doc_id")
    held = got[got["held_out"]]
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert len(good) and len(bad)
    assert (good[:, None] > bad[None, :]).mean() > 0.95  # the area under the curve
    assert (bad < 0.7).mean() > 0.8 and (good >= 0.7).mean() > 0.95


def test_op8(spark):
    got = queries.op8_packing(spark, SF).toPandas()
    docs = queries.table(spark, SF, "documents").toPandas()
    ids = dict(zip(docs["doc_id"], whole_ids(docs["text"]), strict=True))
    assert got.groupby("doc_id")["length"].sum().to_dict() == {i: len(x) for i, x in ids.items()}
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert (got.groupby("sequence_id")["length"].sum().sort_index()[:-1] == 2048).all()


def test_pipeline_against_brute_force(spark):
    """The stages' decisions, each on its own input."""
    docs = queries.table(spark, SF, "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]
    kept = stages[0](spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    scores = queries.op5_quality(spark, SF).where("predicted = 1").select("doc_id")
    assert kept.select("doc_id").exceptAll(scores).count() == 0 and scores.count() == kept.count()
    lines = stages[1](spark, kept, SF).cache()
    from .test_operators import brute_lines

    want = {i: t for i, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in kept.collect()])}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want and lines.columns == docs.columns
    near = stages[2](spark, lines, SF).cache()
    groups = brute_near([(r["doc_id"], r["text"]) for r in lines.collect()], 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {c for _, c in groups.values()}
    mixed = stages[3](spark, near, SF)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect())) == sorted(map(tuple, near.collect()))
    packed = stages[4](spark, mixed, SF)
    assert packed.agg({"length": "sum"}).first()[0] == sum(map(len, whole_ids([r["text"] for r in near.collect()])))


def test_stages_on_edge_cases(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties and repeated rows, empty tables, extra columns with clashing names."""
    for df in (clashing(documents(spark)), empty(spark)):
        sf_dir = str(tmp_path / str(df.isEmpty()))
        df.write.parquet(f"{sf_dir}/documents.parquet")
        docs = queries.table(spark, sf_dir, "documents")
        rows, n = docs.collect(), len(docs.columns)
        labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).where("doc_id is not null and doc_id < 0")
        labels.write.parquet(f"{sf_dir}/labels.parquet")
        stages = [f for _, f in corpus_pipeline.STAGES]
        assert stages[0](spark, docs, sf_dir).count() == 0  # no labels: every score is 0.5
        lines = stages[1](spark, docs, sf_dir)
        assert lines.columns == docs.columns and lines.count() == len(rows)
        assert sum(r["text"] is None for r in lines.collect()) == sum(r["text"] is None for r in rows)
        near = stages[2](spark, docs, sf_dir)
        kept = sorted(str(r["doc_id"]) for r in near.collect())
        assert near.columns == docs.columns and kept == sorted(str(r["doc_id"]) for r in rows if r["doc_id"] not in (2, 7, 9, 13))
        mixed = stages[3](spark, docs, sf_dir)
        assert len(mixed.columns) == n and sorted(map(str, mixed.collect())) == sorted(map(str, rows))
        packed = stages[4](spark, docs, sf_dir).agg(F.sum("length")).first()[0] or 0
        assert packed == sum(map(len, whole_ids([r["text"] for r in rows])))


def test_run(spark):
    got = queries.pipeline(spark, SF)
    assert got.count() > 0 and "sequence_id" in got.columns


def test_run_follows_the_mix(spark, monkeypatch):
    """Packing serves each source in the order of the mix, by its weights; another mix, or none, gives other sequences."""
    docs = queries.table(spark, SF, "documents")
    rare = min(docs.groupBy("source").count().collect(), key=lambda r: (r["count"], str(r["source"])))["source"]
    pack = ("packing", corpus_pipeline.pack_sequences)
    mixes = {"none": None, "mix": mixing.mix(docs), "rare first": mixing.mix(docs, weights={rare: 1000, "": 1}, block_rows=1)}
    found = {}
    for name, mixed in mixes.items():
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixing", lambda s, d, p, mixed=mixed: mixing.in_order(mixed) if mixed else d), pack])
        rows = sorted(corpus_pipeline.run(spark, SF).select("sequence_id", "offset", "doc_id", "source", "start", "length").collect())
        found[name] = [tuple(r) for r in rows]
        if mixed:
            order = {r["doc_id"]: (r["slot"], r["place"]) for r in mixed.select("record.doc_id", "slot", "place").collect()}
            for source in {r["source"] for r in rows}:
                served = [order[r["doc_id"]] for r in rows if r["source"] == source and r["start"] == 0]
                assert served == sorted(served)
    assert len({tuple(rows) for rows in found.values()}) == 3 and len({sum(r[5] for r in rows) for rows in found.values()}) == 1
    middle = {name: np.mean([r[0] for r in rows if r[3] == rare]) for name, rows in found.items()}
    assert max(middle["rare first"], middle["mix"]) < middle["none"] / 2, middle


def test_op3(spark):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    phrases = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}
    got = {r["doc_id"]: r for r in queries.op3_license_scan(spark, SF).collect()}
    for doc_id, text in queries.table(spark, SF, "documents").select("doc_id", "text").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        places = [(k, label) for p, label in phrases.items() for k in range(len(w) - len(p) + 1) if tuple(w[k : k + len(p)]) == p]
        r, starts = got.pop(doc_id), [k for k, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        labels = r["labels"].split(",") if r["labels"] else []
        assert labels == sorted(set(labels)) and set(filter(None, r["base_labels"].split(","))) <= set(labels) and 0 <= r["score"] <= 1
    assert not got


def test_op7(spark):
    """The pages mark their articles; what a plain reading of the marked part gives is what the operator finds."""
    got = {r["page_id"]: r for r in queries.op7_html_extraction(spark, SF).collect()}
    for page_id, page in queries.table(spark, SF, "pages").select("page_id", "html").collect():
        article = re.search(r"<article>(.*?)</article>", page or "", re.S)
        blocks = re.sub(r"</?(p|h\d|li|ul|div)\b[^>]*>", "\n", article[1] if article else "").replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in blocks.split("\n"))
        r = got.pop(page_id)
        assert r["text"] == " ".join(filter(None, parts)) and r["n_chars"] == len(r["text"])
    assert not got


def test_op9(spark):
    """The schedule is that of looking at all sources slot by slot."""
    got = queries.op9_mixing(spark, SF).toPandas()
    docs = queries.table(spark, SF, "documents").toPandas()
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"]) and not got.duplicated(["slot", "place"]).any()
    counts = docs.groupby("source")["doc_id"].count().to_dict()
    weights = {s: max(1, round(65536 * n**0.5 / sum(m**0.5 for m in counts.values()))) for s, n in counts.items()}
    want = [(slot, *x) for slot, x in enumerate(brute_edf([(s, -(-n // 16), weights[s]) for s, n in sorted(counts.items())]))]
    blocks = got.drop_duplicates(["slot"]).sort_values("slot")
    assert list(blocks[["slot", "source", "block", "release", "deadline"]].itertuples(index=False, name=None)) == want
    assert (got["weight"] == got["source"].map(weights)).all()
