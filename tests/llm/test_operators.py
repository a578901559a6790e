"""Each operator against a brute-force version, and the cases that every operator must handle: nulls in any column, empty and long
texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ontolith.llm import common, exact_dedup, html_extract, license_scan, line_dedup, minhash, mixing, mtree, packing, quality, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns.
CLASH = ("record", "id", "h", "bucket", "slot", "shard", "digest", "run", "n", "key", "queue", "cell", "source_rows", "block", "rank", "tree", "high", "low", "cut", "u", "score")


def documents(spark):
    long = " ".join(f"word{k % 977}x{k}" for k in range(20_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1),
        (2, "alpha  beta\tgamma delta epsilon zeta", "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t", "en", "b", 3),
        (6, long, "en", "b", len(long)),
        (7, long + " end", "en", None, 0),
        (None, "no id here at all, a line of it", "en", "a", 1),
        (8, "one", "de", "a", 3),
        (9, "ONE", "de", "a", 3),
        (10, "a shared line of text\nown line number ten\nA shared line of text ", "fr", "c", 1),
        (11, "a shared line of text\n\nshort\nshort", "fr", "c", 1),
        (11, "a shared line of text\n\nshort\nshort", "fr", "c", 1),
        (12, "üñí çôdé — 漢字 line of text 🙂", "xx", "c", 1),
        (13, "üñí çôdé — 漢字 line of text 🙂", "xx", "c", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1


def test_sharding(spark):
    df = documents(spark)
    got = sharding.external_shuffle(df, shards=4, bucket_bytes=64).select("record.*", "shard", "slot", "position").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    for k in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    assert sharding.external_shuffle(empty(spark), shards=4).count() == 0
    assert sharding.external_shuffle(clashing(df), shards=2).count() == len(got)
    with pytest.raises(ValueError):
        sharding.external_shuffle(df, shards=0)


def test_sharding_is_a_seeded_shuffle(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    order = lambda seed: [r[0] for r in sharding.external_shuffle(df, shards=3, seed=seed).orderBy("position").select("record.doc_id").collect()]
    a, b = order(1), order(1)
    assert a == b and a != order(2) and a != sorted(a)
    assert abs(np.corrcoef(a, range(4000))[0, 1]) < 0.1
    shuffled = sharding.external_shuffle(df, shards=3)
    sharding.write_shards(shuffled, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def test_sharding_scatters_equal_rows(spark):
    df = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.lit("the same").alias("text"))
    got = sharding.external_shuffle(df, shards=8).groupBy("bucket").count().collect()
    sizes = sorted(r["count"] for r in got)
    assert sum(sizes) == 20_000 and len(sizes) == 8 and sizes[-1] < 1.2 * sizes[0]


# ---- 2


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm], key=lambda x: x[:3])[3]
        out.append((i, keep, len(groups[norm]), keep == i, hashlib.sha256(norm.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    df = documents(spark)
    options = {"digest": lambda t: F.length(t) % 3} if weak else {}  # a weak digest: hits are told apart by their bytes
    got = exact_dedup.exact_dedup(df, memtable_rows=2, slice_rows=3, fan_in=2, **options)
    want = brute_exact([(r["doc_id"], r["text"]) for r in df.collect()])
    assert Counter(map(tuple, got.select("id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want
    if not weak:
        assert Counter(map(tuple, exact_dedup.exact_dedup(clashing(df)).collect())) == want
        assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_digest_index_looks_up(spark):
    scratch = exact_dedup.Scratch(spark, "test")
    index = exact_dedup.DigestIndex(spark, scratch, 100, fan_in=2, slice_rows=10)
    best = F.struct(F.lit(0).alias("neg_len"), F.lit(False).alias("no_id"), F.col("id").alias("id")).alias("best")
    index.flush(spark.range(100).select((F.col("id") % 50).alias("digest"), best, F.lit(1).cast("long").alias("n")), 5)
    assert index.entries().select("run").distinct().count() == 5
    index.compact()
    assert index.runs == 1 and index.entries().count() == 50
    assert [(r["digest"], r["best"]["id"], r["n"]) for r in index.lookup([7]).collect()] == [(7, 7, 2)]


def test_exact_dedup_filter(spark):
    """The filter knows every hit, and little else; memtables stay small however many they are."""
    hits = spark.range(500).select(F.xxhash64("id").alias("digest"))
    known = common.known_keys(hits, "digest")
    others = spark.range(500, 20_500).select(F.xxhash64("id").alias("digest"))
    assert common.may_be(hits, known, "digest").count() == 500 and common.may_be(hits, known, "digest", "left_anti").count() == 0
    assert common.may_be(others, known, "digest").count() < 20 and common.may_be(others, known, "digest", "left_anti").count() > 19_980


def test_exact_dedup_hot_group(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id") % 9001)).alias("text"))
    got = exact_dedup.exact_dedup(df, memtable_rows=100).groupBy("group_size").agg(F.count("*").alias("n"), F.countDistinct("keep_id").alias("k")).orderBy("group_size").collect()
    groups = Counter("same" if i % 3 == 0 else i % 9001 for i in range(20_000))
    want = Counter(groups.values())
    assert {r["group_size"]: (r["n"], r["k"]) for r in got} == {size: (size * n, n) for size, n in want.items()}


# ---- 3


def test_license_scan(spark):
    rows = [
        (1, "Released Under the MIT License. under the mit-license; APACHE LICENSE, version 2.0", *[None] * 3),
        (2, "cc-by-nc cc by ncx", *[None] * 3),
        (3, None, *[None] * 3),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
         "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", *[None] * 3),
        (5, "Permission is hereby granted, free of cost", *[None] * 3),
        (6, "müß under the mit licenseé", *[None] * 3),
    ]
    got = {r["id"]: r for r in license_scan.license_scan(clashing(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 1, 9, "apache-2,mit")
    assert "named-license" in got[1]["labels"].split(",") and (got[2]["n_words"], got[2]["n_base"], got[2]["base_labels"]) == (6, 1, "cc-by-nc")
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["score"] == 0
    assert got[4]["labels"] == "mit-text" and got[4]["base_labels"] == "" and got[4]["score"] == 1
    assert got[5]["labels"] == "" and (got[6]["n_words"], got[6]["n_base"]) == (5, 0)
    assert license_scan.license_scan(empty(spark)).count() == 0


def test_whole_licenses():
    """A whole text has its -license label; one cut off or altered near its end only that of its opening words."""
    scanner = license_scan.Scanner({}, license_scan.TEMPLATES)

    def labels(text):
        found = license_scan.words(text)
        return {a.label for a in scanner.automata if a.spans(found, b" " + b" ".join(found) + b" ")}

    fill = lambda t: re.sub(r"\{\{\w+:\d+\}\}", "x", re.sub(r"\[\[.*?\]\]", " ", t))
    for name in ("mit", "isc", "bsd-2", "bsd-3", "unlicense"):
        text, opening = fill(license_scan.TEMPLATES[f"{name}-license"]), f"{name.split('-')[0]}-text"
        assert labels(text) == {f"{name}-license", opening}
        assert labels(" ".join(text.split()[:-5])) == labels(text.replace("warranties of", "promises of")) == {opening}


def test_automata_against_patterns():
    rng = np.random.default_rng(0)
    template = "a b [[c [[d]] ]] {{x:2}} e [[f]] g"
    pattern = re.compile(r"(?=(a b (?:c (?:d )?)?(?:\w ){0,2}?e (?:f )?g ))")
    scanner = license_scan.Scanner({}, {"t": template})
    for _ in range(2000):
        tokens = list(rng.choice(list("abcdefg"), rng.integers(0, 14)))
        if rng.random() < 0.7:
            core = [["a", "b"], ["c"] * rng.integers(0, 2), ["d"] * rng.integers(0, 2), list(rng.choice(list("xe"), rng.integers(0, 4))), ["e"], ["f"] * rng.integers(0, 2), ["g"]]
            tokens[1:1] = sum(core, [])
        want = {m.start() // 2 for m in pattern.finditer(" ".join(tokens) + " ")}
        spans = scanner.automata[0].spans([t.encode() for t in tokens], (" " + " ".join(tokens) + " ").encode())
        assert {s for s, _ in spans} == want, tokens
    with pytest.raises(ValueError):
        license_scan.Automaton.compile("x", "a [[ b")
    with pytest.raises(ValueError):
        license_scan.Automaton.compile("x", "[[ b ]]")


# ---- 4


def brute_near(rows, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(spark, size):
    df = documents(spark).where("doc_id is not null")
    want = brute_near([(r["doc_id"], r["text"]) for r in df.collect()], size, 80)
    got = minhash.near_dedup(clashing(df).drop("id"), size=size).collect()
    assert len(got) == df.count() and {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    assert minhash.near_dedup(empty(spark)).count() == 0
    lone = minhash.near_dedup(documents(spark).where("doc_id is null")).first()
    assert lone["component_id"] is None and lone["kept"]


def test_near_dedup_keeps_chains(spark):
    """Groups in which members are like their neighbours but not like the first, in hot buckets."""
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(60)]
        for m in range(12):
            rows.append((int(g * 100 + m), " ".join(words)))
            for k in rng.choice(60, 2, replace=False):
                words[k] = f"g{g}m{m}k{k}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_near(rows, 2, 80)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(df, size=2).collect()}
    assert got == want and len({c for _, c in want.values()}) > 1


def test_near_dedup_joins_rows_of_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b)], "doc_id long, text string")
    assert {(r["id"], r["component_id"]) for r in minhash.near_dedup(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    near = [(1, a + " end"), (2, b + " end"), (3, a), (3, b)]  # no text of 3 is that of another id, each is near one
    got = minhash.near_dedup(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert {(r["id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1)}


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """A group of near copies far larger than a bin, beside a group that shares buckets with it: bins stay small."""
    monkeypatch.setattr(minhash, "BIN", 50)
    monkeypatch.setattr(minhash, "BLOCK", 32)
    monkeypatch.setattr(minhash, "BIN_BYTES", 4000)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*words[:59], f"x{k}"])) for k in range(600)] + [(1000 + k, " ".join([*words[:45], *(f"y{j}" for j in range(14)), f"z{k}"])) for k in range(60)]
    want = brute_near(rows, 2, 80)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=2).collect()}
    assert got == want and len({c for _, c in want.values()}) == 2


def test_near_dedup_takes_few_pairs_from_a_large_group(spark, monkeypatch):
    """Copies of one text, some altered so far that they are linked with few or none, and the center of a group with few: the pairs
    whose sets are compared grow with the group, not with its square, and no link is lost."""
    taken = []
    linked = minhash._linked
    monkeypatch.setattr(minhash, "_linked", lambda chances, *a: (taken.append(chances.count()), linked(chances, *a))[1])
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = [f"w{k}" for k in range(100)]
        for k in rng.choice(100, 6 if i == 0 else (1, 2, 8)[i % 3], replace=False):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    want = brute_near(rows, 2, 80)
    assert got == want and 50 < len({c for _, c in want.values()}) < 350
    assert sum(taken) < 5 * len(rows)


def test_parities_differ_no_more_than_sets():
    rng = np.random.default_rng(6)
    both = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    for k in (0, 1, 40, 900, 4000):
        a, b = minhash.parities(both), minhash.parities(both[: len(both) - k])
        assert len(a) == minhash.PARTS // 8 and sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= k


# ---- 5


def test_quality_learns(spark):
    rng = np.random.default_rng(1)
    words = lambda n: [str(w) for w in rng.choice(["river", "stone", "of", "the", "light", "green"], n)]
    rows = [(k, " ".join(words(200)) if k % 2 else " ".join(w.upper() + "!!" for w in words(200)), "en", "s", 0) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    got = quality.quality_score(clashing(df), labels).select("record.doc_id", "held_out", "score", "predicted").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 300 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    edge = quality.quality_score(documents(spark), labels).select("record.doc_id", "score", "predicted").collect()
    assert len(edge) == 15 and all(0 <= r["score"] <= 1 for r in edge)
    by_id = {r["doc_id"]: r["score"] for r in edge}
    assert by_id[3] == by_id[4]
    assert quality.quality_score(empty(spark), labels).count() == 0
    none = quality.quality_score(df, labels.limit(0)).first()
    assert none["score"] == 0.5 and none["predicted"] == 0


def test_quality_of_long_texts():
    """Piece by piece gives what all passages at once give, and takes no more memory than a piece."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, quality.FEATURES)).astype(np.float32)
    model = quality.fit(x, np.arange(8), np.array([0, 1] * 4, np.float32), rounds=3)
    text = " ".join(str(w) for w in rng.integers(0, 10**6, 100_000))
    features = np.concatenate(list(quality.passages(text.encode())))
    assert len(features) == -(-len(text) // quality.PASSAGE) > 2 * quality.AT_A_TIME
    whole = quality._described(text.encode(), b"")
    assert (features == whole).all()
    at_once = model.forward((whole - model.mean) / model.scale, np.zeros(len(whole), dtype=np.int64), 1)["score"][0]
    assert model.score([text])[0] == pytest.approx(at_once, abs=1e-5)
    tracemalloc.start()
    model.score([text * 30])
    assert tracemalloc.get_traced_memory()[1] < 120 << 20  # the text is 20 MB
    tracemalloc.stop()


def test_quality_sample_is_bounded_in_bytes(spark):
    rows = [(k, ("word " if k % 2 else "WORD!! ") * 200, "en", "s", 0) for k in range(200)] * 3 + [(1000 + k, "x" * 50_000, "en", "s", 0) for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    model = quality.learn(df, labels, most_bytes=60_000)  # not all rows, and no more than one of the long ones
    assert model.score(["word " * 200])[0] > 0.7 > 0.3 > model.score(["WORD!! " * 200])[0]
    assert quality.learn(df, labels, most_bytes=100) is None


def test_quality_gradients():
    rng = np.random.default_rng(2)
    x, bag, y = rng.normal(size=(30, 6)).astype(np.float32), np.sort(rng.integers(0, 8, 30)), rng.integers(0, 2, 8).astype(np.float32)
    bag = np.unique(bag, return_inverse=True)[1]
    y = y[: bag.max() + 1]
    y[:2] = (0, 1)

    def loss(m):
        s = m.forward(((x - m.mean) / m.scale).astype(np.float32), bag, len(y))["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    assert loss(quality.fit(x, bag, y, rounds=300, decay=0)) < 0.2 < loss(quality.fit(x, bag, y, rounds=1, decay=0))


# ---- 6


def brute_top(rows, k, every):
    clean = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            clean.append((i, np.floor(64 * np.array(v, dtype=np.float64))))
    out = []
    for i, q in clean:
        if i % every == 0:
            best = sorted((-int(q @ x), j) for j, x in clean if j != i and len(x) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return Counter(out)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(400)] + [(400 + k, [0.5] * 8) for k in range(200)]
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (1060, [float("inf")] * 8), (None, [1.0] * 8), (1080, [0.0] * 8), (1100, [1.0, 2.0]), (1120, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rounded = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = mtree.top_k(clashing(df).drop("id"), every=20, k=20, page_rows=16, fan=3, tree_bytes=100 * 64, block_bytes=7 * 64, chunk=2)
    assert Counter(map(tuple, got.collect())) == brute_top(rounded, 20, 20)
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_large_components(spark):
    """Sums beyond what a double holds are exact; scores beyond a long are cut to it."""
    rows = [(0, [2.0**24, 1.0]), (1, [2.0**24, 0.5]), (2, [2.0**24, 1 / 64]), (3, [-(2.0**24), 2.0]), (4, [1.0, 1.0]), (20, [0.25, -1.0])] + [(30 + k, [2.0**24, k / 64]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = mtree.top_k(df, every=20, k=5, page_rows=4, fan=2, tree_bytes=10 * 16)
    clean = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = Counter()
    for i, q in clean:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in clean if j != i)[:5]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    assert Counter(map(tuple, got.collect())) == want
    huge = spark.createDataFrame([(0, [1e30, 0.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1e200, 0.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in mtree.top_k(huge).where("query_id = 0").orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 20, 2**63 - 1), (0, 3, 2, 1 - 2**63)]


def test_top_k_prunes(spark):
    """On vectors in clusters, most distances are not computed; the count is that of top_k's own search."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-60, 60, size=(40, 8))
    x = (np.repeat(centres, 100, axis=0) + rng.integers(-2, 3, size=(4000, 8))) / 64
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    sizes = {"page_rows": 64, "tree_bytes": 100 * 64}
    found = mtree.searched(df, **sizes)
    computed, queries = found.agg(F.sum("computed")).first()[0], 200
    assert computed < 0.5 * queries * len(rows)
    assert found.count() < 0.5 * queries * 40  # of 40 trees and more, most are left out
    assert Counter(map(tuple, mtree.top_k(df, **sizes).collect())) == brute_top(rows, 20, 20)


def test_tree_is_an_m_tree():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(-99, 99, size=(3000, 5)), np.zeros((800, 5), int)]).astype(float)
    most = float((x * x).sum(axis=1).max())
    tree = mtree.Tree.load(mtree.Tree.build(np.arange(len(x)), x, most, 32, 4).dump())
    points = mtree.augmented(tree.vectors, most)
    assert sorted(tree.ids) == list(range(len(x))) and not tree.leaf[0]

    def entries(n):
        if tree.leaf[n]:
            assert 0 < tree.last[n] - tree.first[n] <= 32
            assert np.allclose(mtree.gaps(points[tree.first[n] : tree.last[n]], tree.centres[n]), tree.own[tree.first[n] : tree.last[n]])
            return list(range(tree.first[n], tree.last[n]))
        assert tree.last[n] - tree.first[n] <= 4
        for child in range(tree.first[n], tree.last[n]):
            assert np.isclose(tree.to_parent[child], np.linalg.norm(tree.centres[child] - tree.centres[n]))
        own = sum((entries(c) for c in range(tree.first[n], tree.last[n])), [])
        assert mtree.gaps(points[own], tree.centres[n]).max() <= tree.radii[n] + 1e-9
        return own

    assert sorted(entries(0)) == list(range(len(x)))
    for i in (0, 555, 2999, 3500):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(len(x)) if j != i)[:5]
        assert tree.search(i, x[i], 5) == [(-s, j) for s, j in want]
        assert tree.search(i, x[i], 5, -want[2][0]) [:3] == [(-s, j) for s, j in want[:3]]


# ---- 7


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><header><p>Site name</p></header>
        <nav><ul><li><a href="/x">One</a></li></ul></nav><div class="ad">Buy &amp; sell</div><div class="cookie-notice">We use cookies</div>
        <article><h1>Title &amp; more</h1><p>First   <b>bold</b> text<br>goes on.<p>Second, with <a href="#">a link</a>.</p><aside>Side</aside><p>Third&nbsp;one &#233; &lt;tag&gt;</p>
        <form><input><p>Name</p></form><div class="comments"><p>I disagree</p></div></article><!-- c --><footer>&copy; x</footer></body></html>"""
    assert html_extract.main_text(page) == "Title & more First bold text goes on. Second, with a link. Third one é <tag>"
    plain = "<html><body><div id='menu'><a>Home</a></div><div><p>" + "Long text of the page. " * 20 + "</p><p>Short.</p><p>" + "More of it here. " * 9 + "</p></div><div class='sidebar'><p>" + "x " * 400 + "</p></div></body></html>"
    assert html_extract.main_text(plain).startswith("Long text") and html_extract.main_text(plain).endswith("here.") and "Short." in html_extract.main_text(plain)
    assert [html_extract.main_text(p) for p in (None, "", "<p>", "no markup", "<script>x", "<nav>a</nav>")] == ["", "", "", "no markup", "", ""]
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    got = html_extract.html_extract(df.withColumn("text", F.lit(1)).withColumn("record", F.lit(2))).collect()
    assert Counter(r["text"][:5] for r in got) == Counter(["Title", "", ""])
    assert html_extract.html_extract(df.limit(0)).count() == 0


BODY = "<p>" + "</p><p>".join(f"Sentence {k} of the long text, as a paragraph has it." for k in range(6)) + "</p>"
PLAIN = " ".join(f"Sentence {k} of the long text, as a paragraph has it." for k in range(6))


def test_html_asides_end():
    for page in ("<p class='ad'>x" + BODY, "<p class='ad'>x<div>" + BODY + "</div>", "<ul><li class='share'>x<li>" + BODY + "</ul>"):
        assert html_extract.main_text(page) == PLAIN, page
    for page in (
        "<body class='has-sidebar'>{}</body>", "<div class='content with-sidebar'>{}</div>", "<article class='post comments-open'>{}</article>",
        "<main class='search'>{}</main>", "<div class='widget'>{}</div>", "<p title='a hidden gem' data-x=\"class='ad'\">" + "{}",
    ):
        assert html_extract.main_text(page.format(BODY)) == PLAIN, page
    assert html_extract.main_text("<div class='entry-header'><p>Title of it</p></div>" + BODY) == "Title of it " + PLAIN
    assert html_extract.main_text("<div class='sidebar'><p>One, two</p></div>" + BODY + "<p hidden>Not seen</p>") == PLAIN


def test_html_keeps_links_of_the_article():
    inside = "<h2><a href='#t'>Heading</a></h2>" + BODY + "<p><a href='/s'>A sentence.</a></p><ul><li><a href='/r'>Reference</a></li></ul><p>End of it.</p>"
    assert html_extract.main_text("<article>" + inside + "</article>") == "Heading " + PLAIN + " A sentence. Reference End of it."
    assert html_extract.main_text("<div>" + inside + "</div>") == "Heading " + PLAIN + " A sentence. Reference End of it."
    assert html_extract.main_text("<div><a name=x>" + BODY + "</div><p><a href=/y>More</a></p>") == PLAIN
    tops = "".join(f"<div><a href=/{k}>Link {k}" for k in range(2)) + "</div></div>"
    assert html_extract.main_text("<article><p>One <a href=/a>two <a href=/b>three</a> four.</p>" + BODY + "</article>" + tops) == "One two three four. " + PLAIN


def test_html_bridges_what_interrupts_the_article():
    items, shares = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(4)), "<div class='share'><p>a</p><p>b</p><p>c</p><p>d</p></div>"
    end = "<p>The smaller part, after it.</p>"
    menu = "<div>" + "".join(f"<p><a href=/m{k}>Elsewhere {k}</a></p>" for k in range(9)) + "</div>"
    assert html_extract.main_text(menu + "<div>" + BODY + "<ul>" + items + "</ul>" + end + "</div>" + menu) == PLAIN + " Item 0 Item 1 Item 2 Item 3 The smaller part, after it."
    assert html_extract.main_text("<div>" + end + shares + BODY + shares + end + "</div>") == "The smaller part, after it. " + PLAIN + " The smaller part, after it."
    assert html_extract.main_text("<div>" + BODY + "</div>" + menu + "<div><p>(c) x</p></div>") == PLAIN


def test_html_weighs_marked_articles():
    teaser, note = "<article><p>Read this too.</p></article>", "<div><p>A short unmarked note.</p></div>"
    assert html_extract.main_text(teaser + "<div>" + BODY + BODY + "</div>") == "Read this too. " + PLAIN + " " + PLAIN
    links = "<div>" + "".join(f"<p><a href=/{k}>Link {k}</a></p>" for k in range(5)) + "</div>"
    for tag in ("article", "main"):
        assert html_extract.main_text(note + f"<{tag}>" + BODY + links + "<p>End.</p>" + f"</{tag}>" + note) == PLAIN + " Link 0 Link 1 Link 2 Link 3 Link 4 End."
    assert html_extract.main_text("<main><div>" + BODY + "</div><article>" + BODY + "</article></main>") == PLAIN + " " + PLAIN
    assert html_extract.main_text("<article><p><a href=/x>Only a link</a></p></article>" + note) == "A short unmarked note."
    assert html_extract.main_text("<article><p><a href=/x>Only a link</a></p></article>") == "Only a link"


def test_html_without_article_marks():
    """Pages made of known blocks, without any mark of the article: the text between the menus, whatever interrupts it."""
    rng = np.random.default_rng(8)
    words = lambda lo, hi: " ".join(rng.choice(["river", "stone", "of", "the", "light", "green", "house"], int(rng.integers(lo, hi))))
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{k}'>{words(1, 3)}</a></li>" for k in range(rng.integers(4, 9))) + "</ul>"
    for _ in range(200):
        want, body = [words(3, 7)], []
        body.append(f"<h1>{want[0]}</h1>")
        for k in range(int(rng.integers(3, 12))):
            kind = rng.choice(["p", "link", "open", "ad", "quote", "list"]) if 0 < k else "p"
            t = words(8, 40)
            if kind == "ad":
                body.append(f"<div class='ad'><p>{t}</p></div>")
                continue
            want.append(t)
            body.append({"p": f"<p>{t}</p>", "link": f"<p><a href='/x'>{t}</a></p>", "open": f"<p title=it's>{t}", "quote": f"<blockquote>{t}</blockquote>", "list": f"<ul><li>{t}</ul>"}[kind])
        want.append(words(10, 20))
        body.append(f"<p>{want[-1]}</p>")
        page = f"<body>{menu()}{menu()}<div>{''.join(body)}</div>{menu()}<div class='sidebar'><p>{words(20, 60)}</p></div><script>x = '<p>'</script></body>"
        assert html_extract.main_text(page) == " ".join(want), page


def test_html_unclosed_elements():
    for page in (
        "<article><select><option>a<p>rest of text</p></article>", "<title>T<p>rest of text</p>", "<iframe src=x><p>rest of text</p>", "<svg><path><p>rest of text</p>", "<button>ok<p>rest of text</p>",
        "<head><p>rest of text</p>", "<svg><foreignObject><div>x</div></foreignObject></svg><p>rest of text</p>", "<p title=it's>rest of text</p>", '<p title="x>rest of text</p>', "<textarea>x<p>rest of text</p>",
        "<p class='search'>rest of text</p>", "<template><p>x</p></template><p>rest of text</p>", "<p title='a > b'>rest of text</p>",
    ):
        assert html_extract.main_text(page) == "rest of text", page


def test_html_long_pages():
    """Time grows with the length of a page, not with its square."""
    for part in ("<b></i>", "<div>x", "<p><b>", "<div class='ad'>x", "<svg>", "<title>x", "<button>x<p>", "<template><div>", "<a href=x><b><a>"):
        seconds = []
        for n in (2_000, 32_000):
            began = time.process_time()
            html_extract.main_text("<p>The text.</p>" + part * n)
            seconds.append(time.process_time() - began)
        assert seconds[1] < 64 * max(seconds[0], 0.01), part


# ---- 8


def whole_ids(texts):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(queries.tokenizer_path())
    return [reader.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


TRICKY = ["a  b", "a   b ", " \n x", "tab\there  ", "\n\n a\r\n  b", "it's 'll 12 34", "<|endoftext|> x", "a <|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext", "漢字 🙂 é", "   ", "x \n y", "a  b", "", None]


def test_tokenizer_equals_the_file():
    own = packing.Tokenizer(queries.tokenizer_path())
    for text, ids in zip(TRICKY, whole_ids(TRICKY), strict=True):
        assert np.frombuffer(own(text or ""), dtype="<u2").tolist() + [1] == ids, repr(text)


def test_tokenizer_of_a_large_vocabulary(tmp_path):
    """Ids beyond 16 bits, and a file that is not byte-level BPE."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = {f"w{k}": k for k in range(70_000)}
    reader = Tokenizer(models.WordLevel({**vocab, "?": 70_000}, unk_token="?"))
    reader.pre_tokenizer = pre_tokenizers.Whitespace()
    reader.save(str(tmp_path / "words.json"))
    own = packing.Tokenizer(str(tmp_path / "words.json"))
    assert np.frombuffer(own("w3 w69999 x w65536"), dtype="<u4").tolist() == [3, 69_999, 70_000, 65_536]
    pdf = pd.DataFrame({"id": [1], "source": ["s"], "n": [4], "ids": [own("w3 w69999 x w65536")]})
    assert [(r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()) for r in packing._pieces(pdf, 0, 3).itertuples()] == [(0, 3, [3, 69_999, 70_000]), (3, 1, [65_536])]


def test_packing_spreads_equal_rows(spark):
    df = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same text " * 5).alias("text"), F.lit("s").alias("source"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = packing.pack(df, tokenizer_path=queries.tokenizer_path(), slice_tokens=1 << 14, length=128)
        tasks = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert got.agg(F.sum("length")).first()[0] == 17 * 100_000 and len(tasks) > 4 and max(tasks) < 3 * np.median(tasks)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}])
def test_packing(spark, weights):
    base = documents(spark).where("doc_id is not null and doc_id <> 11")
    more = spark.createDataFrame([(100 + k, t, "en", "abc"[k % 3], 0) for k, t in enumerate(TRICKY)] + [(200 + k, f"word {k} " * (k % 50), "en", "a" if k % 3 else "b", 0) for k in range(400)], SCHEMA)
    df = base.unionByName(more)
    got = packing.pack(clashing(df).drop("id"), tokenizer_path=queries.tokenizer_path(), weights=weights, length=256).collect()
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    ids = dict(zip(docs, whole_ids(docs.values()), strict=True))
    rebuilt = {}
    for r in sorted(got, key=lambda r: (r["id"], r["start"])):
        own = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids[r["id"]]) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and np.frombuffer(r["ids"], "<u2").tolist() == own
        rebuilt[r["id"]] = rebuilt.get(r["id"], []) + own
    assert rebuilt == ids
    by_sequence = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert by_sequence.get(r["sequence_id"], 0) == r["offset"]
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(by_sequence) == list(range(len(by_sequence))) and all(n == 256 for k, n in by_sequence.items() if k < len(by_sequence) - 1)
    assert packing.pack(empty(spark), tokenizer_path=queries.tokenizer_path()).count() == 0


def test_round_robin_keeps_to_shares():
    rng = np.random.default_rng(6)
    sizes, queues = rng.integers(1, 60, 6000), rng.choice([1, 2, 3], 6000, p=[0.6, 0.3, 0.1])
    total = sizes.sum()
    shares = {q: sizes[queues == q].sum() / total for q in (1, 2, 3)}
    order = packing.serve(sizes, queues, shares, {}, 256, 256)
    assert sorted(order) == list(range(6000))
    taken = np.cumsum(sizes[order])
    for q in (1, 2, 3):
        own = np.cumsum(np.where(queues[order] == q, sizes[order], 0))
        assert np.abs(own - shares[q] * taken).max() <= 256 + 60


# ---- 9


def brute_edf(supply):
    """Slot by slot over whole virtual time: of all released blocks, by looking at every source, the one due first."""
    total, done, now, out = sum(w for _, _, w in supply), [0] * len(supply), 0, []
    while any(d < n for d, (_, n, _) in zip(done, supply, strict=True)):
        ready = [(-(-(done[r] + 1) * total // w), r) for r, (_, n, w) in enumerate(supply) if done[r] < n and done[r] * total <= (now + 1) * w - 1]
        if ready:
            due, r = min(ready)
            out.append((supply[r][0], done[r], done[r] * total // supply[r][2], due))
            done[r] += 1
        now += 1
    return out


def scheduled(supply):
    total = sum(w for _, _, w in supply)
    return [x for period in range(max([0, *(-(-n // w) for _, n, w in supply)])) for x in mixing.pfair(supply, total, period)]


def test_pfair_lag():
    full = [("a", 700, 7), ("b", 300, 3), ("c", 100, 1)]
    done = Counter()
    for slot, (source, _, release, deadline) in enumerate(scheduled(full)):
        done[source] += 1
        assert release <= slot < deadline
        assert all(abs(done[s] - (slot + 1) * w / 11) < 1 for s, _, w in full)
    assert list(mixing.pfair([], 1, 0)) == []


def test_pfair_against_slot_by_slot():
    rng = np.random.default_rng(9)
    for _ in range(60):
        supply = [(f"s{k}", int(rng.integers(1, 60)), int(rng.integers(1, 12))) for k in range(rng.integers(1, 7))]
        assert scheduled(supply) == brute_edf(supply), supply


def mixed_rows(df, **options):
    return mixing.mix(df, **options).select("record.doc_id", "record.source", "weight", "block", "release", "deadline", "slot", "place").collect()


def test_mixing_periods(spark):
    """Weights whose sum is small against the blocks: many periods, each a task's work; and many equal rows, which are spread."""
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") % 50 == 1, "c").otherwise("a").alias("source"))
    got = mixed_rows(df, weights={"a": 3, "b": 2, "c": 1}, block_rows=2)
    supply = Counter(r["source"] for r in got)
    want = brute_edf([(s, -(-n // 2), {"a": 3, "b": 2, "c": 1}[s]) for s, n in sorted(supply.items())])
    assert sorted({(r["slot"], r["source"], r["block"], r["release"], r["deadline"]) for r in got}) == [(k, *x) for k, x in enumerate(want)]
    assert len(got) == 3000 and len({(r["slot"], r["place"]) for r in got}) == 3000


def test_mixing(spark):
    more = spark.createDataFrame([(100 + k, "x", "en", "a" if k % 3 else "b", 0) for k in range(500)], SCHEMA)
    df = documents(spark).unionByName(more)
    got = mixing.mix(clashing(df), block_rows=4).select("record.doc_id", "record.source", "weight", "block", "release", "deadline", "slot", "place").collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r["doc_id"], r["source"]) for r in df.collect())
    blocks = {}
    for r in got:
        blocks.setdefault((r["source"], r["block"]), []).append(r)
    supply = Counter(s for s, _ in blocks)
    for (source, block), rows in blocks.items():
        assert sorted(r["place"] for r in rows) == list(range(len(rows))) and len({r["slot"] for r in rows}) == 1
        assert len(rows) == 4 or block == supply[source] - 1
    weight = {r["source"]: r["weight"] for r in got}
    named = sorted(("" if s is None else f"={s}", n, weight[s]) for s, n in supply.items())
    want = {(s, k): (r, d, slot) for slot, (s, k, r, d) in enumerate(brute_edf(named))}
    assert {("" if s is None else f"={s}", k): (rows[0]["release"], rows[0]["deadline"], rows[0]["slot"]) for (s, k), rows in blocks.items()} == want
    counts = Counter(r["source"] for r in got)
    assert all(weight[s] == max(1, round(65536 * n**0.5 / sum(m**0.5 for m in counts.values()))) for s, n in counts.items())
    assert mixing.in_order(mixing.mix(df)).columns == df.columns
    assert mixing.mix(empty(spark)).count() == 0
    named = mixing.mix(df, weights={"a": 5, "b": 1}).select("record.source", "weight").distinct().collect()
    assert {r["source"]: r["weight"] for r in named} == {"a": 5, "b": 1, "c": 1, None: 1}


# ---- 10


def brute_lines(rows):
    first = {}
    for i, t in rows:
        if i is not None and t is not None:
            for line in t.split("\n"):
                first.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(first.get(key(x), ())) < 2 or min(first[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    return Counter(out)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_line_dedup(spark):
    more = spark.createDataFrame([(100 + k, f"line of group {k % 7}\n\tLINE of Group {k % 5}\nown line of {k}\né漢字éé漢字é漢\n{'x' * (k % 12)}", "en", "s", 0) for k in range(60)], SCHEMA)
    df = documents(spark).unionByName(more)
    want = brute_lines([(r["doc_id"], r["text"]) for r in df.collect()])
    got = line_dedup.line_dedup(clashing(df), shard_lines=3, probe_rows=5).select("record.doc_id", "n_lines", "n_dropped", "record.text").collect()
    assert Counter(map(tuple, got)) == want
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_spreads_a_hot_line(spark):
    """A line that a hundred thousand documents have is probed in many tasks, and few lines each."""
    df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that all of them have\nown line number "), "id").alias("text"))
    got = line_dedup.line_dedup(df, probe_rows=1 << 13, shard_lines=1 << 14)
    assert got.groupBy("n_dropped").count().orderBy("n_dropped").collect() == [(0, 1), (1, 99_999)]
    hot = pd.DataFrame({"shard": 0, "high": [1, 2], "low": [3, 4], "lines": [100_000, 1], "first": [0, 5], "last": [99_999, 5]})
    assert line_dedup._build(hot)["probes"].tolist() == [100_001]


def test_shard_arrays_are_those_probed():
    rows = pd.DataFrame({"shard": 0, "high": np.arange(9), "low": np.arange(9) * 7, "lines": [1, 2, 2, 300, 1, 1, 1, 1, 1], "first": 5, "last": [5, 5, 9, 9, 5, 5, 5, 5, 5]})
    built = line_dedup._build(rows)
    assert list(built.columns) == [x.split()[0] for x in line_dedup.SHARD.split(", ")]
    assert sorted(np.frombuffer(built["counts"][0], np.uint8).tolist()) == [1] * 7 + [2, 255]
    lines = pd.DataFrame({"id": [4, 5, 6, 6, 6, 6], "high": [3, 3, 3, 3, 1, 2], "low": [21, 21, 21, 22, 7, 14]})
    assert line_dedup._probe(lines, built).values.tolist() == [[6, 3, 21], [6, 2, 14]]
    same = np.array([5, 5 ^ int(line_dedup._mix(np.array([1], np.uint64), 1000)[0] ^ line_dedup._mix(np.array([2], np.uint64), 1000)[0])], dtype=np.uint64).view(np.int64)
    clash = pd.DataFrame({"shard": 0, "high": same, "low": [1, 2], "lines": 1, "first": 0, "last": 0})
    assert line_dedup._build(clash)["seed"].tolist() == [1001]  # two hashes with the same 64 bits: other bits are taken


def test_perfect_hash():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 10, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        made = line_dedup.PerfectHash(keys)
        again = line_dedup.PerfectHash.load(*made.dump())
        assert sorted(made(keys).tolist()) == list(range(len(keys))) and again(keys).tolist() == made(keys).tolist()
