"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE` bytes; every passage of the whole text is encoded. Gated attention,
w . (tanh(V h) * sigmoid(U h)), weighs the passages; the weighted mean representation is scored by a logistic unit. Encoder,
attention and score are learned together from document labels, by gradient descent on the driver over a sample of labelled
rows that is bounded in rows and in bytes. A long text is encoded and weighed some passages at a time.

A passage is described by how often character classes follow one another in it and by how much of it repeats. Language,
source and id are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, importable

PASSAGE = 1024
#: Passages of one text that are encoded at a time.
AT_A_TIME = 256
_SINGLE = b".,!?;:'\"-|*#$%&/()@_<>="
_CLASS = np.full(256, 5, dtype=np.int64)
for _k, _bytes in enumerate((b" ", b"\n\r\t", bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)))):
    _CLASS[list(_bytes)] = _k
_CLASS[128:] = 6
for _k, _b in enumerate(_SINGLE):
    _CLASS[_b] = 7 + _k
CLASSES = 7 + len(_SINGLE)
FEATURES = CLASSES * CLASSES + 4


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def passages(raw: bytes) -> Iterator[np.ndarray]:
    """A row of features for each passage, AT_A_TIME passages in an array; an empty text has one passage without characters."""
    step = AT_A_TIME * PASSAGE
    for at in range(0, max(1, len(raw)), step):
        yield _described(raw[at : at + step], raw[at + step : at + step + 1])


def _described(raw: bytes, after: bytes) -> np.ndarray:
    """The passages of a piece; after: the byte that follows it, if there is one."""
    n = max(1, -(-len(raw) // PASSAGE))
    classes = _CLASS[np.frombuffer(raw + after, dtype=np.uint8)]
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if len(classes) > 1:
        where = np.arange(len(classes) - 1) // PASSAGE
        pairs = np.bincount(where * (CLASSES * CLASSES) + classes[:-1] * CLASSES + classes[1:], minlength=n * CLASSES * CLASSES)
        out[:, : CLASSES * CLASSES] = pairs.reshape(n, -1)
    for k in range(n):
        part = raw[k * PASSAGE : (k + 1) * PASSAGE]
        words = part.split()
        size = max(1, len(part))
        out[k, : CLASSES * CLASSES] /= size
        out[k, -4:] = (len(zlib.compress(part, 1)) / (size + 20), len(set(words)) / max(1, len(words)), size / PASSAGE, len(words) / size)
    np.sqrt(out[:, : CLASSES * CLASSES], out=out[:, : CLASSES * CLASSES])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """x: normalised passages; bag: the document of each."""
        p = self.weights
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (v * u) @ p["w"]
        top = np.full(bags, -np.inf, dtype=np.float32)
        np.maximum.at(top, bag, a)
        ex = np.exp(a - top[bag])
        att = ex / np.bincount(bag, ex, bags)[bag]
        z = np.zeros((bags, h.shape[1]))
        np.add.at(z, bag, att[:, None] * h)
        return {"h": h, "v": v, "u": u, "att": att, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Each text for itself, so that a text's score does not depend on its neighbours. The attention over its passages is
        summed up piece by piece: what is kept is the largest weight so far, the sum of weights and that of weighted passages."""
        p, out = self.weights, np.empty(len(texts))
        for k, t in enumerate(texts):
            top, total, z = -np.inf, 0.0, 0.0
            for x in passages(encoded(t)):
                h = np.tanh(((x - self.mean) / self.scale) @ p["E"] + p["e"])
                a = ((np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]).astype(np.float64)
                best = max(top, a.max())
                ex, shrink = np.exp(a - best), np.exp(top - best)
                top, total, z = best, total * shrink + ex.sum(), z * shrink + ex @ h
            out[k] = _sigmoid(z / total @ p["c"] + p["d"])
        return out


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, *, hidden: int = 16, gate: int = 8, rounds: int = 250, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Model:
    """x: passages of all bags; bag: 0..len(y)-1 for each; y: labels 0/1. Full-batch Adam on the log loss."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    shape = {"E": (x.shape[1], hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": ()}
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    model, bags = Model(mean.astype(np.float32), scale.astype(np.float32), p), len(y)
    x = ((x - mean) / scale).astype(np.float32)
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for t in range(1, rounds + 1):
        f = model.forward(x, bag, bags)
        ds = ((f["score"] - y) / bags).astype(np.float32)
        g = {"c": f["z"].T @ ds, "d": ds.sum()}
        dz = ds[:, None] * p["c"]
        dzb = dz[bag]
        dh = f["att"][:, None] * dzb
        datt = (dzb * f["h"]).sum(axis=1)
        da = f["att"] * (datt - np.bincount(bag, f["att"] * datt, bags)[bag])
        dv, du = da[:, None] * p["w"] * f["u"], da[:, None] * p["w"] * f["v"]
        g["w"] = (f["v"] * f["u"]).T @ da
        dv, du = dv * (1 - f["v"] ** 2), du * f["u"] * (1 - f["u"])
        g["V"], g["U"] = f["h"].T @ dv, f["h"].T @ du
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        g["E"], g["e"] = x.T @ dh.astype(np.float32), dh.sum(axis=0)
        for k in p:
            step = g[k] + (decay * p[k] if p[k].ndim == 2 else 0)
            m[k] = 0.9 * m[k] + 0.1 * step
            s[k] = 0.999 * s[k] + 0.001 * step**2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str):
    """Rows that no model sees: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(col(id_col).cast("string").cast("binary")) % 4 == 2


def learn(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 3000, most_bytes: int = 16 << 20
) -> Model | None:
    """A model from at most `most_rows` labelled rows outside the held-out fold, taken in the order of a hash of the id, and of
    these as many as have at most `most_bytes` of text together; each text is read whole. Their passages' features, about
    1.8 bytes for a byte of text, come to the driver. Where an id has several rows, the least text counts. Without two kinds
    of label there is no model."""
    spark = df.sparkSession
    ids = labels.select(col(id_col).alias("id"), col(label_col).alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id"))
    ids = ids.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    text = F.coalesce(col(text_col), F.lit(""))
    rows = df.select(col(id_col).alias("id"), text.alias("text")).join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = Scratch(spark, "quality").write(rows, "labelled", most_rows)
    chosen, size = [], 0
    for r in rows.select("id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id").collect():
        if size + r["n"] <= most_bytes:
            chosen.append(r["id"])
            size += r["n"]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "x": [np.concatenate(list(passages(encoded(t)))).astype(np.float16).tobytes() for t in batch["text"]]})

    kind = dict(rows.dtypes)["id"]
    used = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in chosen], f"id {kind}")), "id", "left_semi")
    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in used.mapInPandas(describe, f"id {kind}, y int, x binary").collect())
    y = np.array([r[1] for r in got], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        return None
    x = [np.frombuffer(r[2], dtype=np.float16).reshape(-1, FEATURES).astype(np.float32) for r in got]
    bag = np.repeat(np.arange(len(x)), [len(b) for b in x])
    return fit(np.concatenate(x), bag, y)


def quality_score(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = 3000, most_bytes: int = 16 << 20, least: float = 0.7) -> DataFrame:
    """The columns of df in a struct `record`, with held_out boolean, score double (0 to 1) and predicted int (1 if score >=
    least). Null and empty texts are scored as one empty passage. Rows with a null id are not held out. Equal texts have
    equal scores. An empty table gives an empty one. A text is scored on the whole, however long, in memory that does not grow
    with it but for the text itself. most_rows, most_bytes: see learn(). Without labels of both kinds every score is the share of label 1 among them, or 0.5 without any."""
    importable(df.sparkSession)
    model = learn(df, labels, id_col=id_col, text_col=text_col, label_col=label_col, most_rows=most_rows, most_bytes=most_bytes)
    flat = 0.5
    if model is None:
        seen = labels.where(~F.coalesce(held_out(id_col), F.lit(False))).where(col(label_col).isin(0, 1)).agg(F.avg(col(label_col))).first()[0]
        flat = 0.5 if seen is None else float(seen)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()) if model else np.full(len(texts), flat))

    record = F.struct(*[col(c) for c in df.columns]).alias("record")
    scored = df.select(record, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), score(F.coalesce(col(text_col), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
