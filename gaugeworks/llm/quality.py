"""A quality classifier: supervised embeddings of hashed subwords.

Words, pairs of neighbouring words and character n-grams of orders 2 to 4 are hashed to 2**15 buckets,
each with a learned vector; a text is the average of the vectors of all it holds, and a softmax layer
tells the probability of label 1. Vectors and layer are trained together by stochastic gradient descent in numpy.
After training, vectors times layer is one 2**15 x 2 matrix, so that scoring a batch is a matrix product of counts.
Equal neighbouring words share one pair bucket, so that repetition can be learned whatever the word.

Defined results: a null or empty text has no features and gets the softmax of the bias; without labelled rows every
score is 0.5. A document with several labels counts as its largest; null labels and ids are skipped. Every row gets its
result, repeated or not. Whole texts count, window by window. Columns other than those named are kept and never read; a column
that has the name of an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, grams

BITS, ORDERS = 15, (2, 3, 4)
SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


@dataclass
class QualityModel:
    """weights: 2**BITS x 2 (vectors times layer); bias: 2."""

    weights: np.ndarray
    bias: np.ndarray


def counts(text: str | None) -> np.ndarray:
    """How often each bucket occurs in the whole text."""
    out = np.zeros(1 << BITS)
    for part in grams.windows(text or "", max(ORDERS) - 1):
        x = grams.codes(part)
        space = (x == 32) | ((x >= 9) & (x <= 13))
        w = grams.words(x, space)
        short = np.minimum(np.where(space, np.uint32(32), x), 0xFFFF).astype(np.uint16)
        found = [grams.buckets(short, n, BITS) for n in ORDERS]
        mixed = common.mix64(w)
        found.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        pair = common.mix64(mixed[:-1] * np.uint64(3) + mixed[1:])
        pair[w[:-1] == w[1:]] = np.uint64(1 << 63)
        found.append((pair >> np.uint64(64 - BITS)).astype(np.int64))
        out += np.bincount(np.concatenate(found), minlength=1 << BITS)
    return out


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", id: str = "doc_id", max_rows: int = 3000, size: int = 12, epochs: int = 8, rate: float = 3.0, seed: int = 7) -> QualityModel:
    """Learns from about max_rows labelled rows at most, drawn by a hash of the id.

    The bound on the sample is max_rows; the driver gets their bucket counts, no texts.
    labelled: one row for each labelled document, with text and label (0 or 1).
    """
    rows = labelled.select(F.col(id).alias("i"), F.col(label).cast("int").alias("y"), F.col(text).alias("t")).where("i is not null and y is not null")

    @F.arrow_udf("binary")
    def packed(t: pa.Array) -> pa.Array:
        out = []
        for x in t.to_pylist():
            c = counts(x)
            k = np.flatnonzero(c)
            out.append(k.astype("<u2").tobytes() + c[k].astype("<f4").tobytes())
        return pa.array(out, pa.binary())

    common.batches(labelled.sparkSession)
    got = sorted(rows.select("i", "y", packed("t").alias("c")).collect(), key=lambda r: str(r["i"]))[:max_rows]
    empty = QualityModel(np.zeros((1 << BITS, 2), np.float32), np.zeros(2))
    if not got:
        return empty
    data = []
    for r in got:
        n = len(r["c"]) // 6
        # views of what was collected: no second copy on the driver
        data.append((np.frombuffer(r["c"], "<u2", n), np.frombuffer(r["c"], "<f4", n, 2 * n), int(r["y"] > 0)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (1 << BITS, size)).astype(np.float32)
    layer, bias = rng.uniform(-0.5, 0.5, (size, 2)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(data), 0
    for _ in range(epochs):
        for at in rng.permutation(len(data)):
            k, c, y = data[at]
            c = (c / max(1.0, c.sum())).astype(np.float32)
            step = rate * (1 - done / steps)
            done += 1
            own = vectors[k]
            h = c @ own
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= (step * 0.1) * np.outer(h, p)
            bias -= (step * 0.02) * p
            vectors[k] = own - (step * len(k) ** 0.5) * np.outer(c, back)
    return QualityModel((vectors @ layer).astype(np.float32), bias.astype(np.float64))


def probabilities(texts: list[str | None], model: QualityModel, block: int = 64) -> np.ndarray:
    """The probability of label 1 for each text."""
    out = np.empty(len(texts))
    for at in range(0, len(texts), block):
        m = np.array([counts(x) for x in texts[at : at + block]])
        n = np.maximum(m.sum(1), 1)[:, None]
        z = (m.astype(np.float32) @ model.weights) / n + model.bias
        out[at : at + block] = 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))
    return out


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1, and predicted (1 if the score is 0.5 or more, else 0)."""
    common.batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB

    @F.arrow_udf("double")
    def udf(t: pa.Array) -> pa.Array:
        return pa.array(probabilities(t.to_pylist(), held.value), pa.float64())

    return docs.withColumn("score", udf(F.col(text).cast("string"))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, id: str = "doc_id", label: str = "quality", text: str = "text") -> DataFrame:
    """About max_rows labelled documents at most, without those held out: (id, label, text)."""
    draw = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("quality sample")), F.lit(1 << 30))
    marked = labels.select(F.col(id).alias("i"), F.col(label).cast("int").alias("y")).where(~held_out("i") & F.col("i").isNotNull() & F.col("y").isNotNull())
    known = marked.agg(F.count(F.lit(1))).first()[0]
    share = min(1 << 30, int((1 << 30) * max_rows / max(known, 1)) + 1)
    few = marked.where(draw < share).groupBy("i").agg(F.max("y").alias("y"))
    own = docs.select(F.col(id).alias("i"), F.col(text).alias("t"))
    # few has about max_rows rows of 12 bytes, by the share that is drawn
    return own.join(F.broadcast(few), "i").select(F.col("i").alias(id), F.col("y").alias(label), F.col("t").alias(text))


def held_out(id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 3, is 1 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))
