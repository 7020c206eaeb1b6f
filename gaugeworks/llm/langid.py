"""Language identification by string kernels.

The kernel of two texts counts the distinct character n-grams of orders 1 to 4 that both hold (a blended
spectrum of presences), divided by the root of the product of their own counts. Texts are compared with a
bounded set of landmark texts; the Nystroem map turns these similarities into features, and kernel ridge
regression learns one function against the rest for each language. n-grams are hashed to 2**16 buckets, so that
a batch of texts is one presence matrix; similarities, map and regression are linear in its rows and are
multiplied together once after fitting: scoring a batch is one matrix product.

Defined results: a null text, an empty one and one without a letter get `und` with score 0; so does every text if
nothing could be learned (no labelled rows). Rows with a null language or id are never learned from. Equal
scores go to the language that sorts first. Repeated rows each get their result. Whole texts count,
window by window, however long. Columns of the input other than those named are kept and never read; a column that
has the name of an output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, grams

BITS, ORDERS = 16, (1, 2, 3, 4)
#: The margin that rejects a text is 0, or lower if more than this share of the rows learned from were below.
REJECTED = 0.005
KIND = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64())])


@dataclass
class LanguageModel:
    """languages, sorted; weights: 2**BITS x languages, what each present n-gram adds before division; least: texts with a
    margin below it are of no language learned."""

    languages: list[str]
    weights: np.ndarray
    least: float = 0.0


@cache
def _letters() -> np.ndarray:
    """Each 16-bit code to itself if a letter, else to a space."""
    return np.array([k if chr(k).isalpha() else 32 for k in range(1 << 16)], np.uint16)


def presence(text: str | None) -> np.ndarray:
    """Which n-gram buckets the whole text has; nothing at all if it has no letter."""
    seen = np.zeros(1 << BITS, bool)
    for part in grams.windows((text or "").lower(), max(ORDERS) - 1):
        x = grams.codes(part)
        high = x[x >= 1 << 16]
        x = np.where(x < 1 << 16, _letters()[np.minimum(x, 0xFFFF)], np.uint16(0xF8FF))
        if len(high):  # letters of planes above go to one private code
            own, at = np.unique(high, return_inverse=True)
            x[x == 0xF8FF] = np.array([0xF8FF if chr(k).isalpha() else 32 for k in own.tolist()], np.uint16)[at]
        keep = x != 32
        if not keep.any():
            continue
        keep[1:] |= x[:-1] != 32
        x = x[keep]
        for n in ORDERS:
            seen[grams.buckets(x, n, BITS)] = True
    return seen


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", per_lang: int = 400, landmarks: int = 160, ridge: float = 1e-2) -> LanguageModel:
    """Learns from about per_lang rows of each language at most, drawn by a hash of the id.

    The bound on the sample is per_lang rows a language; the driver gets 8 KB for each (presence bits, no texts).
    landmarks: in all, shared evenly among languages, 4 each at least.
    """
    rows = labelled.select(F.col(id).alias("i"), F.col(lang).alias("l"), F.col(text).alias("t")).where("i is not null and l is not null and t is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32))
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(scale, int(scale * 1.2 * per_lang / n) + 1))])
    draw = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit("language sample")), F.lit(scale))

    @F.arrow_udf("binary")
    def bits(t: pa.Array) -> pa.Array:
        return pa.array([np.packbits(presence(x)).tobytes() for x in t.to_pylist()], pa.binary())

    common.batches(labelled.sparkSession)
    got = rows.withColumn("d", draw).where(F.col("d") < share[F.col("l")]).select("i", "l", "d", bits("t").alias("b")).collect()
    got.sort(key=lambda r: (r["l"], r["d"], str(r["i"])))
    by: dict[str, list[np.ndarray]] = {}
    for r in got:
        x = np.frombuffer(r["b"], np.uint8)
        if x.any() and len(by.setdefault(r["l"], [])) < per_lang:
            by[r["l"]].append(x)
    langs = sorted(k for k, v in by.items() if v)
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32))
    each = max(4, landmarks // len(langs))

    def unit(packed: list[np.ndarray]) -> np.ndarray:
        m = np.unpackbits(np.array(packed), axis=1).astype(np.float32)
        m /= np.sqrt(m.sum(1, keepdims=True))
        return m

    marks = unit([x for k in langs for x in by[k][:each]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.concatenate([unit(by[k][at : at + 64]) @ marks.T @ root for k in langs for at in range(0, len(by[k]), 64)])
    truth = np.repeat(np.arange(len(langs)), [len(by[k]) for k in langs])
    size = np.bincount(truth)
    weight = (len(truth) / (len(langs) * size))[truth][:, None]  # languages count alike, however many rows each has
    target = np.where(truth[:, None] == np.arange(len(langs)), 1.0, -1.0)
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * len(truth) * np.eye(phi.shape[1]) / phi.shape[1], phi.T @ (weight * target))
    least = min(0.0, float(np.quantile((phi @ solved).max(1), REJECTED)))
    return LanguageModel(langs, (marks.T @ (root @ solved)).astype(np.float32), least)


def predict(texts: list[str | None], model: LanguageModel, block: int = 64) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores and margins. The margin is the winning function's value: about 1 for
    what was learned, below 0 where every function says that the text is of the rest. The score is the margin's place
    between -1 and 1, cut to 0 and 1."""
    names, score, margin = [], np.zeros(len(texts)), np.full(len(texts), -1.0)
    for at in range(0, len(texts), block):
        p = np.array([presence(x) for x in texts[at : at + block]])
        n = p.sum(1)
        f = (p.astype(np.float32) @ model.weights) / np.sqrt(np.maximum(n, 1))[:, None]
        for k in range(len(p)):
            if not n[k] or not model.languages:
                names.append("und")
                continue
            best = int(np.argmax(f[k]))
            names.append(model.languages[best])
            margin[at + k] = f[k, best]
            score[at + k] = min(1.0, max(0.0, (f[k, best] + 1) / 2))
    return names, score, margin


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and margin."""
    common.batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB a language

    @F.arrow_udf("lang_pred string, score double, margin double")
    def udf(t: pa.Array) -> pa.Array:
        names, score, margin = predict(t.to_pylist(), held.value)
        return common.struct_array(KIND, lang_pred=names, score=score, margin=margin)

    out = udf(F.col(text).cast("string"))
    return common.widened(docs, out, KIND.names)


def held_out(id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, mod 4, is 2 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 4 == 2, F.lit(False))
