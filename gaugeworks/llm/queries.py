"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, common, divergence, jaccard, langid, licenses, merkle, mixing, neardup_vectors, oracles, packing, quality, secretscan, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "margin")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "matches")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secretscan.digest(F.col("base")), 256).alias("base_sha256"), secretscan.digest(F.col("found")).alias("spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/gaugeworks/warc-{uuid.uuid4().hex}"
    return warc.read(spark, warc.write(read(spark, sf_dir, "pages"), folder)).drop("url")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(quality.sample(docs, read(spark, sf_dir, "labels"), 3000))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.deduplicate(read(spark, sf_dir, "embeddings"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).drop("text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"text": merkle.lowered("text")}, merkle.third("doc_id"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).drop("shard", "shard_size", "shard_blocks", "block")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_license_scan": op2_license_scan,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc": op4_warc,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_packing": op9_packing,
    "op10_nearest": op10_nearest,
    "op11_source_divergence": op11_source_divergence,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_source_mixing": op13_source_mixing,
}

#: DuckDB SQL of those queries whose rows SQL can express.
ORACLES: dict[str, str] = {
    "op3_secret_scan": oracles.SECRETS,
    "op4_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
        r AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AND first IS NOT NULL AS again FROM f)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
    """,
    "op11_source_divergence": oracles.DIVERGENCE,
    "op12_merkle_manifest": oracles.MERKLE,
}
