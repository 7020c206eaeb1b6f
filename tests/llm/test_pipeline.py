"""The pipeline, stage by stage, against plain computations on a small table."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from .test_near import brute
from .test_texts import brute_secrets, packed

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit(1))
    extra = spark.createDataFrame([(9001, None, None, None, None, 1), (9002, "12345 !!", "en", "s", 8, 1), (None, "null id stays here", "en", None, None, 1)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.where("doc_id = 3"))
    stages = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_copies", "secrets", "packing"]

    one = stages["language"](spark, docs, SMALL)
    kept = lambda df: sorted(str(r["doc_id"]) for r in df.collect())
    assert one.columns == docs.columns and kept(one) == sorted(str(r["doc_id"]) for r in docs.collect() if any(c.isalpha() for c in r["text"] or ""))

    two = stages["quality"](spark, one, SMALL)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    left = {r["doc_id"] for r in two.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert two.columns == docs.columns and sum(i in left for i in good) >= 0.95 * len(good) and sum(i in left for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values()) + 1

    three = stages["near_copies"](spark, two, SMALL)
    want = [str(i) for i, (_, root) in brute({(r["doc_id"], r["text"]) for r in two.collect() if r["doc_id"] is not None}).items() if i == root]
    assert three.columns == docs.columns and kept(three) == sorted([*want, *(["None"] if None in left else [])])

    four = stages["secrets"](spark, three, SMALL)
    before = {r["doc_id"]: r for r in three.collect()}
    assert four.columns == docs.columns and four.count() == len(before)
    for r in four.collect():
        old = before[r["doc_id"]]
        assert (r["text"] == old["text"]) == (not brute_secrets(old["text"])[2]) and (r["text"] == old["text"] and r["n_chars"] == old["n_chars"] or "[secret]" in r["text"] and r["n_chars"] == len(r["text"]))

    packed(stages["packing"](spark, four, SMALL).collect(), [(r["doc_id"], r["text"]) for r in four.collect()])


def test_language_rejects_what_was_not_learned(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rng = random.Random(3)
    other = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах.", "人人生而自由,在尊严和权利上一律平等。",
        *(" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(60)) for _ in range(20)),
    ]
    # null labels: nothing is learned from these
    more = spark.createDataFrame([(10**6 + k, x, None, "s", len(x)) for k, x in enumerate(other)], docs.schema)
    left = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(more), d).select("doc_id").collect()}
    assert not any(i >= 10**6 for i in left)
    assert len(left) >= 0.99 * docs.count()


def test_quality_stage_follows_the_operator(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = lambda docs, model: docs.withColumn("score", F.lit(0.3)).withColumn("predicted", F.when(F.col("row.doc_id") % 2 == 0, 1).otherwise(0))
    monkeypatch.setattr(corpus_pipeline.quality, "score", told)
    got = [r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, SMALL).collect()]
    assert sorted(got) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] % 2 == 0)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 50
