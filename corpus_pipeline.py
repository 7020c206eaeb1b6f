"""The corpus pipeline: language, quality, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored before the next stage reads it. Stages but the last return
the columns of docs; columns beside those that a stage works on go through unchanged.

- language: documents without a letter go (`und`), null and empty texts among them; so do those whose margin is below the model's
  `least`: every function says that the text is of none of the languages learned.
- quality: documents that the classifier rejects go (`predicted` is 0).
- near_copies: of documents whose shingle sets link, directly or through others, the one with the smallest id stays; of
  rows that share an id, the one with the smallest text, then the smallest other columns. Rows with a null id link with nothing and stay.
- secrets: spans found are replaced by a mark; n_chars follows where a text changes, and only there.
- packing: the pieces of all that is left.

Whole texts of any length are worked on, in windows or segments where they are long. Empty tables go through every stage and give empty ones. A
column of docs may have any name, those of the stages' own results too: such columns go through as they came.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm import common, jaccard, langid, packing, quality, secretscan

LABELLED_ROWS = 3000  # bound on the sample that the quality classifier learns from
END_ID = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.identify(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return told.where((F.col("lang_pred") != "und") & (F.col("margin") >= model.least)).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.sample(docs, labels, LABELLED_ROWS))
    told = quality.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return told.where(F.col("predicted") == 1).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = jaccard.join(docs)
    gone = told.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    left = known.join(gone, "doc_id", "left_anti").select(F.struct(*docs.columns).alias("row"), "doc_id")
    others = [F.col("row")[f.name] for f in docs.schema if f.name not in ("doc_id", "text") and isinstance(f.dataType, T.AtomicType)]
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("row.text"), *others))
    return left.withColumn("first", first).where("first = 1").select("row.*").unionByName(unknown)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = secretscan.masked(docs.select(F.struct(*docs.columns).alias("row"), "text"), changed="changed")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [("language", language), ("quality", quality_classifier), ("near_copies", near_copies), ("secrets", secrets), ("packing", pack)]

#: SQL can't express the classifiers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
