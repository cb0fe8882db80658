"""Four stages from raw documents to packed training sequences."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlens.llm.packing import pack_layers
from cutlens.llm.quality import judge_layers
from cutlens.llm.similarity import keep_one_of_similar
from cutlens.llm.windows import remove_repeated_windows
from cutlens.session import shared_folder


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; the source is the site, the language the path."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    judged = judge_layers(docs, labels, layer_id="doc_id", project_id="source", slot_id="lang")
    return judged.filter(~F.col("rejected")).select(*docs.columns)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard likeness of 0.8 or more: its smallest id."""
    return keep_one_of_similar(docs, layer_id="doc_id", shingle=5, threshold=0.8)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that occur more than once; every document stays,
    untouched texts verbatim, and ``n_chars`` follows the text."""
    kept = remove_repeated_windows(docs, layer_id="doc_id", window=50, clean_as_is=True)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a sequence of 2048 tokens."""
    return pack_layers(docs, public_tokenizers.path("byte_bpe_50k.json"), layer_id="doc_id").withColumnRenamed("layer_id", "doc_id")


STAGES = [
    ("quality_classifier", drop_rejected),
    ("ngram_jaccard_join", drop_similar),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: No SQL: the classifier is fitted, and token ids need the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet in the shared folder and the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
