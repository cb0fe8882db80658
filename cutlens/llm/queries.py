"""The driver's queries over the given tables: thin steps around the operators."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlens.llm.alignment import align_layers
from cutlens.llm.archive import read_archive, write_archive
from cutlens.llm.chat import rotate_perspectives
from cutlens.llm.fingerprints import edited_likeness
from cutlens.llm.packing import pack_layers
from cutlens.llm.passages import remove_repeated_bytes
from cutlens.llm.pieces import decode_layers, encode_layers
from cutlens.llm.quality import judge_layers
from cutlens.llm.ranking import rank_layers
from cutlens.llm.similarity import link_similar
from cutlens.llm.topk import top_prints
from cutlens.llm.urlrules import judge_urls
from cutlens.llm.windows import remove_repeated_windows
from cutlens.session import shared_folder

JOBS: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(job):
        JOBS[name] = job
        if sql:
            SQL[name] = sql
        return job

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def layers_of(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as text layers: the source is the project, the language the slot."""
    return table(spark, folder, "documents").select(F.col("doc_id").alias("layer_id"), F.col("source").alias("project_id"), F.col("lang").alias("slot_id"), "text")


def reviews_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").select(F.col("doc_id").alias("layer_id"), (1 - F.col("quality")).alias("low_quality"), "toxic")


@query("op2_pack")
def pack(spark: SparkSession, folder: str) -> DataFrame:
    layers = layers_of(spark, folder)
    packed = pack_layers(layers, public_tokenizers.path("byte_bpe_50k.json"), budget=2048, end_id=0)
    return packed.withColumnRenamed("layer_id", "doc_id")


@query("op4_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_layers(layers_of(spark, folder), reviews_of(spark, folder))
    return judged.select(F.col("layer_id").alias("doc_id"), F.col("project_id").alias("source"), F.col("slot_id").alias("lang"), "low_quality", "toxic", "rejected")


@query("op6_windows", """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM r) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, n: NOT coalesce(list_contains(js, n), false)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""")
def windows(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_windows(layers_of(spark, folder), window=35)
    return kept.select(F.col("layer_id").alias("doc_id"), "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_similarity")
def similarity(spark: SparkSession, folder: str) -> DataFrame:
    linked = link_similar(layers_of(spark, folder), shingle=3, threshold=0.9)
    return linked.select(F.col("layer_id").alias("doc_id"), "n_shingles", "component_id")


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


@query("op1_fingerprints")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    compared = edited_likeness(layers_of(spark, folder))
    return compared.select(
        F.col("layer_id").alias("doc_id"), "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query("op3_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 20""")
def topk(spark: SparkSession, folder: str) -> DataFrame:
    features = table(spark, folder, "embeddings").select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("feature_print"))
    found = top_prints(features, features.filter("asset_id % 20 = 0"), k=20)
    return found.withColumnRenamed("asset_id", "vec_id")


@query("op5_chat")
def chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("dialogue_id"), "turn", F.col("role").alias("speaker"), "text")
    return rotate_perspectives(turns).withColumnRenamed("dialogue_id", "conv_id")


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op7_urls")
def urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("url_id"), "url")
    return judge_urls(pages, URL_RULES).withColumnRenamed("url_id", "page_id")


@query("op9_pieces")
def pieces(spark: SparkSession, folder: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_layers(layers_of(spark, folder).select("layer_id", "text"), model, seed=2)
    decoded = decode_layers(encoded, model)
    return decoded.select(
        F.col("layer_id").alias("doc_id"), F.size("piece_ids").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query("op10_warc")
def warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("project_id"), F.col("url").alias("uri"), F.col("html").alias("document"))
    index = write_archive(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return read_archive(index).select(F.col("project_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_passages")
def passages(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_bytes(layers_of(spark, folder), window=400)
    return kept.select(F.col("layer_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_alignment")
def alignment(spark: SparkSession, folder: str) -> DataFrame:
    aligned = align_layers(layers_of(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    return aligned.select(F.col("layer_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op13_ranking", f"""
WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY doc_id),
s AS (SELECT count(*) AS layers, CAST(sum(n) AS BIGINT) AS terms FROM d),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * layers + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), s),
p AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * layers) // terms))))) AS BIGINT) AS score
      FROM w JOIN c USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM p WHERE score > 0) WHERE rank <= 10""")
def ranking(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("search_id"), "text")
    found = rank_layers(layers_of(spark, folder), items, k=10)
    return found.withColumnRenamed("search_id", "item_id").withColumnRenamed("layer_id", "doc_id")
