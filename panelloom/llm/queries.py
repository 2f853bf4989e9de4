"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from panelloom.llm.ann import nearest_neighbours
from panelloom.llm.bpe import bpe_round_trip
from panelloom.llm import collocations
from panelloom.llm.decontaminate import contamination
from panelloom.llm.html_text import extract_text
from panelloom.llm.jaccard_join import jaccard_components
from panelloom.llm.language_id import fold, identify, train
from panelloom.llm import license_scan
from panelloom.llm.media import read_media, store_media
from panelloom.llm import ranked_search
from panelloom.llm.substring_dedup import substring_dedup
from panelloom.llm import toxicity
from panelloom.llm.warc import capture_index

def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_words=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out)
    out = toxicity.tag(docs, toxicity.train(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_spans")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = read_media(store_media(docs).drop("text"))
    pairs = F.concat_ws(",", F.col("fingerprint").cast("array<string>"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "n_frames", F.size("fingerprint"), F.sha1(pairs)).alias("feature"),
        "fingerprint",
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=5, percent=80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), "contaminated"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp", "run", "offset", "length")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str, vocab: str | None = None) -> DataFrame:
    vocab = vocab or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = bpe_round_trip(docs, vocab, public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), least=10, cover_percent=50, top=2000)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_media_columns": op4_media_columns,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_language_id": op8_language_id,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_license_scan": op10_license_scan,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}

ORACLE = {"op10_license_scan": license_scan.oracle(), "op12_ranked_search": ranked_search.oracle(), "op13_collocations": collocations.oracle()}
