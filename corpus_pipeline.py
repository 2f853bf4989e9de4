"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks and tokens, one stage after the other.

Each stage takes (spark, docs, sf_dir), with docs as the stage before has left them, and returns a DataFrame that is written
as Parquet and reread. All stages but the last return the columns of documents; only the last adds tokens.

1. language_id: the network is trained on the labelled rows of the documents given; `und` rows go, and rows whose likeliest
   language is hardly likelier than chance: its probability must reach 1/k + LEAST (1 - 1/k) with k learned languages. Clean
   documents of the learned languages stay.
2. near_duplicates: of each group of linked documents the one with the smallest id stays; documents without words are
   linked with nothing and stay.
3. repeated_passages: words in windows of 50 words that a document with a smaller id has go; a text that loses nothing is
   left as it is, else its words left are joined by blanks. Documents stay, even empty ones.
4. benchmark_leaks: documents with a window of ten benchmark words go.
5. tokens: ids of the byte-level BPE, and the text as their decoding.

Edges, for all stages: null texts have no language and go with the first stage; empty ones as well; texts of any length are
taken whole; rows that repeat an id and a text keep a row each where a document stays; of equally good documents of a group the
smallest id stays; columns beside COLUMNS are dropped, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm import language_id as lid
from panelloom.llm.bpe import bpe_round_trip
from panelloom.llm.decontaminate import decontaminate
from panelloom.llm.frames import key_bitmap, maybe_in, stored, without
from panelloom.llm.jaccard_join import jaccard_components
from panelloom.llm.substring_dedup import substring_dedup

#: How far above chance a document's language must be, as a share of the way to certainty.
LEAST = 0.07
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = lid.train(docs.select("doc_id", "text", "lang"))
    told = lid.identify(docs.select(*COLUMNS), net)
    chance = 1 / len(net.classes) if net is not None else 1.0
    return told.filter((F.col("lang_pred") != lid.UNKNOWN) & (F.col("score") >= chance + LEAST * (1 - chance))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_components(docs)
    gone = stored(found.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return without(docs.select(*COLUMNS), gone, ["doc_id"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup(docs, min_words=50)
    changed = stored(cut.filter("n_removed > 0").select("doc_id", "tag", "kept").distinct(), "changed")
    split = maybe_in(docs.select(*COLUMNS, F.hash("text").alias("tag")), F.col("doc_id"), key_bitmap(changed, F.col("doc_id")))
    same = split.filter("NOT _maybe").select(*COLUMNS)
    text = F.coalesce("kept", "text")
    other = split.filter("_maybe").join(changed, ["doc_id", "tag"], "left").select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long")).alias("n_chars"))
    return same.unionByName(other)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_round_trip(docs.select(*COLUMNS), vocab, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.decode("decoded", "UTF-8").alias("text"), "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: The trained network and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
