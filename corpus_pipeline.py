"""A corpus pipeline in stages, each applied to all that its predecessor kept.

Rows with null or empty texts are documents like any other. Rows that repeat an id: of equal texts one stays; of
different texts the near-duplicate stage keeps all if it keeps one. Empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.bpe import tokenise
from quillstone.llm.common import few, save, table
from quillstone.llm.exact_dedup import keep_first
from quillstone.llm.mixing import mix_sources
from quillstone.llm.similar import similar_documents
from quillstone.llm.toxicity import learn_toxicity, toxicity_scores

#: A learned model and a tokenizer have no SQL equivalent.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay. The model is learned from the labelled rows of the folder."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = learn_toxicity(table(spark, sf_dir, "documents"), labels)
    return toxicity_scores(docs, model).where(F.col("toxicity") < 0.5).select(*docs.columns)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return keep_first(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a Jaccard similarity of 0.8 of five-word shingles the smallest id stays."""
    groups = similar_documents(docs.select("doc_id", "text"), least=0.8, shingle=5)
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = save(groups.groupBy("doc_id").agg(stays.alias("stays")).where(~F.col("stays")).select("doc_id"), "near")
    return docs.join(few(gone), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gets the same expected number of rows, as many in all as before, in a global shuffle."""
    return mix_sources(docs, weights=None, epochs=1.0, seed=42).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to."""
    found = tokenise(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "source", F.size("ids").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("bpe", encode_and_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, name)
    return docs
