"""A corpus from documents: rejected, copied and near-copied documents go, sources are mixed, texts are tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each as Parquet into the shared
checkpoint folder and reads it back, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import bpe, exact_dedup, minhash, mixing, quality
from rowloom.llm.common import ascii_lower, checkpoint_folder
from rowloom.operators.durable import removed
from rowloom.sources.tables import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking accepts. It is fitted on the labelled rows of docs, all folds.

    A null text is judged as an empty one; rows with a null doc_id are judged but have no label; repeated
    rows are judged alike and all stay or go; with one label only, or none, every row stays; an empty table
    gives an empty one.
    """
    ranking = quality.learn(docs, table(spark, sf_dir, "labels"), "quality", lambda _: F.lit(True))
    return quality.score(docs.select(*COLUMNS, F.col("text").alias("_scored")), ranking, "_scored").where("score >= 0.5").select(*COLUMNS)


def _name(digest: Column) -> Column:
    """What a row is named by: a struct, which equals itself with a null inside; null identifiers come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("digest"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after lower-casing A-Z; null is empty) one row, that with the smallest doc_id.

    A null doc_id loses to any other; a text that has no other stays, with it. Rows that share a doc_id
    but not their text are judged each by its own; of repeated rows one stays. An empty table gives an empty one.
    """
    kept = exact_dedup.content_runs(docs, keep="min").where("kept").select(_name(F.col("text_sha256")).alias("_name"))
    named = docs.withColumn("_name", _name(F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256)))
    return named.join(kept, "_name", "left_semi").dropDuplicates(["_name"]).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that with the smallest doc_id, then text digest.

    A null doc_id loses to any other, and is linked like any other; texts without words are linked with
    nothing and stay. Links are from a similarity of 0.85 on, as in op4: copies between 0.8 and 0.85 stay.
    Rows that share a doc_id but not their text are judged each by its own; repeated rows, of one doc_id
    and text, are one. An empty table gives an empty one.
    """
    named = docs.withColumn("_name", _name(F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))))
    kept = minhash.near_duplicates(named, id_col="_name").where("kept").select("_name")
    return named.join(kept, "_name", "left_semi").dropDuplicates(["_name"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows as came, on average, of sources in shares by their sizes to the power 0.5.

    A null source is a source of its own; rows of one doc_id and source get one count, and with it repeated
    rows and all rows of a source with a null doc_id; an empty table gives an empty one.
    """
    return mixing.mix(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and of decoded bytes; a null text has no ids, repeated rows are each encoded."""
    import public_tokenizers

    return bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", accept_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: The classifier and signatures have no SQL form: run()'s rows are tested against a plain version of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            removed(spark, f"{folder}/{before}")
        before = name
    return docs
