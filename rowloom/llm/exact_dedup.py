"""Exact deduplication by a content sort, in DataFrame operations only.

Splitters sampled from (first characters, digest, salt) deal the normalised texts out by range; an
external sort puts equal texts next to each other, and each text is compared whole with the one before
it: a run ends where they differ. Whole texts move once.

A text with more copies than a partition's even share of the rows, which a count of digests finds, is
hot: its salt, else 0, cuts it into pieces of about that share. The heads of its pieces, at most two for
each partition over all hot texts, are then sorted and compared whole in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.llm.common import ascii_lower, cut, partitions
from rowloom.sources.tables import table

#: Characters of a text that go into a splitter: splitters stay small however long the texts.
SPLITTER_CHARS = 32
#: A text with fewer copies than this is never hot.
LEAST_HOT = 128


def _runs(*keys: str) -> Column:
    """Numbers, among rows of equal keys, the runs of equal texts: each is compared whole with its neighbour."""
    order = Window.partitionBy(*keys).orderBy("_norm")
    same = F.lag("_norm").over(order) == F.col("_norm")
    return F.sum(F.when(same, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))


def hot_texts(rows: DataFrame, least: int = LEAST_HOT) -> DataFrame:
    """(_hot, _pieces): digests with more rows (_sha) than a partition's even share, so at most as many as partitions."""
    counts = rows.groupBy("_sha").agg(F.count(F.lit(1)).alias("_copies"))
    large = cut(counts.where(F.col("_copies") > least))
    share = max(least, rows.count() // partitions(rows.sparkSession))  # the count makes no digest
    return large.where(F.col("_copies") > share).select(F.col("_sha").alias("_hot"), F.ceil(F.col("_copies") / share).cast("int").alias("_pieces"))


def merge_pieces(heads: DataFrame, keep: str) -> DataFrame:
    """(_sha, _salt, _run, keep_id, group_size, _wins) of the heads (_sha, _salt, _run, _norm, _best, _n) of pieces.

    Pieces are one text where their heads' whole texts are equal; a common digest joins nothing.
    """
    best = F.max if keep == "max" else F.min
    first = F.desc_nulls_last if keep == "max" else F.asc_nulls_last
    named = heads.withColumn("_text", _runs("_sha"))
    group = Window.partitionBy("_sha", "_text")
    winner = F.row_number().over(group.orderBy(first("_best"), "_salt"))
    return named.select("_sha", "_salt", "_run", best("_best").over(group).alias("keep_id"), F.sum("_n").over(group).alias("group_size"), (winner == 1).alias("_wins"))


def content_runs(docs: DataFrame, keep: str = "min", text: str = "text", id_col: str = "doc_id", least_hot: int = LEAST_HOT) -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max", the identifier that stays of equal texts (equal after lower-casing A-Z).
    A null text counts as empty; a null identifier never wins over another; of repeated rows with
    the winning identifier exactly one is kept. An empty table gives an empty result. Other columns
    of docs, whatever their names, are not read. least_hot moves no result, only where salts begin.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep}")
    first = F.desc_nulls_last if keep == "max" else F.asc_nulls_last
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("_norm")).withColumn("_sha", F.sha2("_norm", 256))
    hot = hot_texts(rows.select("_sha"), least_hot)
    # a null _pieces: the text is not hot and has one piece, of salt 0
    dealt = rows.join(F.broadcast(hot), F.col("_sha") == F.col("_hot"), "left").withColumns(
        {
            "_head": F.substring("_norm", 1, SPLITTER_CHARS),
            "_salt": F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_pieces")), F.lit(0)).cast("int"),
        }
    )
    spread = dealt.drop("_hot").repartitionByRange("_head", "_sha", "_salt").withColumn("_run", _runs("_head", "_sha", "_salt"))
    piece = Window.partitionBy("_head", "_sha", "_salt", "_run")
    rank = F.row_number().over(piece.orderBy(first("_id")))
    whole_head = F.when(F.col("_pieces").isNotNull() & (rank == 1), F.col("_norm"))
    ranked = spread.select("_id", "_sha", "_salt", "_run", "_pieces", rank.alias("_rank"), F.first("_id").over(piece.orderBy(first("_id"))).alias("_best"), F.count(F.lit(1)).over(piece).alias("_n"), whole_head.alias("_norm"))
    ranked = cut(ranked)
    heads = ranked.where("_pieces IS NOT NULL AND _rank = 1").select("_sha", "_salt", "_run", "_norm", "_best", "_n")
    merged = F.broadcast(merge_pieces(heads, keep))  # at most two rows for each partition
    cold = ranked.where("_pieces IS NULL").select("_id", F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_rank") == 1).alias("kept"), "_sha")
    salted = ranked.where("_pieces IS NOT NULL").join(merged, ["_sha", "_salt", "_run"]).select("_id", "keep_id", "group_size", (F.col("_wins") & (F.col("_rank") == 1)).alias("kept"), "_sha")
    return cold.unionByName(salted).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.col("_sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_runs(table(spark, sf_dir, "documents"), keep="max")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
