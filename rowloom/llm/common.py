"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.durable import checkpoint_folder, cut, partitions, written
from rowloom.operators.graph import connected_components

__all__ = ["CHUNK_BYTES", "LOWER", "UPPER", "ascii_lower", "checkpoint_folder", "connected_components", "cut", "partitions", "salted_lookup", "written"]

#: Longest passage of text, in bytes, that a kernel works on at once (a longer document is a passage of its own).
CHUNK_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """text with only A-Z lower-cased.

    lower() does the same, much faster, unless a letter outside A-Z has a lower-case form;
    the classes below hold every such letter.
    """
    cased = text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^\x00-\x7F]]")
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).when(cased, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """rows left-joined to lookup, whose key is unique, with hot keys spread over all partitions.

    A key is hot if it has more than one partition's even share of the rows, so there are at
    most as many hot keys as partitions: that bounds what is broadcast. The other keys take
    the plain shuffled join. The salt is a hash of the row, so that a task that runs again deals
    its rows as it did before. rows is read twice: cut it first if it is dear to make.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    large = cut(counts.where(F.col("_n") > 1000).withColumnRenamed(key, "_hot"))
    if large.isEmpty():
        return rows.join(lookup, key, "left")
    total = counts.agg(F.sum("_n")).first()[0]
    hot = F.broadcast(large.where(F.col("_n") > F.lit(max(1000, total // n))).select("_hot"))
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    salt = F.pmod(F.xxhash64(*hashed), F.lit(n)).cast("int")
    spread = rows.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(salt))
    copies = lookup.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(n - 1))))
    )
    return spread.drop("_hot").join(copies.drop("_hot"), [key, "_salt"], "left").drop("_salt")
