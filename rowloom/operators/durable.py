"""Cutting lineage through the shared checkpoint folder, and numbering rows without one big partition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary one; a cluster, whose executors could not
    share that, raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="rowloom-checkpoint-"))
    return context.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: a lost executor loses none of it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared checkpoint folder and read back: smaller than a checkpoint, and prunable."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns that later projections read and do not repeat.

    Catalyst inlines a projection into the next; a long expression that is read many times there
    would outgrow a compiled method. Going through a one-element explode keeps it in its own step.
    """
    for c in columns:
        df = df.withColumn(c, F.explode(F.array(c)))
    return df


def dealt(df: DataFrame) -> DataFrame:
    """df, which a join deals out by key and never broadcasts.

    Spark sizes a table by the files that it comes from. What an explode makes of them may be many times
    larger, and would still be sent to the driver and to every executor.
    """
    return df.hint("merge")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a column that counts its rows from 0 in an order, which must be total.

    Rows are dealt out by ranges of the order; a partition's first number is the size of those before
    it, and there is one such size for each partition.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(starts, "_part").withColumn(name, (F.col("_start") + here - 1).cast("long")).drop("_part", "_start")
