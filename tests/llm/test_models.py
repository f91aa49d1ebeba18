"""Classifiers: held-out accuracy on small tables, and their parts against plain forms."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import quality, toxicity

#: The smaller tables hold under fifteen toxic held-out documents in four languages, too few to measure by.
SF = "/root/testdata/sf0.1"


def auc(score, y):
    rank = score.argsort().argsort() + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("query,label,of,out", [(quality.op7_quality, "quality", 3, 1), (toxicity.op10_toxicity, "toxic", 4, 2)])
def test_held_out(spark, query, label, of, out):
    got = query(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got["score"].between(0, 1).all()
    import zlib

    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % of == out for i in got["doc_id"]]).all()
    both = got[got["held_out"]].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert auc(both["score"].to_numpy(), both[label].to_numpy()) > 0.9


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, ("good plain words here " * 5 if i % 2 else "*** ### !!! ") + str(i)) for i in range(120)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = labels.withColumn("quality", F.when(quality.training(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (quality.score(docs, quality.learn(docs, x, "quality", quality.training)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_one_label_null_texts_and_empty_tables(spark, module, label):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "a b", 0.5), (3, "a b", 0.5), (None, "x", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 1), (3, 1), (None, 0)], f"doc_id long, {label} int")
    for known in (labels, labels.limit(0)):
        model = module.learn(docs, known, label, lambda _: F.lit(True))
        got = module.score(docs, model).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert module.score(docs.limit(0), model).count() == 0


def test_isotonic_is_monotone_and_pools():
    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and np.interp([1, 2, 3, 4], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_trees_learn_an_exclusive_or():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    forest = toxicity.grow(x, y)
    assert ((forest.margins(x) > 0) == (y == 1)).mean() > 0.95
