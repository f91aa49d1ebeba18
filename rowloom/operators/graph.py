"""Graph operators as bounded loops of joins: components, greedy matching, greedy independent sets.

Each loop ends when nothing is left to decide; every round goes through the checkpoint folder, and no
edge or label is brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.durable import cut, dealt


def connected_components(links: DataFrame) -> DataFrame:
    """(v, root) for each vertex of links(a, b), root the smallest vertex it reaches.

    Large-star and small-star steps in turn: each links every vertex to the least neighbour known,
    until nothing changes, which takes a number of rounds that grows as a logarithm. A step needs a
    minimum for each vertex and a join, so a vertex with very many links is never gathered: the
    minimum combines before the shuffle and a skewed join is split.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a vertex move to its least neighbour
        large = both.where("v > u").join(dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a vertex, and itself, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(dealt(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == last:
            break
        last = now
    reached = edges.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return reached.unionByName(edges.select("v", F.col("v").alias("root")).distinct())


def greedy_matching(edges: DataFrame, *order: Column) -> DataFrame:
    """The edges (i, j, ...) that a greedy pass in a total order accepts, each vertex used once.

    An edge that is the first of all edges at both its ends is accepted by the pass too; taking all
    such edges, and with them the edges at their ends, round after round gives the same set.
    """
    rank = F.struct(*order)
    left = cut(edges.withColumn("_rank", rank))
    accepted = None
    while True:
        ends = left.select(F.col("i").alias("v"), "_rank").unionByName(left.select(F.col("j").alias("v"), "_rank"))
        best = ends.groupBy("v").agg(F.min("_rank").alias("_best"))
        now = (
            left.join(dealt(best.select(F.col("v").alias("i"), F.col("_best").alias("_a"))), "i")
            .join(dealt(best.select(F.col("v").alias("j"), F.col("_best").alias("_b"))), "j")
            .where("_rank = _a AND _rank = _b")
            .drop("_a", "_b")
        )
        now = cut(now)
        if now.isEmpty():
            break
        accepted = now if accepted is None else accepted.unionByName(now)
        used = now.select(F.explode(F.array("i", "j")).alias("v"))
        left = cut(left.join(dealt(used.withColumnRenamed("v", "i")), "i", "left_anti").join(dealt(used.withColumnRenamed("v", "j")), "j", "left_anti"))
    return edges.limit(0) if accepted is None else accepted.drop("_rank").select(*edges.columns)


def greedy_independent_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept) for nodes(id, rank): in order of rank, a node stays if no neighbour before it stays.

    edges(a, b) are undirected. In each round nodes without an undecided earlier neighbour stay and
    their neighbours go; ranks must differ.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ranks = nodes.select("id", "rank")
    arcs = both.join(dealt(ranks.select(F.col("id").alias("a"), F.col("rank").alias("ra"))), "a").join(dealt(ranks.select(F.col("id").alias("b"), F.col("rank").alias("rb"))), "b")
    earlier = cut(arcs.where("rb < ra").select("a", "b"))  # b goes before a
    touched = earlier.select(F.col("a").alias("id")).distinct()
    done = cut(ranks.select("id").join(dealt(touched), "id", "left_anti").withColumn("kept", F.lit(True)))
    open_ = cut(touched)
    while not open_.isEmpty():
        known = earlier.join(dealt(open_.withColumnRenamed("id", "a")), "a").join(dealt(done.withColumnRenamed("id", "b")), "b", "left")
        state = known.groupBy("a").agg(F.max(F.coalesce("kept", F.lit(False))).alias("goes"), F.min(F.col("kept").isNotNull()).alias("settled"))
        decided = cut(state.where("goes OR settled").select(F.col("a").alias("id"), (~F.col("goes")).alias("kept")))
        open_ = cut(open_.join(dealt(decided), "id", "left_anti"))
        done = cut(done.unionByName(decided))
    return done
