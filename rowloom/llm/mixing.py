"""Mixing sources to target weights by Poisson replication.

A source that holds n of N rows and is to make up the share w of R rows has the mean repetition rate
R * w / n. A uniform number from a hash of seed and identifier, put through the inverse of the Poisson
distribution with that mean, gives each document its count; documents are exploded by their counts
and dealt out by the range of a second hash, which is the global shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import salted_lookup
from rowloom.sources.tables import table

#: Up to so many sources the rates are sent along with the tasks; beyond, they are looked up by a shuffled join.
SMALL = 4096


def uniform(*parts: Column | str) -> Column:
    """A double in [0, 1) from 52 bits of a hash of the parts, each a column or a fixed string."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def distribution(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... until what is left is below any uniform number."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), first, add, lambda acc: acc["all"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, rows: float | None, source: str) -> DataFrame:
    """(source, mix_rate, mix_cdf): a row for each source of docs. Sources without a weight get none."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        pairs = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.create_map().cast("map<string,double>")
        weighed = sizes.withColumn("w", F.coalesce(F.try_element_at(pairs, "source"), F.lit(0.0)).cast("double"))
    totals = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    share = F.col("w") / F.col("all_w") / F.col("n") * (F.lit(float(rows)) if rows is not None else F.col("all_n"))
    rate = F.when(F.col("all_w") > 0, share).otherwise(F.lit(0.0))
    # totals is one row
    return weighed.join(F.broadcast(totals), F.lit(True)).select("source", rate.alias("mix_rate")).where("mix_rate > 0").withColumn("mix_cdf", distribution(F.col("mix_rate")))


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    temperature: float = 0.5,
    rows: float | None = None,
    seed: int = 17,
    source: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """The columns of docs, mix_copy (1, 2, ...) and mix_key, sorted by mix_key over all partitions.

    weights: the target share of each source (scaled to a sum of 1; a source left out goes), or None for
    shares as the source sizes to the power temperature. rows: the expected number of rows, by default
    that of docs. Rows with one identifier and source get one count; a null identifier or source is
    a value of its own; an empty table gives an empty result; columns mix_copy and mix_key of docs are
    replaced.
    """
    kept = docs.drop("mix_copy", "mix_key")
    by_source = rates(kept, weights, temperature, rows, source).withColumn("source", F.struct(F.col("source").alias("s")))
    named = kept.withColumn("_mix_source", F.struct(F.col(source).alias("s")))  # a struct equals itself with a null inside
    cdf = by_source.select(F.col("source").alias("_mix_source"), F.col("mix_cdf").alias("_mix_cdf"))
    if by_source.limit(SMALL + 1).count() <= SMALL:
        found = named.join(F.broadcast(cdf), "_mix_source")
    else:
        found = salted_lookup(named, cdf, "_mix_source").where("_mix_cdf IS NOT NULL")
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    u = uniform(str(seed), name)
    count = F.aggregate("_mix_cdf", F.lit(0), lambda n, c: n + (c <= u).cast("int"))
    copies = found.withColumn("_mix_n", count).where("_mix_n > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
    keyed = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), name, F.col("mix_copy").cast("string"))))
    return keyed.select(*kept.columns, "mix_copy", "mix_key").repartitionByRange("mix_key").sortWithinPartitions("mix_key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixing_sql(relation: str, temperature: float = 0.5, seed: int = 17) -> str:
    """DuckDB: mix() of a relation with doc_id and source, by size to the power temperature."""
    return f"""
WITH sizes AS (SELECT source, count(*) AS n FROM {relation} GROUP BY source),
rate AS (SELECT source, power(n, {temperature}) / sum(power(n, {temperature})) OVER () / n * sum(n) OVER () AS r FROM sizes),
term AS (SELECT source, k, exp(-r + k * ln(r) - lgamma(k + 1)) AS p FROM rate, LATERAL (SELECT unnest(range(0, ceil(r + 12 * sqrt(r) + 20)::BIGINT + 1)) AS k)),
cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM term) GROUP BY source),
counted AS (SELECT d.*, len(list_filter(cs, lambda c: c <= ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0)) AS m
            FROM {relation} d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT * EXCLUDE (m), md5('{seed}-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || mix_copy::VARCHAR) AS mix_key
FROM (SELECT *, unnest(range(1, m + 1))::INT AS mix_copy FROM counted)
"""


OP1_SQL = mixing_sql("documents")
