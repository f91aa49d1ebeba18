"""Lines, rows, points, pixels, tiles and scores built from the driver tables, in Spark and as DuckDB SQL.

The tables hold no geometry, so each view derives one with plain arithmetic that both engines do alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowloom.sources.tables import table

Tables = tuple[SparkSession, str]


def micros(ts: Column, since: str = "2024-01-01") -> Column:
    """Microseconds from a date's midnight, without any time zone."""
    days = F.unix_date(ts.cast("date")) - F.unix_date(F.lit(since).cast("date"))
    second = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    return days.cast("long") * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000 + F.minute(ts).cast("long") * 60_000_000 + second


def v_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, pos, x, y): a line for each user, a vertex for each event."""
    e = table(spark, sf, "events")
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select(F.col("user_id").alias("line_id"), pos.alias("pos"), (micros(F.col("ts")) / 6e7).alias("x"), F.col("value").alias("y"))


def v_polys(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, pos, x, y): a short line for each order, eight orders a lane."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    pos = (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1).cast("long")
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", pos.alias("pos"))
    x = F.col("pos") * 10.0 + F.col("l_suppkey") % 7
    y = F.col("l_quantity") / 5 + F.floor(F.col("l_orderkey") / 8) * 12.0
    return items.select(F.col("l_orderkey").alias("line_id"), "pos", x.cast("double").alias("x"), y.alias("y"))


def v_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, x0, y0, x1, y1): straight rows in pairs .74 apart, pairs 1.98 apart."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), "p_size")
    k, s = F.col("row_id"), F.col("p_size")
    y0 = F.floor(k / 2) * 1.98 + (k % 2) * 0.74 + (s % 3) * 0.02
    x0 = s * 0.1
    return p.select("row_id", x0.alias("x0"), y0.alias("y0"), (x0 + 20 + k % 5).alias("x1"), (y0 + ((k * 7) % 5 - 2) * 0.05).alias("y1"))


def v_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """(fragment_id, x0, y0, x1, y1): rows cut in three with gaps of 1, 2, 7 or 9."""
    rows = v_rows(spark, sf)
    n = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    f = rows.select("*", n.alias("n"))
    gap = F.when(F.col("row_id") % 4 == 0, 9.0).when(F.col("row_id") % 4 == 1, 2.0).when(F.col("row_id") % 4 == 2, 1.0).otherwise(7.0)
    x0 = F.col("x0") + F.col("n") * (12.0 + gap)
    y = F.col("row_id") * 5.0 + F.col("n") * ((F.col("row_id") % 6) * 0.04)
    return f.select((F.col("row_id") * 3 + F.col("n")).alias("fragment_id"), x0.alias("x0"), y.alias("y0"), (x0 + 12.0).alias("x1"), y.alias("y1"))


def _bent(straight: DataFrame, vertices: int) -> DataFrame:
    """(line_id, pos, x, y): straight rows (line_id, x0, y0, x1, y1) with that many vertices, a little beside their rows."""
    k = F.explode(F.sequence(F.lit(0), F.lit(vertices - 1))).alias("pos")
    p = straight.select("*", k).withColumn("t", F.col("pos") / float(vertices - 1))
    y = F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0")) + ((F.col("line_id") * F.col("pos")) % 3 - 1) * 0.01
    return p.select("line_id", F.col("pos").cast("long").alias("pos"), (F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))).alias("x"), y.alias("y"))


def v_bent(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, pos, x, y): v_rows with four vertices each; every fourth again .05 aside, every eighth .21 aside and shorter."""
    r = v_rows(spark, sf).withColumnRenamed("row_id", "line_id")
    near = r.where("line_id % 4 = 0").select((F.col("line_id") + 1000000).alias("line_id"), "x0", (F.col("y0") + 0.05).alias("y0"), (F.col("x1") - 0.5).alias("x1"), (F.col("y1") + 0.05).alias("y1"))
    far = r.where("line_id % 8 = 0").select((F.col("line_id") + 2000000).alias("line_id"), (F.col("x0") + 1.0).alias("x0"), (F.col("y0") + 0.21).alias("y0"), "x1", (F.col("y1") + 0.21).alias("y1"))
    return _bent(r.unionByName(near).unionByName(far), 4)


def v_parts(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, pos, x, y): v_fragments with five vertices each."""
    return _bent(v_fragments(spark, sf).withColumnRenamed("fragment_id", "line_id"), 5)


def v_points(spark: SparkSession, sf: str) -> DataFrame:
    """(id, x, y, grp): the first two components of the embeddings."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (F.col("label") % 2).alias("grp"))


def v_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """(row, col, p): a sparse raster of 50 rows, a column for each part, the largest discount of each cell times ten."""
    items = table(spark, sf, "lineitem")
    cell = items.select((F.col("l_quantity").cast("int") - 1).alias("row"), F.col("l_partkey").cast("int").alias("col"), F.col("l_discount"))
    return cell.groupBy("row", "col").agg((F.max("l_discount") * 10).alias("p"))


def v_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(p, y): a probability in hundredths and a target for each line item."""
    hundredths = F.round(F.col("l_discount") * 1000).cast("long")
    return table(spark, sf, "lineitem").select(hundredths.alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def v_pred(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("toxic").cast("int").alias("pred"), F.col("quality").cast("int").alias("target"))


def v_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """(tile_id, row_off, col_off, size, group_id): tiles of 20 over the pixels, step 10, a column for each part."""
    columns = table(spark, sf, "part").agg((F.max("p_partkey") + 1).cast("int").alias("n_cols"))
    grid = columns.select("n_cols", F.explode(F.sequence(F.lit(0), F.lit(30), F.lit(10))).alias("row_off"))
    grid = grid.select("row_off", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 20, F.lit(10))).alias("col_off"))
    group = F.floor(F.col("row_off") / 20) * 100000 + F.floor(F.col("col_off") / 20)
    return grid.select((F.col("row_off").cast("long") * 100000 + F.col("col_off")).alias("tile_id"), "row_off", "col_off", F.lit(20).alias("size"), group.alias("group_id"))


def v_inputs(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("input_id"), "c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") * 100).cast("long").alias("n_lines"))


def v_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """(line_id, grp, ids): lineage written as a JSON array, as comma-joined ids, or as one id."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    a, b = F.concat(F.lit("raw_"), (F.col("conv_id") % 50).cast("string")), F.concat(F.lit("raw_"), (F.col("turns") + 3).cast("string"))
    ids = (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('["'), b, F.lit('","'), a, F.lit('","'), b, F.lit('"]')))
        .when(F.col("conv_id") % 3 == 1, F.concat(b, F.lit(" , "), a))
        .otherwise(a)
    )
    return c.select(F.col("conv_id").alias("line_id"), (F.col("conv_id") % 20).alias("grp"), ids.alias("ids"))


#: The same views for DuckDB, as common table expressions.
SQL = {
    "v_lines": """SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 6e7 AS x, value AS y FROM events""",
    "v_polys": """SELECT l_orderkey AS line_id, pos, pos * 10.0::DOUBLE + l_suppkey % 7 AS x, l_quantity / 5 + floor(l_orderkey / 8) * 12.0::DOUBLE AS y
        FROM (SELECT l_orderkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
        l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS pos FROM lineitem)""",
    "v_rows": """SELECT row_id, x0, y0, x0 + 20 + row_id % 5 AS x1, y0 + ((row_id * 7) % 5 - 2) * 0.05::DOUBLE AS y1 FROM (
        SELECT p_partkey AS row_id, p_size * 0.1::DOUBLE AS x0,
        floor(p_partkey / 2) * 1.98::DOUBLE + (p_partkey % 2) * 0.74::DOUBLE + (p_size % 3) * 0.02::DOUBLE AS y0 FROM part)""",
    "v_fragments": """SELECT row_id * 3 + n AS fragment_id, x0 + n * (12.0::DOUBLE + gap) AS x0, row_id * 5.0::DOUBLE + n * ((row_id % 6) * 0.04::DOUBLE) AS y0,
        x0 + n * (12.0::DOUBLE + gap) + 12.0::DOUBLE AS x1, row_id * 5.0::DOUBLE + n * ((row_id % 6) * 0.04::DOUBLE) AS y1
        FROM (SELECT *, unnest([0, 1, 2]) AS n, (CASE row_id % 4 WHEN 0 THEN 9.0 WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 7.0 END)::DOUBLE AS gap FROM v_rows)""",
    "v_bent": """SELECT line_id, pos, x0 + pos / 3.0::DOUBLE * (x1 - x0) AS x, y0 + pos / 3.0::DOUBLE * (y1 - y0) + ((line_id * pos) % 3 - 1) * 0.01::DOUBLE AS y FROM (
        SELECT row_id AS line_id, x0, y0, x1, y1 FROM v_rows UNION ALL SELECT row_id + 1000000, x0, y0 + 0.05::DOUBLE, x1 - 0.5::DOUBLE, y1 + 0.05::DOUBLE FROM v_rows WHERE row_id % 4 = 0
        UNION ALL SELECT row_id + 2000000, x0 + 1.0::DOUBLE, y0 + 0.21::DOUBLE, x1, y1 + 0.21::DOUBLE FROM v_rows WHERE row_id % 8 = 0), (SELECT unnest(range(0, 4)) AS pos)""",
    "v_parts": """SELECT fragment_id AS line_id, pos, x0 + pos / 4.0::DOUBLE * (x1 - x0) AS x, y0 + pos / 4.0::DOUBLE * (y1 - y0) + ((fragment_id * pos) % 3 - 1) * 0.01::DOUBLE AS y
        FROM v_fragments, (SELECT unnest(range(0, 5)) AS pos)""",
    "v_points": "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label % 2 AS grp FROM embeddings",
    "v_pixels": """SELECT l_quantity::INT - 1 AS row, l_partkey::INT AS col, max(l_discount) * 10 AS p FROM lineitem GROUP BY 1, 2""",
    "v_scores": "SELECT round(l_discount * 1000)::BIGINT AS p, (l_returnflag = 'R')::INT AS y FROM lineitem",
    "v_pred": "SELECT toxic::INT AS pred, quality::INT AS target FROM labels",
    "v_tiles": """SELECT r::BIGINT * 100000 + c AS tile_id, r::INT AS row_off, c::INT AS col_off, 20 AS size, r // 20 * 100000 + c // 20 AS group_id
        FROM (SELECT unnest(range(0, 31, 10)) AS r), (SELECT unnest(range(0, max(p_partkey) + 1 - 20 + 1, 10)) AS c FROM part)""",
    "v_inputs": "SELECT c_custkey AS input_id, c_nationkey, c_mktsegment, round(c_acctbal * 100)::BIGINT AS n_lines FROM customer",
    "v_lineage": """SELECT conv_id AS line_id, conv_id % 20 AS grp, CASE conv_id % 3 WHEN 0 THEN '["' || b || '","' || a || '","' || b || '"]' WHEN 1 THEN b || ' , ' || a ELSE a END AS ids
        FROM (SELECT conv_id, 'raw_' || (conv_id % 50)::VARCHAR AS a, 'raw_' || (max(turn) + 3)::VARCHAR AS b FROM conversations GROUP BY conv_id)""",
}
_NEEDS = {"v_fragments": ["v_rows"], "v_bent": ["v_rows"], "v_parts": ["v_rows", "v_fragments"]}


def with_views(query: str, *names: str, recursive: bool = False) -> str:
    """query, preceded by the named views as common table expressions."""
    every: list[str] = []
    for name in names:
        every += [n for n in (*_NEEDS.get(name, ()), name) if n not in every]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in every)
    query = query.strip()
    if query.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {query[15:]}"
    if query.upper().startswith("WITH "):
        return f"WITH {head}, {query[5:]}"
    return f"WITH {head} {query}"
