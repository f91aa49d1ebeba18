"""GeoJSON and catalogues of files as tables: regions, reference lines, layers, labels of sampled images."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(feature, properties, kind, coordinates as JSON, crs) of GeoJSON files: collections, or a feature a line."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    whole = F.from_json("value", "struct<type:string,features:array<string>,crs:string>")
    collection = text.withColumn("c", whole).where("c.type = 'FeatureCollection'")
    each = collection.select("file", F.col("c.crs").alias("crs"), F.posexplode("c.features").alias("n", "f"))
    lines = text.withColumn("c", whole).where("c.type IS NULL OR c.type <> 'FeatureCollection'").select("file", F.lit(None).cast("string").alias("crs"), F.posexplode(F.split("value", "\n")).alias("n", "f"))
    every = each.unionByName(lines.where("trim(f) <> ''")).withColumn("p", F.from_json("f", FEATURE))
    number = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    return every.select("file", number.cast("long").alias("feature"), F.col("p.properties").alias("properties"), F.col("p.geometry.type").alias("kind"), F.col("p.geometry.coordinates").alias("coordinates"), "crs")


def _rings(kind: str) -> Column:
    shape = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}[kind]
    return F.from_json("coordinates", shape)


def read_roi(spark: SparkSession, path: str, need_crs: bool = True) -> DataFrame:
    """(region_id, ring, pos, x, y): the rings of all polygons, those of other geometries and of none left out.

    Raises if no polygon is left, or, where one is needed, if the file names no coordinate system. Rings that
    cross themselves count by the even-odd rule wherever they are used, which needs no repair.
    """
    f = features(spark, path).where("kind IN ('Polygon', 'MultiPolygon') AND coordinates IS NOT NULL")
    if need_crs and not f.where("crs IS NULL").isEmpty():
        raise ValueError(f"{path} names no coordinate system")
    one = F.when(F.col("kind") == "Polygon", F.array(_rings("Polygon"))).otherwise(_rings("MultiPolygon"))
    rings = f.select(F.col("feature").alias("region_id"), F.posexplode(one).alias("part", "polygon")).select("region_id", "part", F.posexplode("polygon").alias("r", "ring"))
    number = F.dense_rank().over(Window.partitionBy("region_id").orderBy("part", "r")).cast("int") - 1
    points = rings.where(F.size("ring") >= 3).withColumn("n", number).select("region_id", F.col("n").alias("ring"), F.posexplode("ring").alias("pos", "p"))
    out = points.select("region_id", "ring", "pos", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    if out.isEmpty():
        raise ValueError(f"{path} holds no polygon")
    return out


def read_lines(spark: SparkSession, path: str, id_field: str | None = None) -> DataFrame:
    """(line_id, unique_row_id, pos, x, y): lines and the parts of multi-part lines, each geometry once, numbered in file order.

    unique_row_id: row_i without an id field; else the id, and id_1, id_2, ... for its repeats; null and -1 are generated.
    """
    f = features(spark, path).where("kind IN ('LineString', 'MultiLineString') AND coordinates IS NOT NULL")
    parts = F.when(F.col("kind") == "LineString", F.array(F.from_json("coordinates", "array<array<double>>"))).otherwise(F.from_json("coordinates", "array<array<array<double>>>"))
    name = F.lit(None).cast("string") if id_field is None else F.try_element_at("properties", F.lit(id_field))
    p = f.select("file", "feature", name.alias("name"), F.posexplode(parts).alias("part", "geom")).where(F.size("geom") >= 2)
    once = p.groupBy("geom").agg(F.min_by(F.struct("file", "feature", "part", "name"), F.struct("file", "feature", "part")).alias("s")).select("geom", "s.*")
    order = ["file", "feature", "part"]
    from rowloom.operators.durable import numbered

    rows = numbered(once, "line_id", *[F.col(c) for c in order])
    named = F.when(F.col("name").isNull() | (F.col("name") == "-1"), "generated").otherwise(F.col("name"))
    again = F.row_number().over(Window.partitionBy("_id").orderBy("line_id")) - 1
    unique = F.concat(F.lit("row_"), F.col("line_id").cast("string")) if id_field is None else F.when(F.col("_k") == 0, F.col("_id")).otherwise(F.concat_ws("_", "_id", F.col("_k").cast("string")))
    rows = rows.withColumn("_id", named).withColumn("_k", again).withColumn("unique_row_id", unique)
    return rows.select("line_id", "unique_row_id", F.posexplode("geom").alias("pos", "p")).select("line_id", "unique_row_id", F.col("pos").cast("long").alias("pos"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def resolve_layer(layers: list[str], wanted: str | None) -> str:
    """The layer of a container: the one named so, else the only one whose name holds the wanted text, or the only one there is."""
    if wanted is None:
        if len(layers) == 1:
            return layers[0]
        raise ValueError(f"name one of the layers {layers}")
    found = [x for x in layers if x.rsplit(":", 1)[-1] == wanted] or [x for x in layers if wanted in x]
    if len(found) != 1:
        raise ValueError(f"layer {wanted!r} is {'ambiguous' if found else 'absent'}: {found or layers}")
    return found[0]


#: The layers that hold raw lines, the current name first.
RAW_LAYERS = ("post_inference_lines", "predicted_rows")


def read_first(spark: SparkSession, folder: str, names: tuple[str, ...] = RAW_LAYERS) -> tuple[str, DataFrame]:
    """The first of the named Parquet layers that the folder holds, and its rows; raises if it holds none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(root, name)):
            return name, spark.read.parquet(f"{folder}/{name}")
    raise FileNotFoundError(f"none of the layers {', '.join(names)} in {folder}")


def approved_threshold(config: dict, sidecar: str | None, required: bool = False) -> dict:
    """config with its thresholds set by a calibration report (JSON text), which must be approved; without one unchanged."""
    if sidecar is None:
        if required:
            raise FileNotFoundError("the threshold calibration report is required")
        return config
    found = json.loads(sidecar)
    if found.get("status") != "approved":
        raise ValueError(f"the threshold calibration is not approved: {found.get('failure_reason') or 'low validation Dice'}")
    t = float(found["center_threshold"])
    post = config.get("postprocessing", {}) | {"threshold_mode": "single", "center_threshold": t, "center_threshold_high": t, "center_threshold_low": t}
    return config | {"postprocessing": post}


def output_nodata(bands: Column) -> Column:
    """The nodata value of an array of the bands' values: theirs if all have the same, and it is not 0; else null."""
    same = (F.size(bands) > 0) & F.forall(bands, lambda b: b.isNotNull() & (b == bands[0]))
    return F.when(same & (bands[0] != 0), bands[0])


# --- catalogues of files -------------------------------------------------------------------------

#: What a file's ending says it is.
KINDS = {
    "image": ("tif", "tiff", "png", "jpg", "jpeg"), "vector": ("gpkg", "geojson", "shp"), "array": ("npz", "npy"), "table": ("csv", "parquet"), "config": ("yaml", "yml", "json"),
    "code": ("py",), "model": ("pt", "onnx"), "text": ("md", "txt", "log"),
}


def categorised(files: DataFrame, excluded: dict[str, str]) -> DataFrame:
    """files (path, size) with name, stem, kind and excluded_by: the first reason whose pattern the path matches, or null."""
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    kind = F.lit("other")
    for k, endings in reversed(KINDS.items()):
        kind = F.when(ending.isin(*endings), k).otherwise(kind)
    reason = F.lit(None).cast("string")
    for why, pattern in reversed(excluded.items()):
        reason = F.when(F.col("path").rlike(pattern), why).otherwise(reason)
    return files.withColumns({"name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "kind": kind, "excluded_by": reason})


def first_of_each(files: DataFrame, key: str, most: dict[str, int]) -> DataFrame:
    """files of each key in the order of their paths, at most as many as given for it; other keys none."""
    limits = F.create_map(*[F.lit(x) for pair in most.items() for x in pair])
    place = F.row_number().over(Window.partitionBy(key).orderBy("path"))
    return files.withColumn("_k", place).where(F.col("_k") <= F.coalesce(F.try_element_at(limits, key), F.lit(0))).drop("_k")


def with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels whose stem is that of one of the images."""
    return labels.join(images.select("stem").distinct(), "stem", "left_semi")


def packed(files: DataFrame, limit: int, share: float = 0.9) -> DataFrame:
    """files (path, size) with chunk, from 0: in the order of paths, a new chunk begins where the next file would make the running size
    exceed share * limit. The fill of a chunk depends on all before it, so files, whose rows are few and small, pass one task in order."""

    def run(batches):
        import pandas as pd

        held = list(batches)
        if not held:
            return
        frame = pd.concat(held).sort_values("path")
        chunk, filled, out = 0, 0, []
        for size in frame["size"]:
            if filled and filled + size > share * limit:
                chunk, filled = chunk + 1, 0
            filled += size
            out.append(chunk)
        yield frame.assign(chunk=out)

    return files.select("path", "size").coalesce(1).mapInPandas(run, "path string, size long, chunk long")


def damaged(contents: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): files of the manifest (path, sha256) that are missing from contents (path, content) or differ, and files that it lacks."""
    have = contents.select("path", F.sha2("content", 256).alias("found"))
    both = manifest.select("path", "sha256").join(have, "path", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("found") != F.col("sha256"), "differs")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")
