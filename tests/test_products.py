"""Sources, contracts, gates and the whole way from raw lines to layers, on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from rowloom.operators import metrics, postprocess, products, regions
from rowloom.sources import vectors


def test_regions_and_lines_of_geojson(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [1, 2], [2, 2], [2, 1], [1, 1]]
    feature = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c} if c else None}
    roi = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:32722"}}, "features": [feature("Polygon", [square, hole]), feature("Point", [1, 2]), feature("MultiPolygon", [[[[x + 10, y] for x, y in square]]]), feature("Polygon", None)]}
    (tmp_path / "roi.geojson").write_text(json.dumps(roi))
    e = regions.edges(vectors.read_roi(spark, f"{tmp_path}/roi.geojson"))
    assert abs(regions.area_centroid(e).first().area - 31) < 1e-9 and e.select("region_id", "ring").distinct().count() == 3
    (tmp_path / "bare.geojson").write_text(json.dumps({k: v for k, v in roi.items() if k != "crs"}))
    with pytest.raises(ValueError):
        vectors.read_roi(spark, f"{tmp_path}/bare.geojson")
    roi["features"] = roi["features"][1:2]
    (tmp_path / "none.geojson").write_text(json.dumps(roi))
    with pytest.raises(ValueError):
        vectors.read_roi(spark, f"{tmp_path}/none.geojson")
    rows = {"type": "FeatureCollection", "features": [feature("LineString", [[0, 0], [1, 0]], id="a"), feature("MultiLineString", [[[0, 0], [1, 0]], [[5, 5], [6, 6]]], id="a"), feature("LineString", [[7, 7], [8, 8]], id="-1"), feature("LineString", [[9, 9], [8, 8]]), feature("LineString", [[1, 1], [8, 8]], id="a")]}
    (tmp_path / "rows.geojson").write_text(json.dumps(rows))
    got = vectors.read_lines(spark, f"{tmp_path}/rows.geojson", "id")
    names = {r.line_id: r.unique_row_id for r in got.collect()}
    assert names == {0: "a", 1: "a_1", 2: "generated", 3: "generated_1", 4: "a_2"}
    assert sorted(r.unique_row_id for r in vectors.read_lines(spark, f"{tmp_path}/rows.geojson").select("unique_row_id").distinct().collect()) == [f"row_{i}" for i in range(5)]


def test_layers_and_thresholds(spark, tmp_path):
    assert vectors.resolve_layer(["GPKG:x:ortho", "GPKG:x:ortho_old"], "ortho") == "GPKG:x:ortho"
    assert vectors.resolve_layer(["GPKG:x:ortho_new"], None) == "GPKG:x:ortho_new" and vectors.resolve_layer(["a:north", "a:south"], "sou") == "a:south"
    for layers, name in ((["a:x1", "a:x2"], "x"), (["a:x"], "y"), (["a", "b"], None)):
        with pytest.raises(ValueError):
            vectors.resolve_layer(layers, name)
    spark.range(3).write.parquet(f"{tmp_path}/f/predicted_rows")
    assert vectors.read_first(spark, f"{tmp_path}/f")[0] == "predicted_rows"
    with pytest.raises(FileNotFoundError):
        vectors.read_first(spark, f"{tmp_path}/none")
    good = vectors.approved_threshold({"postprocessing": {"k": 1}}, json.dumps({"status": "approved", "center_threshold": 0.38}))
    assert good["postprocessing"] == {"k": 1, "threshold_mode": "single", "center_threshold": 0.38, "center_threshold_high": 0.38, "center_threshold_low": 0.38}
    with pytest.raises(ValueError):
        vectors.approved_threshold({}, json.dumps({"status": "rejected"}))
    df = spark.createDataFrame([([255.0, 255.0],), ([0.0, 0.0],), ([1.0, 2.0],), ([None, 1.0],)], "b array<double>")
    assert [r[0] for r in df.select(vectors.output_nodata(F.col("b"))).collect()] == [255.0, None, None, None]


def test_catalogue_of_files(spark):
    files = spark.createDataFrame([("a/train/1.tif", 50), ("a/train/2.tif", 45), ("a/val/3.TIF", 10), ("a/.git/x", 1), ("b/2.txt", 40), ("b/9.txt", 90)], "path string, size long")
    c = vectors.categorised(files, {"hidden": r"/\.git/", "old": "^old"})
    assert {r.path: (r.kind, r.stem, r.excluded_by) for r in c.collect()}["a/.git/x"] == ("other", "x", "hidden")
    images = vectors.first_of_each(c.where("kind = 'image'").withColumn("split", F.element_at(F.split("path", "/"), 2)), "split", {"train": 1, "val": 5})
    assert sorted(r.path for r in images.collect()) == ["a/train/1.tif", "a/val/3.TIF"]
    assert [r.path for r in vectors.with_labels(c.where("stem = '2' AND kind = 'image'"), c.where("kind = 'text'")).collect()] == ["b/2.txt"]
    assert [r.chunk for r in vectors.packed(files, 100).orderBy("path").collect()] == [0, 0, 1, 1, 2, 3]
    contents = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("d", bytearray(b""))], "path string, content binary")
    import hashlib

    sums = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest()), ("b", "0"), ("c", "0")], "path string, sha256 string")
    assert {r.path: r.problem for r in vectors.damaged(contents, sums).collect()} == {"b": "differs", "c": "missing", "d": "unlisted"}


def test_flags_and_provenance(spark):
    df = spark.createDataFrame([(1, True, None, "2.5"), (2, False, True, "x"), (3, None, None, None)], "line_id long, track_merged boolean, pair_reconstructed boolean, terminal_extended_m string")
    got = {r.line_id: (r.was_merged, r.was_reconstructed, r.was_terminal_extended, r.source_type) for r in metrics.provenance(df, "1").collect()}
    assert got == {1: (True, False, True, "mixed"), 2: (False, True, False, "reconstructed"), 3: (False, False, False, "original")}
    assert metrics.concat_rows(df, df.select("line_id").withColumn("more", F.lit(1))).columns == ["line_id", "track_merged", "pair_reconstructed", "terminal_extended_m", "more"]


def test_early_stopping(spark):
    df = spark.createDataFrame(list(enumerate([0.1, 0.3, 0.2, 0.31, 0.3, 0.3, 0.5])), "epoch long, score double")
    got = metrics.early_stopping(df, 2, 0.05).orderBy("epoch").collect()
    assert [r.improved for r in got] == [True, True, False, False, False, False, True] and [r.stopped for r in got] == [False, False, False, True, True, True, True]


def raw_lines(spark, rows):
    return spark.createDataFrame([(i, k, float(x), float(y)) for i, p in rows.items() for k, (x, y) in enumerate(p)], "line_id long, pos long, x double, y double")


FIELD = {1: [(x, 0.02 * (x % 2)) for x in range(11)], 2: [(x, 0.8 + 0.02 * (x % 2)) for x in range(11)], 3: [(x, 0.05) for x in range(10)], 4: [(x, 5) for x in range(8)], 5: [(5, 10), (5, 14)], 6: [(3, 12), (7, 12)], 7: [(9, 9)]}


@pytest.fixture(scope="module")
def result(spark):
    ring = [(1, 0, k, x, y) for k, (x, y) in enumerate([(-1.0, -1.0), (9.0, -1.0), (9.0, 20.0), (-1.0, 20.0)])]
    edges = regions.edges(spark.createDataFrame(ring, "region_id long, ring int, pos int, x double, y double"))
    return postprocess.run(raw_lines(spark, FIELD), edges, postprocess.Settings(estimate_spacing=False))


def test_the_whole_way(result):
    final = {r.line_id: r for r in result.final.collect()}
    assert sorted(final) == [1, 2, 4] and final[1].pair_id == final[2].pair_id == 1 and final[4].pair_status == "unmatched"
    assert final[1].source_raw_ids == '["raw_1","raw_3"]' and final[1].final_line_id == "final_000000" and abs(final[2].length_m - 9) < 0.02
    assert [final[i].postprocess_status for i in (1, 2, 4)] == ["approved", "approved", "manual_review"]
    assert {r.line_id: r.rejection_reason for r in result.rejected.collect()} == {5: "crossing;degree_gt_2", 6: "crossing;degree_gt_2"}
    gate = result.gate.first()
    assert (gate.final_line_count, gate.rejected_count, gate.crossing_count, gate.production_gate_reasons, gate.status) == (3, 2, 2, "unmatched_lines;crossings", "manual_review")


def test_lines_of_a_track_are_bridged_on_the_whole_way(spark):
    wave = lambda a, b, y: [(x, y + 0.02 * (x % 2)) for x in range(a, b)]
    got = postprocess.run(raw_lines(spark, {1: wave(0, 8, 0), 2: wave(10, 18, 0), 3: wave(0, 18, 0.8), 4: wave(0, 5, 9)}), settings=postprocess.Settings(estimate_spacing=False))
    final = {r.line_id: r for r in got.final.collect()}
    assert sorted(final) == [1, 3, 4] and abs(final[1].length_m - 17) < 0.02 and final[1].pair_id == final[3].pair_id
    assert {i: (r.source_raw_ids, r.bridged_fragments) for i, r in final.items()} == {1: ('["raw_1","raw_2"]', 2), 3: ('["raw_3"]', 1), 4: ('["raw_4"]', 1)}


def test_an_empty_network(spark):
    got = postprocess.run(raw_lines(spark, FIELD).limit(0))
    assert got.final.count() == 0 and got.gate.first().production_gate_passed


def test_two_stages_check_both_targets_and_write_manifests(spark, result, tmp_path):
    raw = raw_lines(spark, FIELD).groupBy("line_id").agg(F.count("x").alias("n"))
    finish = lambda _: result.final
    assert products.write_two_stages(raw, finish, f"{tmp_path}/raw", f"{tmp_path}/final") == "completed"
    manifest = {r.layer: r.n_rows for r in spark.read.json(f"{tmp_path}/final_manifest").collect()}
    assert manifest["raw"] == 7 and manifest["final"] == 3 and manifest["manual_review"] == 1 and manifest["repaired"] == 0
    with pytest.raises(FileExistsError):
        products.write_two_stages(raw, finish, f"{tmp_path}/raw2", f"{tmp_path}/final")
    assert not products.exists(spark, f"{tmp_path}/raw2")

    def fails(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        products.write_two_stages(raw, fails, f"{tmp_path}/raw3", f"{tmp_path}/final3")
    assert products.exists(spark, f"{tmp_path}/raw3") and spark.read.json(f"{tmp_path}/final3_failure").first().error == "no"
    products.write_compatible(result.final, f"{tmp_path}/old")
    assert spark.read.parquet(f"{tmp_path}/old/predicted_rows").count() == 2
    with pytest.raises(ValueError):
        products.write_raw(raw, f"{tmp_path}/bad")
    assert not products.exists(spark, f"{tmp_path}/bad")
    products.append_metrics(spark, f"{tmp_path}/log", {"epoch": 1, "dice": 0.5})
    products.append_metrics(spark, f"{tmp_path}/log", {"epoch": 2, "dice": 0.6})
    assert sorted(r.dice for r in spark.read.option("header", True).csv(f"{tmp_path}/log").collect()) == ["0.5", "0.6"]
    assert products.output_layout("/r/", "São Paulo!")["vectors"] == "/r/vectors/S_o_Paulo"


def test_geojson(spark):
    df = spark.createDataFrame([(1, [(0.0, 1.0), (2.0, 3.0)])], "line_id long, geom array<struct<x:double,y:double>>")
    got = json.loads(products.geojson_features(df, ["line_id"]).first().value)
    assert got == {"type": "Feature", "properties": {"line_id": 1}, "geometry": {"type": "LineString", "coordinates": [[0.0, 1.0], [2.0, 3.0]]}}
